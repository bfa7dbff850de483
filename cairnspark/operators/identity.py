"""Identity rules of points, merging and de-duplication.

Points are equal by rounded key (name and millionths), within a tolerance on
both axes under one name, or exactly. Null names and coordinates equal each
other in keys and match nothing in joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions.scalars import micro

FILE_TOLERANCE, LIST_TOLERANCE = 1e-6, 1e-9


def key() -> list[Column]:
    return [F.col("name"), micro(F.col("lat")), micro(F.col("lon"))]


def merged(*sources: DataFrame) -> DataFrame:
    """Ordered concatenation: source_rank tells the source, ord the place in it."""
    return reduce(DataFrame.unionByName, (s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)))


def first_of_each(points: DataFrame, *order: str) -> DataFrame:
    """The first point of each rounded key.

    An aggregate that combines before the exchange, so that a place with very
    many points sends one row a task. Columns are taken one by one, so that
    unused ones are pruned. Points need a place in the order.
    """
    at = F.struct(*order) if len(order) > 1 else F.col(order[0] if order else "ord")
    rest = [c for c in points.columns if c != "name"]
    first = points.groupBy(*(k.alias(f"__k{n}") for n, k in enumerate(key()))).agg(*(F.min_by(c, at).alias(c) for c in rest))
    return first.withColumnRenamed("__k0", "name").select(*points.columns)


def near(a: str, b: str, tolerance: float) -> Column:
    """Same name and both axes within the tolerance, between two aliased sides."""
    return (F.col(f"{a}.name") == F.col(f"{b}.name")) & (F.abs(F.col(f"{a}.lat") - F.col(f"{b}.lat")) < tolerance) & (F.abs(F.col(f"{a}.lon") - F.col(f"{b}.lon")) < tolerance)


def _step(tolerance: float) -> float:
    return max(tolerance * 1000, 1e-6)  # a cell is far wider than the tolerance


def _cell(a: Column, b: Column, tolerance: float) -> Column:
    return F.struct(F.floor(a / _step(tolerance)).alias("a"), F.floor(b / _step(tolerance)).alias("b"))


def in_cells(others: DataFrame, tolerance: float) -> DataFrame:
    """others, once for each cell (column near_cell) that may hold a match: most often one, four at a corner."""
    moved = [_cell(F.col("lat") + i * tolerance, F.col("lon") + j * tolerance, tolerance) for i in (-2, 2) for j in (-2, 2)]
    return others.withColumn("near_cell", F.explode(F.array_distinct(F.array(*moved))))


def near_in_cell(a: str, b: str, tolerance: float) -> Column:
    """near() between points a and the cells of b, so that a common name is no hot key."""
    own = _cell(F.col(f"{a}.lat"), F.col(f"{a}.lon"), tolerance)
    return (own["a"] == F.col(f"{b}.near_cell.a")) & (own["b"] == F.col(f"{b}.near_cell.b")) & near(a, b, tolerance)


def matching(points: DataFrame, others: DataFrame, tolerance: float, how: str = "left_semi") -> DataFrame:
    """points with (left_semi) or without (left_anti) a match among others: a join on name and cell."""
    probe = in_cells(others.select("name", "lat", "lon"), tolerance)
    return points.alias("p").join(probe.alias("o"), near_in_cell("p", "o", tolerance), how)


def first_matches(points: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Each of others with the smallest ord of its matches."""
    probe = in_cells(others, tolerance).alias("o")
    pairs = probe.join(points.select("ord", "name", "lat", "lon").alias("p"), near_in_cell("p", "o", tolerance))
    return pairs.groupBy(*(F.col(f"o.{c}") for c in others.columns)).agg(F.min("p.ord").alias("match_ord"))


def numbered(rows: DataFrame, block: Column, *order: str) -> DataFrame:
    """rows with their number from 1 in the order of block, then order: each block is sorted apart, behind the sizes of those before it."""
    rows = rows.withColumn("__block", block)
    sizes = rows.groupBy("__block").agg(F.count("*").alias("__size"))
    before = sizes.select(F.col("__block").alias("__b"), (F.sum("__size").over(Window.orderBy("__block")) - F.col("__size")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return rows.join(before, F.col("__block").eqNullSafe(F.col("__b"))).withColumn("number", at + F.col("__before")).drop("__block", "__b", "__before")


def same_place(points: DataFrame, others: DataFrame, tolerance: float = LIST_TOLERANCE) -> DataFrame:
    """points whose coordinates alone match one of others: each is looked up in the cells around it."""
    own = _cell(F.col("lat"), F.col("lon"), tolerance)
    probe = in_cells(others, tolerance).select(F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("near_cell").alias("c"))
    hit = (own["a"] == F.col("c.a")) & (own["b"] == F.col("c.b")) & (F.abs(F.col("lat") - F.col("olat")) < tolerance) & (F.abs(F.col("lon") - F.col("olon")) < tolerance)
    return points.join(probe, hit, "left_semi")
