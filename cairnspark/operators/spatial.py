"""Grid clusters, viewports, bounds and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import mercator as M
from cairnspark.operators.identity import FILE_TOLERANCE, LIST_TOLERANCE, first_of_each, matching


def zoom_of(value) -> int:
    try:
        return max(0, int(value))
    except (TypeError, ValueError):
        return 0


def grid_of(value) -> int:
    try:
        return int(value) if 8 <= int(value) <= 512 else 60
    except (TypeError, ValueError):
        return 60


def clusters(points: DataFrame, zoom=0, grid=60, bookmarks_only: bool = False, floor: bool = False) -> DataFrame:
    """One row for each grid cell: a single point as it is, several as the centre of their pixel box.

    Points at the poles have no pixel and are left out. One partial and one
    final hash aggregate; no rows are gathered.
    """
    z, g = zoom_of(zoom), grid_of(grid)
    rows = points.where("bookmark") if bookmarks_only else points
    rows = rows.select("name", "lat", "lon", "bookmark", M.pixel_x(F.col("lon"), z).alias("x"), M.pixel_y(F.col("lat"), z).alias("y")).where("x is not null and y is not null")
    cells = rows.groupBy(M.cell(F.col("x"), g, floor).alias("bx"), M.cell(F.col("y"), g, floor).alias("by"))
    box = cells.agg(F.count("*").alias("cnt"), *(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))), *(F.min(c).alias(c) for c in ("name", "lat", "lon", "bookmark")))
    one = F.col("cnt") == 1
    lon = F.when(one, F.col("lon")).otherwise(M.longitude((F.col("lo_x") + F.col("hi_x")) / 2, z))
    lat = F.when(one, F.col("lat")).otherwise(M.latitude((F.col("lo_y") + F.col("hi_y")) / 2, z))
    return box.select("bx", "by", F.when(one, "waypoint").otherwise("cluster").alias("type"), lat.alias("lat"), lon.alias("lon"), F.when(one, F.col("name")).alias("name"), F.when(one, F.col("bookmark")).alias("bookmark"), "cnt")


def is_cluster(kind, count):
    return F.coalesce(kind == "cluster", count > 1)


def viewport(points: DataFrame, lat1: float, lon1: float, lat2: float, lon2: float) -> DataFrame:
    """Points in the box of two corners, its edges included."""
    return points.where(F.col("lat").between(min(lat1, lat2), max(lat1, lat2)) & F.col("lon").between(min(lon1, lon2), max(lon1, lon2)))


def merged_viewport(points: DataFrame, lat1: float, lon1: float, lat2: float, lon2: float) -> DataFrame:
    """The box of de-duplicated points; points of one key are within a millionth, so that others are dropped first."""
    edge = 2 * FILE_TOLERANCE
    around = viewport(points, max(lat1, lat2) + edge, min(lon1, lon2) - edge, min(lat1, lat2) - edge, max(lon1, lon2) + edge)
    return viewport(first_of_each(around), lat1, lon1, lat2, lon2)


def table_order(points: DataFrame) -> DataFrame:
    return points.orderBy(F.coalesce("name", F.lit("")), "lat", "lon", "ord")


def bounds(points: DataFrame) -> DataFrame:
    """Centre and zoom that fit all points; no row without points."""
    box = points.where("lat is not null and lon is not null").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max)))).where("min_lat is not null")
    span = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"))
    zoom = F.greatest(F.lit(1.0), F.least(F.lit(18.0), F.coalesce(F.lit(10.0) - F.log2(F.when(span > 0, span * 10)), F.lit(18.0))))
    return box.select("min_lat", "max_lat", "min_lon", "max_lon", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), zoom.alias("zoom"))


def by_name(points: DataFrame, name: str) -> DataFrame:
    """The first point of that name in any case, bookmarks first."""
    return points.where(F.lower("name") == name.lower()).orderBy(~F.col("bookmark"), "ord").limit(1)


def index_of(points: DataFrame, name: str, lat: float, lon: float, tolerance: float = LIST_TOLERANCE) -> DataFrame:
    """The smallest ord of that point, or -1."""
    hit = points.where((F.col("name") == name) & (F.abs(F.col("lat") - lat) < tolerance) & (F.abs(F.col("lon") - lon) < tolerance))
    return hit.agg(F.coalesce(F.min("ord"), F.lit(-1)).alias("ord"))


def effective(points: DataFrame, filtered: DataFrame | None, bookmarks_only: bool) -> DataFrame:
    """The tag-filtered points, else bookmarks if asked for, else all."""
    return filtered if filtered is not None else points.where("bookmark") if bookmarks_only else points


def clears_selection(show_all: Column, selected: Column) -> Column:
    """Whether a selection (null: none) goes, as it is no bookmark and only those are shown."""
    return F.coalesce(~show_all & ~selected, F.lit(False))


def visible_selection(selected: DataFrame, model: DataFrame, tolerance: float = LIST_TOLERANCE) -> DataFrame:
    """Selections that stay: transient ones, and those that match a row of the model that is no cluster."""
    stays = matching(selected.where("not transient"), model.where(~is_cluster(F.col("type"), F.col("cnt"))), tolerance)
    return selected.where("transient").unionByName(stays.select(*selected.columns))


def sparse(points: DataFrame) -> DataFrame:
    """Zero elevations and empty texts as null."""
    empty = [c for c in ("time", "desc") if c in points.columns]
    return points.withColumns({"ele": F.nullif(F.col("ele"), F.lit(0.0)), **{c: F.nullif(F.col(c), F.lit("")) for c in empty}})
