"""Suggestions for many texts at once, from a stored index of pieces of names.

Names are indexed once each, however many points have them, with the first few
of these points. A text of three characters or more is looked up by its
trigrams: the lists of its two rarest are intersected and the names left are
compared. A shorter text is itself a piece, for which the first few names are
kept in their order, as more can never be asked for. So no question meets all
points, and no list of a short piece grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions.scalars import trimmed
from cairnspark.operators.suggest import CAP
from cairnspark.sources.shared import shared_folder

GRAM, RAREST = 3, 2


def pieces(text: Column, n: int) -> Column:
    """The different pieces of n characters."""
    last = F.char_length(text) - (n - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


class NameIndex:
    """names: lname, name, points (the first CAP as structs, by ord). postings: gram, lname. lists: gram, size. short: gram (below GRAM characters), lname, name."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.names, self.postings, self.lists, self.short = (spark.read.parquet(f"{path}/{n}") for n in ("names", "postings", "lists", "short"))

    @classmethod
    def build(cls, points: DataFrame, path: str | None = None) -> NameIndex:
        """points: ord, name and other columns, of which those to be shown are kept."""
        spark = points.sparkSession
        path = path or shared_folder(spark, "name-index")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the first points of a name: an aggregate that combines, so that a common name is no hot key
        row = F.struct("ord", *[c for c in points.columns if c not in ("ord", "name")])
        spread = points.where((F.col("name") != "") & F.col("ord").isNotNull()).select("name", row.alias("p"))
        block = Window.partitionBy("name", F.pmod(F.xxhash64("p.ord"), F.lit(64))).orderBy("p.ord")
        few = spread.withColumn("at", F.row_number().over(block)).where(F.col("at") <= CAP)
        names = few.groupBy("name").agg(F.slice(F.array_sort(F.collect_list("p")), 1, CAP).alias("points"))
        names.select(F.lower("name").alias("lname"), "name", "points").repartitionByRange(parts, "lname", "name").write.parquet(f"{path}/names")
        stored = spark.read.parquet(f"{path}/names")
        lnames = stored.select("lname").distinct()
        lnames.select("lname", F.explode(pieces(F.col("lname"), GRAM)).alias("gram")).repartitionByRange(parts, "gram", "lname").sortWithinPartitions("gram", "lname").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("size")).write.parquet(f"{path}/lists")
        below = F.concat(F.array(F.lit("")), *(pieces(F.col("lname"), n) for n in range(1, GRAM)))
        grams = stored.select("lname", "name", F.explode(below).alias("gram")).withColumn("part", F.spark_partition_id())
        least = lambda *by: F.row_number().over(Window.partitionBy("gram", *by).orderBy("lname", "name"))
        first = grams.withColumn("at", least("part")).where(F.col("at") <= CAP).withColumn("at", least()).where(F.col("at") <= CAP)
        first.select("gram", "lname", "name").write.parquet(f"{path}/short")
        return cls(spark, path)

    def suggest(self, questions: DataFrame, text: str = "q", cap: int = CAP) -> DataFrame:
        """text (as asked), rank and the points whose name holds it, case aside, in order of name and ord: cap at most, CAP at most."""
        asked = questions.select(F.col(text).alias("asked")).where(F.col("asked").isNotNull()).distinct().withColumn("t", F.lower(trimmed(F.col("asked"))))
        texts = asked.select("t").distinct()
        long = texts.where(F.char_length("t") >= GRAM).select("t", F.explode(pieces(F.col("t"), GRAM)).alias("gram")).join(self.lists, "gram", "left")
        rarity = Window.partitionBy("t").orderBy(F.coalesce("size", F.lit(0)), "gram")
        rare = long.withColumn("rank", F.row_number().over(rarity)).where(F.col("rank") <= RAREST)
        met = rare.join(self.postings, "gram").groupBy("t", "lname").agg(F.count("*").alias("met")).join(rare.groupBy("t").agg(F.count("*").alias("lists")), "t")
        held = met.where((F.col("met") == F.col("lists")) & F.contains("lname", "t")).select("t", "lname")
        by_name = Window.partitionBy("t").orderBy("lname", "name")
        few = held.join(self.names.select("lname", "name"), "lname").withColumn("n", F.row_number().over(by_name)).where(F.col("n") <= cap).select("t", "lname", "name")
        brief = texts.where(F.char_length("t") < GRAM).join(self.short, F.col("t") == F.col("gram")).select("t", "lname", "name")
        rows = few.unionByName(brief).join(self.names, ["lname", "name"]).select("t", "lname", "name", F.explode("points").alias("p"))
        order = Window.partitionBy("t").orderBy("lname", "name", "p.ord")
        best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        return best.join(asked, "t").select(F.col("asked").alias(text), "rank", "name", "p.*")
