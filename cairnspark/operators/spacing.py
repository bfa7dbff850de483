"""One spacing for all requests: a parallel prefix scan in the max-plus sense.

The k-th request may go at max(its time, spacing after the one before), which
is k * spacing + the maximum of (time - number * spacing) over it and all before
it. Range partitions of the order find their sizes and maxima alone; the driver
chains one pair of numbers a partition; then each partition gives out its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.sources.shared import shared_folder

SPACING_US = 400_000


def spaced(requests: DataFrame, spacing: int = SPACING_US, t: str = "t", tie: str = "event_id") -> DataFrame:
    """requests (t and tie: whole numbers, t in microseconds) with emit_t; none is dropped, and those with a null t are left out."""
    spark = requests.sparkSession
    path = shared_folder(spark, "spaced")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = requests.where(F.col(t).isNotNull()).repartitionByRange(parts, t, tie).withColumn("__part", F.spark_partition_id())
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)
    mine = Window.partitionBy("__part").orderBy(t, tie)
    number = F.row_number().over(mine)
    ahead = F.max(F.col(t) - F.col("__number") * spacing).over(mine.rowsBetween(Window.unboundedPreceding, 0))
    rows = stored.withColumn("__number", number.cast("long")).withColumn("__ahead", ahead)
    pairs = rows.groupBy("__part").agg(F.count("*").alias("n"), F.max("__ahead").alias("most")).orderBy("__part").collect()  # one pair a partition
    before, most, chained = 0, None, []
    for part, n, ahead_of_part in pairs:
        chained.append((part, before, most))
        most = ahead_of_part - before * spacing if most is None else max(most, ahead_of_part - before * spacing)
        before += n
    starts = F.broadcast(spark.createDataFrame(chained, "__p int, __before long, __most long"))
    placed = rows.join(starts, F.col("__part") == F.col("__p"))
    ahead_of_all = F.greatest(F.col("__most"), F.col("__ahead") - F.col("__before") * spacing)  # skips nulls
    return placed.withColumn("emit_t", (F.col("__before") + F.col("__number")) * spacing + ahead_of_all).select(*requests.columns, "emit_t")
