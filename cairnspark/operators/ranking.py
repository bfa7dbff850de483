"""Numbers in one order over all rows, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.sources.shared import shared_folder


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their number from 1 in the order of columns that are unique together.

    Range partitions are stored and numbered each by itself; the driver adds up
    one count a partition.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "ranked")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)
    before, chained = 0, []
    for part, n in stored.groupBy("__part").count().orderBy("__part").collect():  # one count a partition
        chained.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(chained, "__p int, __before long"))
    mine = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = stored.withColumn("__mine", mine).join(starts, F.col("__part") == F.col("__p"))
    return placed.withColumn(name, F.col("__before") + F.col("__mine")).select(*rows.columns, name)
