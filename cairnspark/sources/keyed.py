"""A table with one row for each key, changed by batches that count once however often they come.

Rows lie in buckets of their key. A batch rewrites the buckets that it touches
under its own number; then a manifest with the place of every bucket is
published by one rename. Readers see the last manifest alone, so a batch is
there whole or not at all; one that comes again with a number that is published
changes nothing, and one that failed before its manifest is written anew.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.operators import identity as I

#: Places that are numbered in one task.
BLOCK = 100_000


class KeyedTable:
    """schema has the key. With ids, a column of that name is added and numbers keys from 1 without gaps, by their first batch and then by place (a whole number)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 16, ids: str | None = None, place: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.ids, self.place = spark, path.rstrip("/"), key, buckets, ids, place
        self.given = schema
        self.schema = T.StructType([*schema.fields, T.StructField(ids, T.LongType())]) if ids else schema

    def _file(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version (of the last batch; -1 before any), places (bucket: version), next_id."""
        folder, fs = self._file(f"{self.path}/manifest")
        names = sorted(f.getPath().toString() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": -1, "places": {}, "next_id": 1}
        return json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        made, fs = self._file(f"{self.path}/manifest/{manifest['version']:012d}.tmp")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(made, self._file(f"{self.path}/manifest/{manifest['version']:012d}.json")[0])

    def _places(self, manifest: dict, buckets=None) -> list[str]:
        return [f"{self.path}/data/{v:012d}/bucket={b}" for b, v in manifest["places"].items() if buckets is None or int(b) in buckets]

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._places(self.manifest()))

    def upsert(self, changes: DataFrame, version: int, newest: Column) -> bool:
        """Of each key the row with the greatest newest stays, of those there and those that come; False if version was published before."""
        now = self.manifest()
        if version <= now["version"]:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most one row a bucket
        if not touched:
            self._publish(now | {"version": version})
            return True
        there = self._read(self._places(now, touched))
        new = changes.select(*self.given.fieldNames())
        if self.ids:
            new = new.withColumn(self.ids, F.lit(None).cast("long"))
        best = F.max_by(F.struct(*self.given.fieldNames()), newest).alias("r")
        more = [F.max(self.ids).alias(self.ids)] if self.ids else []
        rows = there.unionByName(new).groupBy(self.key).agg(best, *more).select("r.*", *([self.ids] if self.ids else []))
        if self.ids:
            rows = self._numbered(rows, now["next_id"])
        place = f"{self.path}/data/{version:012d}"
        rows.select("*", bucket).repartition(min(self.buckets, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        next_id = now["next_id"]
        if self.ids:
            next_id = max(next_id, 1 + (self.spark.read.parquet(place).agg(F.max(self.ids)).first()[0] or 0))
        self._publish({"version": version, "places": now["places"] | {str(b): version for b in touched}, "next_id": next_id})
        return True

    def _numbered(self, rows: DataFrame, first: int) -> DataFrame:
        """Numbers for the keys that have none."""
        fresh = I.numbered(rows.where(F.col(self.ids).isNull()).drop(self.ids), F.floor(F.col(self.place) / BLOCK), self.place)
        return rows.where(F.col(self.ids).isNotNull()).unionByName(fresh.withColumn(self.ids, F.col("number").cast("long") + first - 1).drop("number"))


def keep_up_to_date(stream: DataFrame, table: KeyedTable, newest: Column, checkpoint: str) -> None:
    """Runs an update-mode stream with one row a key into table, over all that is there; the same checkpoint goes on where it ended."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: table.upsert(rows, number, newest))
    writer.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
