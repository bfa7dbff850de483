"""An append-only log of location fixes as a streaming source with offsets.

The log is a folder of Parquet segments, each with the number of its first row
in its name; appends are published by renaming whole segments. An offset is a
number of rows, so a batch that is replayed after a failure reads the same rows,
and a stream that goes on from its checkpoint neither loses nor repeats any.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "device bigint, ts timestamp, lat double, lon double, event_id bigint"
ARROW = pyarrow.schema([("device", pyarrow.int64()), ("ts", pyarrow.timestamp("us", "UTC")), ("lat", pyarrow.float64()), ("lon", pyarrow.float64()), ("event_id", pyarrow.int64())])
#: Rows of a segment at most.
ROWS = 100_000
#: Seconds before the n-th attempt after a failure, at first n times STEP, later LONG.
STEP, EARLY, LONG = 2, 5, 30


def append(fixes: DataFrame, path: str) -> int:
    """Adds fixes behind what the log holds, in order of event_id; the number of rows that it has then. One writer at a time."""
    spark = fixes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    new = f"{path}/new-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(SCHEMA).fields]
    fixes.select(*columns).repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").write.option("maxRecordsPerFile", ROWS).parquet(new)
    sizes = spark.read.schema(SCHEMA).parquet(new).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).orderBy("first").collect()  # one row a segment
    at = sum(n for _, n, _ in segments(path))
    fs = place(path).getFileSystem(conf)
    for file, n, _ in sizes:
        fs.rename(place(file), place(f"{path}/{at:015d}-{n:09d}.parquet"))
        at += n
    fs.delete(place(new), True)
    return at


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """First row, number of rows and path of each segment, in order."""
    fs, root = _opened(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    names = [f for f in found if f.is_file and f.base_name.endswith(".parquet")]
    return sorted((int(f.base_name[:15]), int(f.base_name[16:25]), f.path) for f in names)


class Rows(InputPartition):
    """Rows low to high of one segment."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class FixReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": sum(n for _, n, _ in segments(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["rows"], end["rows"]
        return [Rows(file, max(low - first, 0), min(high - first, n)) for first, n, file in segments(self.path) if first < high and first + n > low]

    def read(self, partition: Rows) -> Iterator:
        fs, _ = _opened(self.path)
        at = 0
        with fs.open_input_file(partition.file) as f:
            for batch in pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=10_000):
                low, high = max(partition.low - at, 0), min(partition.high - at, batch.num_rows)
                if low < high:
                    yield from pyarrow.Table.from_batches([batch.slice(low, high - low)]).cast(ARROW).to_batches()
                at += batch.num_rows

    def commit(self, end: dict) -> None:
        """Nothing is forgotten: the log stays."""


class FixLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixlog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FixReader:
        return FixReader(self.options["path"])


def stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FixLog)
    return spark.readStream.format("fixlog").option("path", path).load()


def waits() -> Iterator[int]:
    n = 0
    while True:
        n += 1
        yield STEP * n if n <= EARLY else LONG


def kept_running(start: Callable[[], None], most: int, pause: Callable[[float], None] = time.sleep) -> int:
    """Calls start, which runs a stream to its end, again after each failure and its wait; the number of failures. The one after most failures is passed on."""
    for failures, wait in enumerate(waits()):
        try:
            start()
            return failures
        except Exception:
            if failures >= most:
                raise
            pause(wait)
    return most
