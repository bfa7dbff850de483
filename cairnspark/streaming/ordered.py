"""Streams in event time: rows leave in order, however they came in.

Rows wait in their key's state until the watermark has passed them; a timer of
the first that waits then lets out all that it has passed, in order of time and
event_id. So neither the size of Arrow batches nor the cut into micro-batches
changes the result. Rows behind the watermark are late and dropped.

Rows with a null device carry a time alone: they move the watermark, and one
beyond the last row by more than the delay ends a stream whose rows all leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairnspark.functions.scalars import EARTH_M
from cairnspark.sources.shared import shared_folder

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = "device bigint, t double, lat double, lon double, event_id bigint"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block alone."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def real(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Without rows that carry a time alone. The condition names ts, so it stays above the watermark."""
    return rows.where(F.col("device").isNotNull() | F.col(ts).isNull())


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, a)))


class InOrder(StatefulProcessor):
    """The state of a key: rows that wait, the time of its timer, and what the rows that left have left behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, lat double, lon double, event_id bigint")
        self.timer = handle.getValueState("timer", "at bigint")
        self.last = handle.getValueState("last", "t double, lat double, lon double")

    def step(self, last: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """What is left behind, and the row to give out or None."""
        raise NotImplementedError

    def _set_timer(self, t: float) -> None:
        """The first whole millisecond that is not before t, if no timer stands before it."""
        at = math.ceil(round(t * 1e6) / 1e3)
        if self.timer.exists():
            have = self.timer.get()[0]
            if have <= at:
                return
            self.handle.deleteTimer(have)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = math.inf
        for part in rows:
            new = list(zip(part.t.astype(float).tolist(), part.lat.astype(float).tolist(), part.lon.astype(float).tolist(), part.event_id.astype(int).tolist(), strict=True))
            self.waiting.appendList(new)
            least = min(least, *(r[0] for r in new))
        if least < math.inf:
            self._set_timer(least)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[3]))
        out = []
        last = tuple(self.last.get()) if self.last.exists() else None
        n = 0
        while n < len(rows) and math.ceil(round(rows[n][0] * 1e6) / 1e3) <= passed:
            last, given = self.step(last, rows[n])
            if given is not None:
                out.append((key[0], *given))
            n += 1
        if last is not None:
            self.last.update(tuple(map(float, last)))
        self.timer.clear()
        if n < len(rows):
            self.waiting.put(rows[n:])
            self._set_timer(rows[n][0])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["device", "t", "lat", "lon", "event_id"])


class FarEnough(InOrder):
    """Fixes at least so far and so long after the one last given out."""

    def __init__(self, least_metres: float, least_seconds: float):
        self.least_metres, self.least_seconds = least_metres, least_seconds

    def step(self, last, row):
        t, lat, lon, _ = row
        if last is None or (t - last[0] >= self.least_seconds and metres(last[1], last[2], lat, lon) >= self.least_metres):
            return (t, lat, lon), row
        return last, None


class Spaced(InOrder):
    """Requests, each with the time at which it may go; its place in lat."""

    def __init__(self, spacing: float):
        self.spacing = spacing

    def step(self, last, row):
        at = row[0] if last is None else max(row[0], last[0] + self.spacing)
        return (at, 0.0, 0.0), (row[0], at, 0.0, row[3])


def _run(rows: DataFrame, processor: InOrder) -> DataFrame:
    return rows.groupBy("device").transformWithStateInPandas(processor, COLUMNS, "Append", "EventTime")


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    at = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return real(at).withColumn("t", F.col("ts").cast("double"))


def thresholded(fixes: DataFrame, delay: str, least_metres: float = 25.0, least_seconds: float = 5.0) -> DataFrame:
    """Fixes (device, ts, lat, lon, event_id) at least so far and so long after the one last given out; those at zero, zero are left out."""
    rows = _timed(fixes, delay).where(~((F.col("lat") == 0) & (F.col("lon") == 0)) | F.col("ts").isNull())
    return _run(rows.select("device", "ts", "t", "lat", "lon", "event_id"), FarEnough(least_metres, least_seconds))


def spaced(requests: DataFrame, delay: str, spacing: float = 0.4) -> DataFrame:
    """Requests (device, ts, event_id) with emit_t, at least spacing after the one before of their device."""
    zero = F.lit(0.0)
    rows = _timed(requests, delay).select("device", "ts", "t", zero.alias("lat"), zero.alias("lon"), "event_id")
    return _run(rows, Spaced(spacing)).select("device", "event_id", "t", F.col("lat").alias("emit_t"))


def debounced(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """The last event of each closed burst of a device, and its size; a burst is closed once the watermark is a gap behind it.

    Late events are dropped; an event that comes before its burst is closed
    joins it, and may join two bursts to one.
    """
    rows = real(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))
    burst = F.session_window(F.col("ts"), gap)
    return rows.groupBy("device", burst.alias("w")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("device", "n", "event_id", F.col("w.start").alias("start"))


def current_answers(asked: DataFrame, answers: DataFrame, delay: str, longest: str) -> DataFrame:
    """Answers that no newer question of their session has made stale when they come.

    asked: device, ts, query_id. answers: device, ts, query_id, asked_ts, at
    most longest after the question. Both sides keep what may still meet: a
    question for longest beyond the watermark. An answer leaves once no
    question from before it can come any more.
    """
    # a key that cannot be null: else the join drops rows with a time alone in front of the watermark
    q = real(asked.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)).select(F.coalesce("device", F.lit(0)).alias("q_device"), F.col("ts").alias("q_ts"), F.col("query_id").alias("newer"))
    a = real(answers.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))
    newer = (F.col("device") == F.col("q_device")) & (F.struct("q_ts", "newer") > F.struct("asked_ts", "query_id")) & (F.col("q_ts") <= F.col("ts")) & (F.col("q_ts") >= F.col("ts") - F.expr(f"INTERVAL {longest}"))
    return a.join(q, newer, "leftOuter").where(F.col("newer").isNull()).select("device", "query_id", "ts")


def run_to_end(stream: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, in append mode, and returns its rows; where names the folder of a run to go on with."""
    spark = stream.sparkSession
    where = where or shared_folder(spark, name)
    with settings(spark, ROCKS):
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def replayed(rows: DataFrame, name: str, batches: int = 4, last: str = "2100-01-01") -> DataFrame:
    """A stream of rows (device, ts, event_id, ...) in about so many micro-batches, in no order of time, and then of a row with the time last alone."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark, name)}/in"
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files, "event_id").write.parquet(folder)
    end = [F.lit(last if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).select(*end).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", math.ceil(files / batches)).parquet(folder)
