"""Location fixes: the latest, bursts, current answers and signals, on batch frames; ordered.py has the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(fixes: DataFrame) -> DataFrame:
    """Without fixes at zero, zero."""
    return fixes.where(~((F.col("lat") == 0) & (F.col("lon") == 0)))


def latest(fixes: DataFrame) -> DataFrame:
    """The last valid fix of each device; ties go to the larger event_id."""
    best = F.max_by(F.struct("ts", "lat", "lon", "event_id"), F.struct("ts", "event_id")).alias("f")
    return valid(fixes).groupBy("device").agg(best).select("device", "f.ts", "f.lat", "f.lon", "f.event_id")


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """The last event of each burst of a key: bursts are parted by a gap. Streams need a watermark on ts."""
    burst = F.session_window(F.col("ts"), gap)
    return events.groupBy(key, burst.alias("w")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).drop("w")


def current_only(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers to the latest question of each session; stale ones are dropped."""
    last = asked.groupBy("session").agg(F.max("query_id").alias("query_id"))
    return answers.join(last, ["session", "query_id"], "left_semi")


def usable_signal(signals: DataFrame, name: str, path: str) -> DataFrame:
    return signals.where((F.col("name") == name) & (F.col("path") == path) & (F.coalesce("location", F.lit("")) != ""))
