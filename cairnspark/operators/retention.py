"""Cache retention, lookups and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMORY_TTL, DISK_TTL, MOST_FILES, MOST_BYTES = 3600, 0, 20000, 256 << 20


def pruned(files: DataFrame, now: int, ttl: int = DISK_TTL, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files that stay: young enough, among the newest, and within the bytes. With ttl 0 all stay.

    All three rules keep a prefix of newest first. The running sum needs one
    order over all files, so files are first cut to those that could stay: no
    file beyond the newest most_files does.
    """
    if ttl <= 0:
        return files
    young = files.where(F.col("mtime") > now - ttl).orderBy(F.desc("mtime"), "path").limit(most_files)
    newest = Window.orderBy(F.desc("mtime"), "path").rowsBetween(Window.unboundedPreceding, 0)
    return young.withColumn("running", F.sum("bytes").over(newest)).where(F.col("running") <= most_bytes).drop("running")


def kept_in_memory(entries: DataFrame, most: int) -> DataFrame:
    """The entries stored last; a hit does not renew one."""
    return entries.orderBy(F.desc("stored_at"), "key").limit(most)


def outcome(log: DataFrame, memory_ttl: int = MEMORY_TTL, disk_ttl: int = DISK_TTL) -> DataFrame:
    """log (mem_age, disk_age, in_flight) with how each lookup ends."""
    fresh = F.col("disk_age").isNotNull() if disk_ttl == 0 else F.col("disk_age") < disk_ttl
    return log.withColumn("outcome", F.when(F.col("mem_age") < memory_ttl, "mem-hit").when(fresh, "disk-hit").when(F.col("in_flight"), "wait-hit").otherwise("miss"))


def counters(log: DataFrame) -> DataFrame:
    """Totals of outcomes; hits are those of memory and disk."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return log.agg(n("mem-hit", "disk-hit").alias("hits"), n("disk-hit").alias("disk_hits"), n("miss").alias("misses"), n("wait-hit").alias("waits"))


def fetch_counters(log: DataFrame) -> DataFrame:
    """Requests, hits, and of the misses those that were stored and those that failed (column failed)."""
    miss = F.col("outcome") == "miss"
    return log.agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin("mem-hit", "disk-hit")).alias("hits"), F.count_if(miss & ~F.col("failed")).alias("stored"), F.count_if(miss & F.col("failed")).alias("errors"))


def shown_ttl(seconds: int) -> int:
    return -1 if seconds == 0 else seconds


def coalesced(requests: DataFrame, key: str, seconds: int) -> DataFrame:
    """One fetch for each key and window, and how many requests it serves."""
    return requests.groupBy(key, F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests")).select(key, F.unix_timestamp("w.start").alias("start"), "requests")
