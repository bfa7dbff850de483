"""How each request of an access log ends, from the log alone.

A request that finds nothing fresh is a miss and starts a fetch; those of its
tile that come until the fetch ends wait for it. A fetch that succeeds stores
the tile when it ends, in memory and on disk; hits renew neither. One that
fails stores nothing, and those that waited get its error.

So all that a tile carries on is its last miss. The log is cut into blocks of
time, and a tile's requests in a block are one sorted array that is folded from
what the tile carried into the block, so a tile with very many requests is many
arrays. Blocks are folded one after the other, each on its own rows alone; a
tile whose last miss can no longer matter carries nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.ranking import ranked
from cairnspark.sources.shared import shared_folder

MISS = "struct<t:bigint,id:bigint,failed:boolean>"
FOREVER = (1 << 63) - 1


def free_from(miss: Column, latency: int, memory_ttl: int, disk_ttl: int) -> Column:
    """The time from which a request of the tile of this miss is a miss; null without one."""
    kept = F.when(miss["t"].isNotNull(), FOREVER) if disk_ttl == 0 else miss["t"] + latency + max(memory_ttl, disk_ttl)
    return F.when(miss["failed"], miss["t"] + latency).otherwise(kept)


def _folded(requests: Column, carried: Column, *rule: int) -> Column:
    """The misses among requests (sorted t, id, failed), behind the carried one (or null)."""
    start = F.struct(F.coalesce(free_from(carried, *rule), F.lit(-FOREVER)).alias("free"), F.array().cast(f"array<{MISS}>").alias("misses"))

    def step(acc: Column, r: Column) -> Column:
        missed = F.struct(free_from(r, *rule).alias("free"), F.concat(acc["misses"], F.array(r)).alias("misses"))
        return F.when(r["t"] >= acc["free"], missed).otherwise(acc)

    return F.aggregate(requests, start, step, lambda acc: acc["misses"])


def outcomes(log: DataFrame, block: int, latency: int, memory_ttl: int, disk_ttl: int = 0) -> DataFrame:
    """log (tile, t, event_id, failed: whether a fetch that it starts fails) with its outcome; times are whole numbers of one unit.

    block is the length of a block: a tile's requests of that time fit an
    array. A null failed counts as false; rows with a null tile or t are left
    out. Outcomes: mem-hit, disk-hit, wait-hit, wait-error, miss.
    """
    spark = log.sparkSession
    rule = (latency, memory_ttl, disk_ttl)
    folder = shared_folder(spark, "tile-outcomes")
    rows = log.where(F.col("tile").isNotNull() & F.col("t").isNotNull()).withColumn("failed", F.coalesce("failed", F.lit(False)))
    blocked = rows.withColumn("block", F.floor(F.col("t") / block))
    blocked.write.partitionBy("block").parquet(f"{folder}/log")
    stored = spark.read.schema(blocked.schema).parquet(f"{folder}/log")
    blocks = sorted(r[0] for r in stored.select("block").distinct().collect())  # one number a block
    carried = spark.createDataFrame([], f"tile {dict(log.dtypes)['tile']}, carried {MISS}")
    for b in blocks:
        here = stored.where(F.col("block") == b).withColumn("r", F.struct(F.col("t").cast("long").alias("t"), F.col("event_id").cast("long").alias("id"), F.col("failed").alias("failed")))
        arrays = here.groupBy("tile").agg(F.array_sort(F.collect_list("r")).alias("requests"))
        state = arrays.join(carried, "tile", "full").withColumn("misses", F.coalesce(_folded(F.col("requests"), F.col("carried"), *rule), F.array().cast(f"array<{MISS}>")))
        state.select("tile", "carried", "misses").write.parquet(f"{folder}/state/block={b}")
        state = spark.read.parquet(f"{folder}/state/block={b}")
        last = F.coalesce(F.try_element_at("misses", F.lit(-1)), F.col("carried"))
        carried = state.select("tile", last.alias("carried")).where(free_from(F.col("carried"), *rule) > (b + 1) * block)
    states = spark.read.schema(f"tile {dict(log.dtypes)['tile']}, carried {MISS}, misses array<{MISS}>, block long").parquet(f"{folder}/state") if blocks else carried.select("tile", "carried", F.array().cast(f"array<{MISS}>").alias("misses"), F.lit(0).cast("long").alias("block"))
    mine = F.struct(F.col("t").cast("long").alias("t"), F.col("event_id").cast("long").alias("id"))
    last = F.coalesce(F.try_element_at(F.filter("misses", lambda m: F.struct(m["t"].alias("t"), m["id"].alias("id")) <= mine), F.lit(-1)), F.col("carried"))
    met = stored.join(states, ["tile", "block"]).withColumn("last", last) if blocks else rows.withColumn("last", F.lit(None).cast(MISS))
    age = F.col("t") - F.col("last.t") - latency
    ends = F.when((F.col("last.id") == F.col("event_id")) & (F.col("last.t") == F.col("t")), "miss").when(age < 0, F.when(F.col("last.failed"), "wait-error").otherwise("wait-hit")).when(age < memory_ttl, "mem-hit").otherwise("disk-hit")
    return met.withColumn("outcome", ends).select(*log.columns, "outcome")


def limited(log: DataFrame, latency: int, most: int) -> DataFrame:
    """log as outcomes() gives it with disk_ttl 0, where memory holds most tiles; evicts tells the misses whose store puts one out.

    The disk keeps all, so each tile is stored once, and memory holds the tiles
    stored last; hits do not renew them. The tile of store k goes when store
    k + most comes, in order of time and event_id: stores are numbered, and
    meet by number. From then on the disk answers. Only tiles that go are
    joined, one row each.
    """
    if most < 1:
        raise ValueError("memory must hold a tile")
    stores = log.where((F.col("outcome") == "miss") & ~F.col("failed")).select("tile", (F.col("t") + latency).alias("at"), "event_id")
    numbered = ranked(stores, "number", "at", "event_id")
    later = numbered.select((F.col("number") - most).alias("number"), F.col("at").alias("gone_at"), F.col("event_id").alias("by"))
    gone = numbered.select("tile", "number").join(later, "number").select(F.col("tile").alias("gone"), "gone_at", "by")
    met = log.join(gone.select("gone", "gone_at"), F.col("tile") == F.col("gone"), "left").join(gone.select("by"), F.col("event_id") == F.col("by"), "left")
    ends = F.when((F.col("outcome") == "mem-hit") & (F.col("t") >= F.col("gone_at")), "disk-hit").otherwise(F.col("outcome"))
    return met.withColumn("outcome", ends).select(*log.columns, F.col("by").isNotNull().alias("evicts"))


def counters(log: DataFrame) -> DataFrame:
    """Requests, hits of memory and disk, hits of disk, waits, misses, of those what was stored and what failed, and evictions if the log tells them."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    miss = F.col("outcome") == "miss"
    return log.agg(F.count("*").alias("n"), n("mem-hit", "disk-hit").alias("hits"), n("disk-hit").alias("disk_hits"), n("wait-hit").alias("waits"), F.count_if(miss).alias("misses"), F.count_if(miss & ~F.col("failed")).alias("stored"), F.count_if(miss & F.col("failed")).alias("errors"), *([F.count_if("evicts").alias("evictions")] if "evicts" in log.columns else []))
