"""Queries on time: streams in event time, one spacing for all, caches from their log, and tables kept by streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.operators import spacing, tilecache
from cairnspark.plans import fixtures as X
from cairnspark.plans.registry import METRES, STEPS, query
from cairnspark.sources import fixlog
from cairnspark.sources.keyed import KeyedTable, keep_up_to_date
from cairnspark.sources.shared import shared_folder
from cairnspark.streaming import location as L
from cairnspark.streaming import ordered as O

#: Longer than the events last, as the replayed streams come in no order at all.
DELAY = "400 days"


def fixes(s, d):
    return X.location_fixes(s, d).select("device", "ts", "lat", "lon", "event_id")


@query(f"""SELECT device, t, lat, lon, event_id FROM (WITH RECURSIVE f AS ({STEPS} WHERE NOT (lat = 0 AND lon = 0)), walk AS (SELECT device, rn, t, lat, lon, event_id, t AS lt, lat AS la, lon AS lo, true AS given FROM f WHERE rn = 1
    UNION ALL SELECT device, rn, t, lat, lon, event_id, CASE WHEN m THEN t ELSE lt END, CASE WHEN m THEN lat ELSE la END, CASE WHEN m THEN lon ELSE lo END, m FROM (SELECT f.*, w.lt, w.la, w.lo, f.t - w.lt >= 5 AND {METRES} >= 25 AS m FROM walk w JOIN f ON f.device = w.device AND f.rn = w.rn + 1)) SELECT * FROM walk WHERE given)""")
def fix_threshold(s, d):
    return O.run_to_end(O.thresholded(O.replayed(fixes(s, d), "fixes"), DELAY), "fix-threshold")


@query(f"""SELECT k, event_id, t, round(emit_t, 3) AS emit_t FROM (WITH RECURSIVE f AS ({STEPS} ), walk AS (SELECT device AS k, rn, event_id, t, t AS emit_t FROM f WHERE rn = 1
    UNION ALL SELECT f.device, f.rn, f.event_id, f.t, greatest(f.t, w.emit_t + 0.4e0) FROM walk w JOIN f ON f.device = w.k AND f.rn = w.rn + 1) SELECT * FROM walk)""")
def throttle_emit(s, d):
    out = O.run_to_end(O.spaced(O.replayed(fixes(s, d), "requests"), DELAY), "throttle")
    return out.select(F.col("device").alias("k"), "event_id", "t", F.round("emit_t", 3).alias("emit_t"))


@query("""SELECT event_id, t, emit_t FROM (WITH RECURSIVE q AS MATERIALIZED (SELECT event_id, epoch_us(ts) // 500 AS t, row_number() OVER (ORDER BY epoch_us(ts) // 500, event_id) AS rn FROM events),
    walk AS (SELECT rn, event_id, t, t AS emit_t FROM q WHERE rn = 1 UNION ALL SELECT q.rn, q.event_id, q.t, greatest(q.t, w.emit_t + 400000) FROM walk w JOIN q ON q.rn = w.rn + 1) SELECT * FROM walk)""")
def throttle_all(s, d):
    """All events as requests to one server, five hundred times as fast as they came."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 500)
    return spacing.spaced(X.table(s, d, "events").select("event_id", t.alias("t")))


@query("SELECT device, ts, lat, lon, event_id FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS rn FROM location_fix WHERE NOT (lat = 0 AND lon = 0)) WHERE rn = 1")
def latest_fix_stream(s, d):
    """The latest fix of each device, kept by a stream in several micro-batches."""
    rows = fixes(s, d)
    table = KeyedTable(s, shared_folder(s, "latest-table"), "device", rows.select("device", "ts", "lat", "lon", "event_id").schema)
    stream = L.latest(O.real(O.replayed(rows, "latest")))
    keep_up_to_date(stream, table, F.struct("ts", "event_id"), shared_folder(s, "latest-state"))
    return table.read().select("device", "ts", "lat", "lon", "event_id")


@query("""SELECT device, count(*) AS n, max_by(event_id, (ts, event_id)) AS event_id, epoch_us(min(ts)) AS start_us FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts, event_id) AS burst FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM location_fix )) GROUP BY device, burst""")
def debounce_stream(s, d):
    out = O.run_to_end(O.debounced(O.replayed(fixes(s, d), "bursts"), DELAY, "6 hours"), "debounce")
    return out.select("device", "n", "event_id", F.unix_micros("start").alias("start_us"))


LATENCY_US = "(event_id * 7919 % 10800) * 1000000"


@query(f"""SELECT device, query_id, came_us FROM (SELECT user_id AS device, event_id AS query_id, epoch_us(ts) AS asked_us, epoch_us(ts) + {LATENCY_US} AS came_us FROM events) a
    WHERE NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = a.device AND (epoch_us(q.ts) > a.asked_us OR epoch_us(q.ts) = a.asked_us AND q.event_id > a.query_id) AND epoch_us(q.ts) <= a.came_us)""")
def current_answers_stream(s, d):
    """Every event is a question of its user, answered up to three hours later."""
    e = X.table(s, d, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"))
    asked = O.replayed(e, "asked").withColumnRenamed("event_id", "query_id")
    came = e.select("device", F.timestamp_micros(F.unix_micros("ts") + F.expr(LATENCY_US)).alias("ts"), "event_id", F.col("ts").alias("asked_ts"))
    answers = O.replayed(came, "answers").withColumnRenamed("event_id", "query_id")
    out = O.run_to_end(O.current_answers(asked, answers, DELAY, "3 hours"), "answers")
    return out.select("device", "query_id", F.unix_micros("ts").alias("came_us"))


#: A third of all requests are for one tile. Seconds: a fetch takes half an hour, memory keeps six hours and the disk thirty; every ninth fetch fails.
RULE = {"latency": 1800, "memory_ttl": 21_600, "disk_ttl": 108_000}
ACCESS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 97 END AS tile, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id % 9 = 4 AS failed FROM events"
OUTCOMES = f"""(WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY t, event_id) AS rn FROM ({ACCESS})),
    walk AS (SELECT event_id, tile, t, failed, rn, t AS missed, failed AS bad, 'miss' AS outcome FROM q WHERE rn = 1
    UNION ALL SELECT q.event_id, q.tile, q.t, q.failed, q.rn, CASE WHEN o = 'miss' THEN q.t ELSE missed END, CASE WHEN o = 'miss' THEN q.failed ELSE bad END, o FROM
        (SELECT q.*, w.missed, w.bad, CASE WHEN q.t < w.missed + 1800 THEN CASE WHEN w.bad THEN 'wait-error' ELSE 'wait-hit' END WHEN w.bad THEN 'miss' WHEN q.t < w.missed + 1800 + 21600 THEN 'mem-hit' WHEN q.t < w.missed + 1800 + 108000 THEN 'disk-hit' ELSE 'miss' END AS o
        FROM walk w JOIN q ON q.tile = w.tile AND q.rn = w.rn + 1) q) SELECT * FROM walk)"""


def accesses(s, d, tiles=97):
    k = F.col("event_id")
    return X.table(s, d, "events").select(k, F.when(k % 3 == 0, 0).otherwise(k % tiles).alias("tile"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), (k % 9 == 4).alias("failed"))


@query(f"SELECT event_id, tile, outcome FROM {OUTCOMES}")
def cache_replay(s, d):
    return tilecache.outcomes(accesses(s, d), 4 * 86_400, **RULE).select("event_id", "tile", "outcome")


@query(f"""SELECT count(*) AS n, count(*) FILTER (outcome IN ('mem-hit', 'disk-hit')) AS hits, count(*) FILTER (outcome = 'disk-hit') AS disk_hits, count(*) FILTER (outcome = 'wait-hit') AS waits,
    count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'miss' AND NOT failed) AS stored, count(*) FILTER (outcome = 'miss' AND failed) AS errors FROM {OUTCOMES}""")
def cache_replay_stats(s, d):
    return tilecache.counters(tilecache.outcomes(accesses(s, d), 4 * 86_400, **RULE))


#: Memory keeps ten days and 100 of 997 tiles, the disk all.
KEPT = OUTCOMES.replace("event_id % 97 ", "event_id % 997 ").replace("q.t < w.missed + 1800 + 108000", "true").replace("21600", "864000")
LIMITED = f"""(WITH o AS (SELECT * FROM {KEPT}), s AS (SELECT tile, event_id, t + 1800 AS u, row_number() OVER (ORDER BY t + 1800, event_id) AS r FROM o WHERE outcome = 'miss' AND NOT failed),
    e AS (SELECT a.tile, b.u FROM s a JOIN s b ON b.r = a.r + 100)
    SELECT o.event_id, o.tile, o.failed, CASE WHEN outcome = 'mem-hit' AND t >= e.u THEN 'disk-hit' ELSE outcome END AS outcome, coalesce(s.r > 100, false) AS evicts FROM o LEFT JOIN e ON e.tile = o.tile LEFT JOIN s ON s.event_id = o.event_id)"""


@query(f"SELECT event_id, tile, outcome, evicts FROM {LIMITED}")
def cache_limited(s, d):
    kept = tilecache.outcomes(accesses(s, d, 997), 4 * 86_400, 1800, 864_000)
    return tilecache.limited(kept, 1800, 100).select("event_id", "tile", "outcome", "evicts")


@query(f"""SELECT count(*) AS n, count(*) FILTER (outcome IN ('mem-hit', 'disk-hit')) AS hits, count(*) FILTER (outcome = 'disk-hit') AS disk_hits, count(*) FILTER (outcome = 'wait-hit') AS waits,
    count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'miss' AND NOT failed) AS stored, count(*) FILTER (outcome = 'miss' AND failed) AS errors, count(*) FILTER (evicts) AS evictions FROM {LIMITED}""")
def cache_limited_stats(s, d):
    return tilecache.counters(tilecache.limited(tilecache.outcomes(accesses(s, d, 997), 4 * 86_400, 1800, 864_000), 1800, 100))


HISTORY = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("query", T.StringType())])


@query("SELECT event_id, event_type || ' ' || (user_id % 50) AS query, row_number() OVER (ORDER BY event_id % 2, event_id) AS id FROM events")
def history_sink(s, d):
    """Searches put into a history in two batches, the second of which comes twice; ids go on without gaps or repeats."""
    e = X.table(s, d, "events").select("event_id", F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")).alias("query"))
    table = KeyedTable(s, shared_folder(s, "history"), "event_id", HISTORY, ids="id", place="event_id")
    for version, part in ((0, 0), (1, 1), (1, 1)):
        table.upsert(e.where(F.col("event_id") % 2 == part), version, F.col("query"))
    return table.read()


@query("SELECT device, epoch_us(ts) AS us, lat, lon, event_id FROM location_fix WHERE NOT (lat = 0 AND lon = 0)")
def fixes_from_source(s, d):
    """Valid fixes by a source with offsets: the log grows between two runs, and the second run fails and goes on."""
    path, where = shared_folder(s, "fix-log"), shared_folder(s, "from-source")
    half = F.col("event_id") % 2 == 0
    failed: list[int] = []

    def run():
        fails = len(failed) == 1

        def put(rows, number):
            rows.write.mode("overwrite").parquet(f"{where}/out/batch={number}")
            if fails and not failed.append(2):
                raise ConnectionError("the sink is gone")

        rows = L.valid(fixlog.stream(s, path))
        rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()

    fixlog.append(fixes(s, d).where(half), path)
    run()
    failed.append(1)
    fixlog.append(fixes(s, d).where(~half), path)
    fixlog.kept_running(run, 1, lambda _: None)
    return s.read.parquet(f"{where}/out").select("device", F.unix_micros("ts").alias("us"), "lat", "lon", "event_id")
