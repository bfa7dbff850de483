"""Streams in event time, spacing, cache replay and keyed tables against plain folds."""

import heapq
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import spacing, tilecache
from cairnspark.sources.keyed import KeyedTable, keep_up_to_date
from cairnspark.streaming import location as L
from cairnspark.streaming import ordered as O

BEGAN = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIX = "device long, ts timestamp, lat double, lon double, event_id long"


def at(seconds):
    return BEGAN + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def one_device(spark):
    """3,000 fixes of one device, newest first, some of them at one time, some at zero, zero."""
    rows = [(7, at(k // 2 * 3), 0.0 if k % 50 == 0 else 10 + k * 1e-4, 0.0 if k % 50 == 0 else 20.0, k) for k in range(3000)]
    return rows, spark.createDataFrame(rows[::-1], FIX)


@pytest.mark.parametrize("batches", [1, 3])
def test_thresholds_do_not_depend_on_batches(spark, one_device, batches):
    rows, df = one_device
    want, last = [], None
    for _, ts, lat, lon, k in sorted(rows, key=lambda r: (r[1], r[4])):
        t = (ts - BEGAN).total_seconds()
        if (lat, lon) != (0, 0) and (last is None or t - last[0] >= 5 and O.metres(last[1], last[2], lat, lon) >= 25):
            last = (t, lat, lon)
            want.append(k)
    with O.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}):
        got = O.run_to_end(O.thresholded(O.replayed(df, "fixes", batches), "10 days"), "thresholds")
        assert sorted(r.event_id for r in got.collect()) == want


def test_spacing_of_a_stream_keeps_the_order_of_time(spark, one_device):
    rows, df = one_device
    want, free = {}, 0.0
    for _, ts, _, _, k in sorted(rows, key=lambda r: (r[1], r[4])):
        free = want[k] = max(ts.timestamp(), free)
        free += 2.0
    got = {r.event_id: r.emit_t for r in O.run_to_end(O.spaced(O.replayed(df, "requests"), "10 days", 2.0), "spaced").collect()}
    assert got == pytest.approx(want)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame([(1, at(s), 1.0, 1.0, k) for s, k in rows], FIX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(FIX).parquet(f"{tmp_path}/in")
        return sorted((r.n, r.event_id) for r in O.run_to_end(O.debounced(stream, "10 seconds", "5 seconds"), "late", f"{tmp_path}/run").collect())

    put((0, 1), (3, 2), (100, 3))
    assert run() == [(2, 2)]
    put((50, 4), (93, 5), (104, 6))  # the first is behind the watermark of 90 s; the second is not, and the third goes on with a burst
    assert run() == [(2, 2)]
    put((200, 7))
    assert run() == [(1, 5), (2, 2), (2, 6)]


def test_stale_answers(spark):
    rng = random.Random(4)
    asked = [(d, at(rng.randrange(5000)), k) for k, d in enumerate(rng.choices(range(5), k=200))]
    came = [(d, ts + timedelta(seconds=k * 37 % 300), k, ts) for d, ts, k in asked]
    want = {k for d, ts, k, q_ts in came if not any(e == d and (q_ts, k) < (o, j) and o <= ts for e, o, j in asked)}
    q = O.replayed(spark.createDataFrame(asked, "device long, ts timestamp, event_id long"), "q").withColumnRenamed("event_id", "query_id")
    a = O.replayed(spark.createDataFrame(came, "device long, ts timestamp, event_id long, asked_ts timestamp"), "a").withColumnRenamed("event_id", "query_id")
    assert {r.query_id for r in O.run_to_end(O.current_answers(q, a, "2 hours", "300 seconds"), "stale").collect()} == want != set(range(200))


def test_latest_fix_goes_on_after_a_restart(spark, tmp_path):
    rows = [(k % 4, at(k * 7919 % 1000), 1.0 + k, 2.0, k) for k in range(200)] + [(1, at(5000), 0.0, 0.0, 900)]
    table = KeyedTable(spark, f"file://{tmp_path}/table", "device", spark.createDataFrame([], FIX).schema, buckets=3)
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, FIX).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = L.latest(spark.readStream.schema(FIX).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"))
        keep_up_to_date(stream, table, F.struct("ts", "event_id"), f"{tmp_path}/state")
    want = sorted(L.latest(spark.createDataFrame(rows, FIX)).collect())
    assert sorted(table.read().collect()) == want
    last = table.manifest()["version"]
    assert not table.upsert(spark.createDataFrame([(1, at(9000), 5.0, 5.0, 999)], FIX), last, F.struct("ts", "event_id"))  # a batch that comes again
    assert sorted(table.read().collect()) == want


def test_ids_go_on_and_a_half_written_batch_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", spark.createDataFrame([], "k long, v string").schema, buckets=4, ids="id", place="k")
    assert table.read().count() == 0 and table.manifest()["next_id"] == 1
    batch = lambda lo, hi, v: spark.createDataFrame([(k, v) for k in range(lo, hi)], "k long, v string")
    table.upsert(batch(0, 50, "a"), 0, F.col("v"))
    publish, table._publish = table._publish, lambda manifest: 1 / 0
    with pytest.raises(ZeroDivisionError):
        table.upsert(batch(40, 80, "b"), 1, F.col("v"))
    table._publish = publish
    assert table.read().where("v = 'b'").count() == 0
    table.upsert(batch(40, 70, "b"), 1, F.col("v"))
    table.upsert(batch(40, 70, "c"), 1, F.col("v"))
    table.upsert(spark.createDataFrame([], "k long, v string"), 2, F.col("v"))
    assert sorted(table.read().collect()) == [(k, "a" if k < 40 else "b", k + 1) for k in range(70)]
    assert table.manifest()["next_id"] == 71 and table.manifest()["version"] == 2


def test_one_spacing_for_all(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2000), k) for k in range(997)] + [(None, 5000)]
    want, free = {}, -1
    for t, k in sorted(rows[:-1]):
        want[k] = max(t, free)
        free = want[k] + 3
    df = spark.createDataFrame(rows, "t long, event_id long").repartition(5)
    got = spacing.spaced(df, 3)
    assert {r.event_id: r.emit_t for r in got.collect()} == want
    assert spacing.spaced(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("disk_ttl", [0, 40])
def test_cache_replay_against_a_plain_cache(spark, disk_ttl):
    rng = random.Random(disk_ttl)
    log = [(rng.choice([0, 0, 0, rng.randrange(6)]), rng.randrange(400), k, rng.random() < 0.4 or None) for k in range(900)] + [(9, -3, 901, False)]
    want, tiles = {}, {}
    for tile, t, k, failed in sorted(log, key=lambda r: (r[1], r[2])):
        stored, fetch = tiles.get(tile, (None, None))
        if fetch and t >= fetch[0]:  # it has ended
            stored, fetch = (stored if fetch[1] else fetch[0]), None
        if stored is not None and t - stored < 15:
            want[k] = "mem-hit"
        elif stored is not None and (disk_ttl == 0 or t - stored < disk_ttl):
            want[k] = "disk-hit"
        elif fetch:
            want[k] = "wait-error" if fetch[1] else "wait-hit"
        else:
            want[k], fetch = "miss", (t + 4, bool(failed))
        tiles[tile] = (stored, fetch)
    df = spark.createDataFrame([*log, (None, 1, 902, False), (1, None, 903, False)], "tile long, t long, event_id long, failed boolean")
    out = tilecache.outcomes(df, 60, 4, 15, disk_ttl)
    assert {r.event_id: r.outcome for r in out.collect()} == want and set(want.values()) >= {"miss", "mem-hit", "wait-hit", "wait-error"}
    assert tilecache.counters(out).first().misses == list(want.values()).count("miss")
    assert tilecache.outcomes(df.limit(0), 60, 4, 15, disk_ttl).count() == 0


@pytest.mark.parametrize("most", [1, 5, 400])
def test_evictions_against_a_plain_cache(spark, most):
    rng = random.Random(most)
    log = [(rng.choice([0, 0, rng.randrange(60)]), rng.randrange(300), k, rng.random() < 0.3) for k in range(700)]
    want, memory, disk, flights, evicting = {}, {}, set(), [], set()

    def land(until):
        while flights and flights[0][0] <= until:
            at, k, tile, failed = heapq.heappop(flights)
            if not failed:
                memory[tile] = at
                disk.add(tile)
                if len(memory) > most:
                    del memory[next(iter(memory))]  # stored first
                    evicting.add(k)

    for tile, t, k, failed in sorted(log, key=lambda r: (r[1], r[2])):
        land(t)
        flight = next((f for f in flights if f[2] == tile), None)
        if tile in memory and t - memory[tile] < 150:
            want[k] = "mem-hit"
        elif tile in disk:
            want[k] = "disk-hit"
        elif flight:
            want[k] = "wait-error" if flight[3] else "wait-hit"
        else:
            want[k] = "miss"
            heapq.heappush(flights, (t + 4, k, tile, failed))
    land(10**9)
    df = spark.createDataFrame([*log, (None, 1, 902, False)], "tile long, t long, event_id long, failed boolean").repartition(3)
    out = tilecache.limited(tilecache.outcomes(df, 60, 4, 150), 4, most)
    rows = out.collect()
    assert {r.event_id: r.outcome for r in rows} == want and {r.event_id for r in rows if r.evicts} == evicting
    assert tilecache.counters(out).first().evictions == len(evicting) == max(0, len(disk) - most)
    assert tilecache.limited(tilecache.outcomes(df.limit(0), 60, 4, 150), 4, most).count() == 0
