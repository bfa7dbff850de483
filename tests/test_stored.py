"""The name index, the list in the order of a curve, and the source with offsets."""

import random

import pytest
from pyspark.sql import functions as F

from cairnspark.operators.nameindex import NameIndex
from cairnspark.sources import fixlog
from cairnspark.sources.placed import PlacedList, z_of


def test_index_against_every_name(spark, tmp_path):
    rng = random.Random(2)
    parts = ["Café", "CAFÉ", "bar", "Ü", "new york", "yo", "%", "_a", "İx", " ", "x"]
    rows = [(k, rng.choice([None, "", *("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(9))]), k * 1.5) for k in range(600)] + [(1000 + k, "Same Name", 0.0) for k in range(300)] + [(None, "No Place", 0.0)]
    points = spark.createDataFrame(rows, "ord long, name string, lat double").repartition(5)
    texts = ["", " ", "a", "é", "fé", "afé", "bar", "BARbar", "new y", "York", "%", "_", "zzz", "same name", "e", None, "same name", "ü", " bar ", "yo"]
    got = {}
    for r in NameIndex.build(points, str(tmp_path)).suggest(spark.createDataFrame([(t,) for t in texts], "q string")).collect():
        got.setdefault(r.q, []).append((r["rank"], r.ord, r.lat))
    lower = {r.name: r.l for r in points.select("name", F.lower("name").alias("l")).distinct().collect()}
    for t in set(texts) - {None}:
        hits = sorted((lower[n], n, k, lat) for k, n, lat in rows if n and k is not None and t.strip().lower() in lower[n])[:8]
        assert got.pop(t, []) == [(i + 1, k, lat) for i, (_, _, k, lat) in enumerate(hits)], t
    assert not got


def test_questions_do_not_meet_all_points(spark, tmp_path):
    points = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("point "), F.col("id")).alias("name"))
    index = NameIndex.build(points, str(tmp_path))
    plan = index.suggest(points.select(F.substring("name", -4, 4).alias("q")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(k, f"n{k}", rng.uniform(-85, 85), rng.uniform(-180, 180)) for k in range(4000)] + [(5000 + k, "heap", 12.5, 12.5) for k in range(600)] + [(9000, "lost", None, None)]
    points = spark.createDataFrame(rows, "ord long, name string, lat double, lon double")
    return rows, PlacedList(spark, f"file://{tmp_path_factory.mktemp('placed')}").write(points, 128)


def inside(rows, south, north, west, east):
    return {r[0] for r in rows if r[2] is not None and south <= r[2] <= north and (west <= r[3] <= east if west <= east else r[3] >= west or r[3] <= east)}


def test_a_viewport_reads_few_files(placed):
    rows, at = placed
    for box in ((20, 40, 30, 60), (-85, -60, -180, -150), (0, 10, 175, -175), (12.5, 12.5, 12.5, 12.5), (50, 40, 0, 1)):
        got = at.viewport(*box)
        assert {r.ord for r in got.collect()} == inside(rows, *box)
    assert at.read().count() == len(rows)
    few = at.viewport(20, 30, 30, 45)
    assert len(few.inputFiles()) * 10 < at.files().count()
    assert "PushedFilters: [" in few._jdf.queryExecution().executedPlan().toString()


def test_changes_rewrite_few_files(spark, placed):
    rows, at = placed
    before, n = at.version(), at.files().count()
    gone = [r for r in rows if r[0] in (5, 5003, 5400)]
    new = [(20000, "new", 12.5, 12.5), (20001, "new", -85.0, -179.0)]
    kind = "ord long, name string, lat double, lon double"
    assert at.change(spark.createDataFrame(new, kind), spark.createDataFrame(gone, kind)) * 2 < n
    want = {r[0] for r in rows} - {r[0] for r in gone} | {20000, 20001}
    assert at.version() == before + 1 and sorted(r.ord for r in at.read().collect()) == sorted(want)
    assert {r.ord for r in at.viewport(12.5, 12.5, 12.5, 12.5).collect()} == inside([*rows, *new], 12.5, 12.5, 12.5, 12.5) - {5003, 5400}


def test_the_curve_takes_a_bit_of_each_in_turn(spark):
    got = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (0.0, -180.0), (-90.0, 0.0), (None, 1.0)], "lat double, lon double").select(z_of(F.col("lat"), F.col("lon")).alias("z")).collect()
    assert [r.z for r in got] == [0, (1 << 32) - 1, 1 << 31, 1 << 30, -1]


def test_a_source_with_offsets_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixlog, "ROWS", 7)
    log, where = f"file://{tmp_path}/log", tmp_path / "run"
    fix = lambda lo, hi: spark.range(lo, hi).selectExpr("id % 3 as device", "timestamp_seconds(id) as ts", "1.0 as lat", "2.0 as lon", "id as event_id")
    seen, fail = [], [False]

    def run():
        def put(rows, number):
            seen.append((number, sorted(r.event_id for r in rows.collect())))
            if fail[0]:
                fail[0] = False
                raise ConnectionError

        fixlog.stream(spark, log).writeStream.foreachBatch(put).option("checkpointLocation", str(where)).trigger(availableNow=True).start().awaitTermination()

    assert fixlog.append(fix(0, 20), log) == 20
    run()
    assert fixlog.append(fix(20, 45), log) == 45
    fail[0] = True
    paused = []
    assert fixlog.kept_running(run, 3, paused.append) == 1 and paused == [2]
    run()
    assert [ids for _, ids in seen] == [list(range(20)), list(range(20, 45)), list(range(20, 45))] and seen[1][0] == seen[2][0]
    waits = fixlog.waits()
    assert [next(waits) for _ in range(7)] == [2, 4, 6, 8, 10, 30, 30]
    with pytest.raises(ZeroDivisionError):
        fixlog.kept_running(lambda: 1 / 0, 2, paused.append)
