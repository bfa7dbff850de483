"""Literal cases of settings, typed texts, retries, tag replies and imports."""

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import scalars as S
from cairnspark.functions import tagquery as Q
from cairnspark.operators import mutations as K
from cairnspark.operators import suggest as U
from cairnspark.operators import tagging as A
from cairnspark.sources import gpx


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_durations_and_settings(spark):
    texts = ["90s", "1h30m", "1.5h", "-2m", "+3s", "250ms", ".5m", "0", "", "5", "1h 2m", "h", None, "1d", "2m3", "1µs"]
    got = column(spark, texts, "string", S.duration)
    assert got == pytest.approx([90, 5400, 5400, -120, 3, 0.25, 30, 0, None, None, None, None, None, None, None, 1e-6])
    assert column(spark, ["59s", "60s", None, "-1h"], "string", lambda t: S.setting(t, 3600.0, least=60.0)) == [3600, 60, 3600, 3600]
    assert column(spark, ["0", "1ns", "x"], "string", lambda t: S.setting(t, 12.0, above=0.0)) == [12, 1e-9, 12]
    assert column(spark, ["99", "100", "1e3", "9" * 30, "+200", None], "string", lambda t: S.whole_setting(t, 20_000, 100)) == [20_000, 100, 20_000, 20_000, 200, 20_000]


@pytest.mark.parametrize("loaded", [True, False])
def test_typed_texts_as_a_column_and_one_by_one(spark, loaded):
    texts = ["", "  ", "tag:", "TAG:x", "tag:a and b", "tag:a AND b", "tag:\"a\"", "tag:android", "x AND y", "tag", " tag:a or\tb ", "tag:or b"]
    assert column(spark, texts, "string", lambda t: Q.route_of(t, F.lit(loaded))) == [Q.route(t.strip(), loaded) for t in texts]
    assert column(spark, [None], "string", lambda t: Q.route_of(t, F.lit(loaded))) == ["recent"]


def test_transient_errors_are_tried_again(spark):
    eof, cut, hard = "EOF", "unexpected end of JSON input", "status 500"
    cases = [[None], [eof, None], [eof, eof, eof], [hard, None], [cut, hard, None], [cut, None]]
    assert column(spark, cases, "array<string>", U.attempts) == [1, 2, 2, 1, 2, 2]
    assert column(spark, cases, "array<string>", lambda e: U.attempts(e, 0)) == [1] * 6
    assert column(spark, [[eof] * 6], "array<string>", lambda e: U.attempts(e, 9)) == [2]  # out of bounds: the default


def test_the_first_limit_caps_what_later_requests_get(spark):
    row = "display_name string, lat string, lon string, class string, type string"
    answers = spark.createDataFrame([("q", [("a", "1.5", "2", "c", "t"), ("", "1", "1", "", ""), ("b", "x", None, None, None), ("d", "4", "4", "", "")])], f"query string, answer array<struct<{row.replace(' string', ':string')}>>")
    asks = spark.createDataFrame([(1, "q", 0, 1), (2, "q", 3, 2), (3, "q", 9, 3), (4, "q", 1, 4), (5, "other", 3, 1)], "id long, query string, limit int, at int")
    got = sorted((r.id, r.pos, r.display_name, r.lat, r.lon) for r in U.geocoded(asks, answers).collect())
    assert got == [(2, 0, "a", 1.5, 2.0), (2, 1, "b", 0.0, 0.0), (3, 0, "a", 1.5, 2.0), (3, 1, "b", 0.0, 0.0), (4, 0, "a", 1.5, 2.0)]


def test_replies_enrich_and_do_not_unify(spark):
    tags = spark.createDataFrame([("p", 1.0, 2.0, t) for t in ("home", "🏠", "Home", "zoo")], "name string, lat double, lon double, tag string")
    changed = spark.createDataFrame([("p", 1.0, 2.0), ("bare", 0.0, 0.0), ("p", 1.0, 2.0)], "name string, lat double, lon double")
    got = {r.name: [(t.raw, t.emoji) for t in r.tags] for r in A.replies(tags, changed).collect()}
    assert got["bare"] == [] and sorted(got["p"], key=str) == sorted([("home", "🏠"), ("Home", "🏠"), ("zoo", None), ("🏠", None)], key=str)


def test_rebuilt_and_skipped_files(spark):
    kind = "source_rank int, path string, pos int, name string, lat double, lon double"
    marks = spark.createDataFrame([(0, "b.gpx", 3, "x", 1.0, 1.0)], kind)
    others = spark.createDataFrame([(1, "a/1.gpx", 0, "x", 1.0000001, 1.0), (1, "a/z.gpx", 5, "y", 2.0, 2.0), (1, "a-b/1.gpx", 1, "y", 2.0, 2.0), (1, "a/1.gpx", 9, "y", 2.0, 2.0)], kind)
    assert sorted((r.source_rank, r.path, r.pos) for r in gpx.rebuilt(marks, others).collect()) == [(0, "b.gpx", 3), (1, "a/1.gpx", 9)]
    files = spark.createDataFrame([("/a-b/f.gpx",), ("/a/f.gpx",), ("/c/g.gpx",), ("/d/h.gpx",), ("/d/h.gpx",)], "path string")
    plan = K.import_plan(files, spark.createDataFrame([("g.gpx",)], "base string"))
    assert sorted(map(tuple, K.skipped(plan).collect())) == [("/a-b/f.gpx", "f.gpx"), ("/c/g.gpx", "g.gpx")]
    assert sorted(r.path for r in plan.where("state = 'copied'").collect()) == ["/a/f.gpx", "/d/h.gpx"]
