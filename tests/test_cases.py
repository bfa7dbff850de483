"""Literal cases of requests, completions, files and lists."""

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import tagquery as Q
from cairnspark.functions import tags as G
from cairnspark.operators import bodies as B
from cairnspark.operators import identity as I
from cairnspark.operators import mutations as K
from cairnspark.operators import spatial as P
from cairnspark.operators import suggest as U
from cairnspark.operators import tagging as A
from cairnspark.sources import gpx
from cairnspark.streaming import location as L

VOCABULARY = ["*", "**", "***", "$", "$$", "$$$", "###", "!!", "!!*", "@", "@@", "@@@", "abc", "abc*", "star$", "mixed-01"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(k, t, t) for k, t in enumerate(VOCABULARY)], "pos int, raw string, display string")


@pytest.mark.parametrize(
    "query, has, lacks",
    [
        ("tag:***", ["***"], ["**", "*"]), ("tag:**", ["**", "***"], ["*"]), ("tag:*", ["*", "**", "***"], []), ("tag:$$$", ["$$$"], ["$$", "$"]), ("tag:$$", ["$$", "$$$"], ["$"]), ("tag:$", ["$", "$$", "$$$"], []),
        ("tag:###", ["###"], ["#", "##"]), ("tag:!!", ["!!", "!!*"], []), ("tag:@@", ["@@", "@@@"], []), ("tag:ab", ["abc", "abc*"], ["star$"]), ("tag:abc", ["abc", "abc*"], []), ("tag:star$", ["star$"], ["$"]), ("tag:", ["*"], []),
    ],
)
def test_completions(vocab, query, has, lacks):
    got = {r.raw for r in A.completions(vocab, query).collect()}
    assert got >= set(has) and not got & set(lacks)


def search(spark, server="https://geo.example.org", **fields):
    text = ("q", "street", "city", "county", "state", "postalcode", "accept_language", "viewbox", "email")
    flags = ("bounded", "polygon", "addressdetails", "polygon_geojson", "polygon_kml", "polygon_svg", "polygon_text")
    kinds = {**dict.fromkeys(text, "string"), **dict.fromkeys(flags, "boolean"), "countrycodes": "array<string>", "exclude_place_ids": "array<string>", "limit": "int"}
    row = spark.createDataFrame([tuple(fields.get(c) for c in kinds)], ", ".join(f"{c} {k}" for c, k in kinds.items()))
    url, error = U.full_search_url(server)
    return row.select(url.alias("url"), error.alias("error"), U.uses_fields().alias("fields")).first()


def test_search_requests(spark):
    whole = {"city": "Berlin", "street": "Karl-Marx-Allee", "county": "Berlin", "state": "Germany", "postalcode": "012345"}
    assert "q=Berlin" in search(spark, q="Berlin").url and not search(spark, q="Berlin").fields
    got = search(spark, **whole)
    assert all(f"{k}={v}" in got.url for k, v in whole.items()) and got.fields
    assert search(spark).url is None and "is needed" in search(spark).error
    both = search(spark, q="x", **whole)
    assert "q=x" in both.url and "city=" not in both.url
    assert "limit=123" in search(spark, q="Berlin", limit=123).url and "limit" not in search(spark, q="Berlin", limit=0).url
    assert search(spark, server="", q="x").error == "no server is set"
    assert "countrycodes=de%2Cfr" in search(spark, q="x", countrycodes=["de", "fr"]).url and "exclude_place_ids" not in search(spark, q="x", exclude_place_ids=[]).url


def reverse(spark, server="https://geo.example.org", **fields):
    base = {"osm_type": None, "osm_id": None, "lat": "52.5170365", "lon": "13.3888599", "zoom": 18, "address_details": True} | fields
    row = spark.createDataFrame([tuple(base.values())], "osm_type string, osm_id string, lat string, lon string, zoom int, address_details boolean")
    url, error = U.reverse_url(server)
    return row.select(url.alias("url"), error.alias("error")).first()


def test_reverse_requests(spark):
    assert "lat=52.5170365" in reverse(spark).url and "lon=13.3888599" in reverse(spark).url
    assert reverse(spark, server="").error == "no server is set"
    assert reverse(spark, osm_type="V").error == "OsmType must be 'N', 'W' or 'R'" and reverse(spark, osm_type="R").error is None
    assert "latitude" in reverse(spark, lat="").error and "longitude" in reverse(spark, lon=None).error
    assert "1337 is out of range" in reverse(spark, zoom=1337).error and reverse(spark, zoom=13).error is None


def test_gpx_files(spark, tmp_path):
    points = spark.createDataFrame([("a & b", 0.00001, -12345678.5, "2024-01-01T02:00:00.75+02:00", None, False), ("gone", 1.0, 2.0, "", "", True)], "name string, lat double, lon double, time string, desc string, deleted boolean")
    path = f"{tmp_path}/out"
    gpx.write_gpx(points.coalesce(1), path)
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".gpx"]
    assert len(files) == 1 and 'lat="0.000010"' in files[0].read_text() and 'lon="-12345678.500000"' in files[0].read_text() and "gone" not in files[0].read_text()
    r = gpx.read_gpx(spark, path).collect()
    assert [(x.name, x.lat, x.lon, x.time, x.ele, x.desc) for x in r] == [("a & b", 1e-5, -12345678.5, "2024-01-01T00:00:00Z", 0.0, "")]


def test_gpx_folders(spark, tmp_path):
    one = '<gpx><wpt lat="1" lon="2"><name>{}</name></wpt></gpx>'
    texts = {
        "bookmarks.gpx": one.format("kept"), "marks.gpx": one.format("out"), "upper.GPX": one.format("upper"), "sub/deep.gpx": one.format("deep"), "cut.gpx": one.format("cut")[:40], "bad.gpx": one.format("bad").replace('"1"', '"north"'),
        "spaced.gpx": one.format("spaced").replace("</gpx>", "</gpx >\n"), "prefixed.gpx": '<g:gpx xmlns:g="http://www.topografix.com/GPX/1/1"><g:wpt lat="3" lon="4"><g:name>prefixed</g:name></g:wpt></g:gpx>', "note.txt": one.format("text"),
    }
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    names = lambda **k: {r.name for r in gpx.read_gpx(spark, str(tmp_path), exclude=f"{tmp_path}/marks.gpx", **k).collect()}
    assert names() == {"kept", "upper", "deep", "spaced", "prefixed"} and names(recursive=False) == names() - {"deep"}


def test_tiles(spark, tmp_path):
    for name in ("3/1/2.png", "3/1/5.png", "3/1/note.png", "3/1/2.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 7)
    assert sorted((r.z, r.x, r.y, r.bytes) for r in gpx.read_tiles(spark, str(tmp_path)).collect()) == [(3, 1, 2, 7), (3, 1, 5, 7)]


def test_merging(spark):
    a = spark.createDataFrame([(0, "p", 1.0, 2.0), (1, "q", 1.0, 2.0)], "ord int, name string, lat double, lon double")
    both = I.merged(a, a)
    assert both.count() == 4 and [r.source_rank for r in I.first_of_each(both, "source_rank", "ord").collect()] == [0, 0]
    assert P.index_of(a, "q", 1.0, 2.0).first().ord == 1 and P.index_of(a, "q", 1.1, 2.0).first().ord == -1


def test_lists(spark):
    p = spark.createDataFrame([(0, "p", 1.0, 2.0, True, ["a"]), (1, "p", 1.0, 2.0, True, ["b"]), (2, "q", 1.0, 2.0, False, None)], "ord long, name string, lat double, lon double, bookmark boolean, tags array<string>")
    who = spark.createDataFrame([("p", 1.0, 2.0, ["c"])], "name string, lat double, lon double, tags array<string>")
    assert [r.ord for r in K.first_deleted(p, who, I.LIST_TOLERANCE).orderBy("ord").collect()] == [1, 2]
    assert [r.tags for r in K.tags_replaced(p, who, I.LIST_TOLERANCE).orderBy("ord").collect()] == [["c"], ["b"], None]
    assert {r.ord for r in P.effective(p, None, True).collect()} == {0, 1} and P.effective(p, p.where("ord = 2"), True).count() == 1
    assert K.with_time(p.select("ord", F.lit("").alias("time")), "now").first().time == "now"
    tagged = A.filter_of(p.fillna({"name": ""}).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), "tag: A")
    assert [r.ord for r in tagged.collect()] == [0]
    rest = p.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    assert all(A.filter_of(rest, q) is None for q in ("a", "tag:", "tag:a AND b", 'tag:"a"', "tag:zzz"))


def test_vocabulary_order(spark):
    tags = spark.createDataFrame([("home",), ("Home",), ("🏠",), ("Zoo",), ("apple",), (" ",)], "tag string")
    assert [r.raw for r in A.listed(tags, emoji=True).collect()] == ["apple", "Home", "Zoo"]
    assert [r.tag for r in A.listed(tags.where("tag <> ' '")).collect()] == ["apple", "Home", "home", "Zoo", "🏠"]
    assert [r.tag for r in A.client_vocabulary(tags).collect()] == ["apple", "Home", "home", "Zoo", "🏠"]
    row = spark.range(1).select(B.tag_entries(F.from_json(F.lit('[{"raw":"a"},null,{"raw":"b","emoji":"x"},{"raw":"c","display":"d"}]'), "array<struct<raw:string,emoji:string,display:string>>")).alias("t")).first()
    assert [t.display for t in row.t] == ["a", "x b", "d"]
    assert spark.range(1).select(G.enriched(F.lit("**")).alias("e")).first().e.display == "⭐⭐"


def test_recent(spark):
    answers = spark.createDataFrame([('{"queries":["a","b","c"]}',)], "body string")
    rows = B.recent_rows(answers)
    assert [r.name for r in B.shown_when_empty(rows, " ", 2).collect()] == ["a", "b"] and B.shown_when_empty(rows, "x").count() == 0
    cache = spark.createDataFrame([("q", "[]", 1)], "query string, json string, fetched_at long")
    assert [r.json for r in U.upserted(cache, cache.selectExpr("query", "'[1]' as json", "2L as fetched_at")).collect()] == ["[1]"]
    assert Q.route("tag:a", False) == "tagFetchDistinct"


def test_answers_of_old_questions(spark):
    asked = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "session string, query_id long")
    assert sorted((r.session, r.query_id) for r in L.current_only(asked, asked).collect()) == [("s", 2), ("t", 1)]
    signals = spark.createDataFrame([("moved", "/a", "x"), ("moved", "/b", "x"), ("moved", "/a", None)], "name string, path string, location string")
    assert L.usable_signal(signals, "moved", "/a").count() == 1
