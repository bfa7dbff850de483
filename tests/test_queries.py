"""Every query against its SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairnspark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in records)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name == "tag_query_mixed"  # its second term is no tag
    if name in ORACLE_SQL:
        out = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count()


def test_gpx_of_all_points(spark):
    n = QUERIES["merge_dedupe"](spark, SF).count()
    assert QUERIES["gpx_roundtrip"](spark, SF).count() == QUERIES["gpx_text"](spark, SF).count() == n > 201


def test_changes_reach_waypoints_of_events(spark):
    gone = QUERIES["merge_dedupe"](spark, SF).join(QUERIES["bookmark_delete"](spark, SF), "ord", "left_anti")
    assert gone.where("ord > 1000000").count() and QUERIES["bookmark_duplicates"](spark, SF).where("ord > 1000000").count()


def test_matches_across_cells_and_common_names(spark):
    """Every pair within the tolerance meets, also at the edges of cells, and none beyond it."""
    from cairnspark.operators import identity as I

    at = [k * 2.5e-7 + edge for edge in (0.0, 0.001, -0.001, 179.999) for k in range(-6, 7)]
    rows = [(n, "Home" if n % 9 else None, a, b) for n, (a, b) in enumerate((a, b) for a in at[::2] for b in at[1::2])]
    df = spark.createDataFrame(rows, "ord long, name string, lat double, lon double")
    moved = df.where("ord % 7 = 0").withColumn("lat", df.lat + 9e-7)
    sure = moved.alias("m").crossJoin(df.alias("d")).where(I.near("d", "m", 1e-6)).select("d.ord").distinct()
    want = {r.ord for r in sure.collect()}
    assert want and want == {r.ord for r in I.matching(df, moved, 1e-6).collect()}
    assert {r[0] for r in rows} - want == {r.ord for r in I.matching(df, moved, 1e-6, "left_anti").collect()}


def test_numbers_over_blocks(spark):
    from pyspark.sql import functions as F

    from cairnspark.operators import identity as I

    df = spark.createDataFrame([(k * 7 % 1000,) for k in range(1000)], "pos long")
    assert all(r.number == r.pos + 1 for r in I.numbered(df, F.floor(F.col("pos") / 64), "pos").collect())
    assert I.numbered(df.limit(0), F.col("pos"), "pos").count() == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from cairnspark.sources.shared import shared_folder

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))), "x")
