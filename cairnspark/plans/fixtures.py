"""Relations of the point domain, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ["*", "⭐", "$$", "home", "🏠", "Home", "coffee", "☕", "todo", "diving"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat(k: Column) -> Column:
    return (k * 7919 % 170001) / F.lit(1000.0) - 85.0


def lon(k: Column) -> Column:
    return (k * 104729 % 360001) / F.lit(1000.0) - 180.0


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    c, e = table(spark, sf, "customer"), table(spark, sf, "events")
    k, u = F.col("c_custkey"), F.col("user_id")
    own = c.select(k.alias("ord"), F.col("c_name").alias("name"), lat(k).alias("lat"), lon(k).alias("lon"), F.col("c_acctbal").alias("ele"), (k % 10 == 0).alias("bookmark"))
    fixes = e.select((F.col("event_id") + 1000000).alias("ord"), F.concat_ws("-", "event_type", u.cast("string")).alias("name"), lat(u).alias("lat"), lon(u).alias("lon"), F.col("value").alias("ele"), F.lit(False).alias("bookmark"))
    return own.unionByName(fixes)


def waypoint_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    tags = F.array(F.element_at(F.array(*map(F.lit, TAGS)), (k % 10 + 1).cast("int")), F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_name").alias("name"), lat(k).alias("lat"), lon(k).alias("lon"), F.explode(tags).alias("tag"))


def search_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")).alias("query"), F.when(F.col("event_type") != "error", F.col("value")).alias("lat"), F.col("ts").alias("at"))


def geocode_cache(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_name")
    row = lambda *pairs: F.concat(F.lit("{"), *pairs, F.lit("}"))
    one = row(F.lit('"display_name":"'), n, F.lit(' City","lat":'), F.col("n_nationkey").cast("string"), F.lit('.5,"lon":'), F.col("n_regionkey").cast("string"), F.lit('.25,"class":"place","type":"city"'))
    two, three = row(F.lit('"display_name":"","lat":1')), row(F.lit('"display_name":"'), n, F.lit(' Only"'))
    return table(spark, sf, "nation").select(F.lower(n).alias("query"), F.concat(F.lit("["), F.concat_ws(",", one, two, three), F.lit("]")).alias("json"))


def tile_files(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    end = F.when(p % 50 == 0, ".jpg").otherwise(".png")
    path = F.concat(F.lit("/api/tiles/"), F.concat_ws("/", (p % 6).cast("string"), (p * 31 % 64).cast("string"), (p * 17 % 64).cast("string")), end)
    return table(spark, sf, "pages").select(p, path.alias("path"), F.length("html").cast("bigint").alias("bytes"), p.alias("mtime"))


def location_fixes(spark: SparkSession, sf: str) -> DataFrame:
    e, u = table(spark, sf, "events"), F.col("user_id")
    lost = F.col("event_id") % 20 == 0
    at = lambda c: F.when(lost, F.lit(0.0)).otherwise(c)
    return e.select(u.alias("device"), "ts", at(lat(u) + F.col("value") * 1e-5).alias("lat"), at(lon(u)).alias("lon"), F.lit(10.0).alias("accuracy_m"), "event_id", "value")


def tile_access(spark: SparkSession, sf: str) -> DataFrame:
    """An access log: what is known of a tile when it is asked for."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(k, (k % 97).alias("tile"), "ts", F.when(k % 3 == 0, k * 7 % 7200).alias("mem_age"), F.when(k % 4 == 0, k * 11 % 100000).alias("disk_age"), (k % 13 == 0).alias("in_flight"))


#: The same relations as SQL, by name; put in front of a query by oracle().
LAT, LON = "(({k}*7919) % 170001)/1000e0 - 85e0", "(({k}*104729) % 360001)/1000e0 - 180e0"
_LAT, _LON = (lambda k: LAT.format(k=k)), (lambda k: LON.format(k=k))
SQL = {
    "waypoint": f"SELECT c_custkey AS ord, c_name AS name, {_LAT('c_custkey')} AS lat, {_LON('c_custkey')} AS lon, c_acctbal AS ele, c_custkey % 10 = 0 AS bookmark FROM customer UNION ALL SELECT 1000000 + event_id, event_type || '-' || user_id, {_LAT('user_id')}, {_LON('user_id')}, value, false FROM events",
    "wp": "SELECT ord, name, lat, lon, ele, bookmark FROM (SELECT *, row_number() OVER (PARTITION BY name, CAST(round(lat*1e6) AS BIGINT), CAST(round(lon*1e6) AS BIGINT) ORDER BY ord) AS rn FROM waypoint) WHERE rn = 1",
    "waypoint_tags": f"SELECT c_name AS name, {_LAT('c_custkey')} AS lat, {_LON('c_custkey')} AS lon, [{', '.join(repr(t) for t in TAGS)}][CAST(c_custkey % 10 + 1 AS INT)] AS tag FROM customer UNION ALL SELECT c_name, {_LAT('c_custkey')}, {_LON('c_custkey')}, lower(c_mktsegment) FROM customer",
    "search_history": "SELECT event_id AS id, event_type || ' ' || (user_id % 50) AS query, CASE WHEN event_type <> 'error' THEN value END AS lat, ts AS at FROM events",
    "geocode": "SELECT query, pos, display_name, lat, lon, class, type FROM (SELECT lower(n_name) AS query, 0 AS pos, n_name || ' City' AS display_name, n_nationkey + 0.5e0 AS lat, n_regionkey + 0.25e0 AS lon, 'place' AS class, 'city' AS type FROM nation UNION ALL SELECT lower(n_name), 2, n_name || ' Only', 0e0, 0e0, '', '' FROM nation)",
    "tile_file": "SELECT page_id, '/api/tiles/' || (page_id % 6) || '/' || (page_id*31 % 64) || '/' || (page_id*17 % 64) || CASE WHEN page_id % 50 = 0 THEN '.jpg' ELSE '.png' END AS path, CAST(length(html) AS BIGINT) AS bytes, page_id AS mtime FROM pages",
    "location_fix": f"SELECT user_id AS device, ts, CASE WHEN event_id % 20 = 0 THEN 0e0 ELSE {_LAT('user_id')} + value*1e-5 END AS lat, CASE WHEN event_id % 20 = 0 THEN 0e0 ELSE {_LON('user_id')} END AS lon, event_id, value FROM events",
    "tile_access": "SELECT event_id, event_id % 97 AS tile, ts, CASE WHEN event_id % 3 = 0 THEN event_id*7 % 7200 END AS mem_age, CASE WHEN event_id % 4 = 0 THEN event_id*11 % 100000 END AS disk_age, event_id % 13 = 0 AS in_flight FROM events",
}


def oracle(sql: str) -> str:
    """sql behind the relations that it names, and those that these name."""
    used: list[str] = []

    def add(text: str) -> None:
        for name, body in SQL.items():
            if name not in used and any(w in text for w in (f" {name} ", f" {name})", f" {name},", f" {name}\n")) or text.endswith(f" {name}") and name not in used:
                add(body)
                used.append(name)

    add(sql)
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in used) + " " if used else "") + sql
