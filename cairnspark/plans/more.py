"""Queries on lists in the list's tolerance, rebuilding, import plans, settings, typed texts, and the geocoder's cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.functions import scalars as S
from cairnspark.functions import tagquery as Q
from cairnspark.operators import mutations as K
from cairnspark.operators import retention as R
from cairnspark.operators import suggest as U
from cairnspark.operators import tagging as A
from cairnspark.operators import tilecache
from cairnspark.operators.identity import LIST_TOLERANCE
from cairnspark.plans import fixtures as X
from cairnspark.plans.exchange import FOLD
from cairnspark.plans.registry import points, query
from cairnspark.plans.timed import OUTCOMES, RULE, accesses
from cairnspark.sources import gpx

MOVED = "lat + 5e-10 AS lat, lon - 5e-10 AS lon"


@query(f"""SELECT w.ord, coalesce(r.name || '?', w.name) AS name FROM wp w LEFT JOIN (SELECT o.name, (SELECT min(v.ord) FROM wp v WHERE v.name = o.name AND abs(v.lat - o.lat) < 1e-9 AND abs(v.lon - o.lon) < 1e-9) AS hit
    FROM (SELECT name, {MOVED} FROM wp WHERE bookmark) o) r ON r.hit = w.ord""")
def list_rename_first(s, d):
    """Every bookmark renamed by a request whose coordinates differ by less than the list's tolerance."""
    asked = points(s, d).where("bookmark").selectExpr("name", *MOVED.split(", "), "name || '?' AS new_name")
    return K.first_renamed(points(s, d), asked, LIST_TOLERANCE).select("ord", "name")


@query(f"SELECT ord FROM waypoint w WHERE NOT EXISTS (SELECT 1 FROM (SELECT name, {MOVED} FROM waypoint WHERE ord % 3 = 0) g WHERE g.name = w.name AND abs(g.lat - w.lat) < 1e-9 AND abs(g.lon - w.lon) < 1e-9)")
def list_delete_every(s, d):
    """All matches of every third point, copies included, go from the list before it is merged."""
    gone = X.waypoints(s, d).where(F.col("ord") % 3 == 0).selectExpr("name", *MOVED.split(", "))
    return K.deleted(X.waypoints(s, d), gone, LIST_TOLERANCE).select("ord")


FILED = "SELECT 0 AS source_rank, 'bookmarks.gpx' AS path, ord AS pos, name, lat, lon FROM waypoint WHERE bookmark UNION ALL SELECT 1, CASE WHEN ord % 2 = 0 THEN 'a/' ELSE 'a-b/' END || (ord % 13) || '.gpx', ord, name, lat, lon FROM waypoint WHERE NOT bookmark"


@query(f"SELECT source_rank, path, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY name, CAST(round(lat*1e6) AS BIGINT), CAST(round(lon*1e6) AS BIGINT) ORDER BY source_rank, string_split(path, '/'), pos) AS rn FROM ({FILED})) WHERE rn = 1")
def rebuild_list(s, d):
    """Bookmarks and all other files, the first of each place."""
    w = X.waypoints(s, d)
    path = F.concat(F.when(F.col("ord") % 2 == 0, "a/").otherwise("a-b/"), (F.col("ord") % 13).cast("string"), F.lit(".gpx"))
    rows = lambda df, rank, p: df.select(F.lit(rank).alias("source_rank"), p.alias("path"), F.col("ord").alias("pos"), "name", "lat", "lon")
    return gpx.rebuilt(rows(w.where("bookmark"), 0, F.lit("bookmarks.gpx")), rows(w.where("not bookmark"), 1, path)).select("source_rank", "path", "pos", "name")


OFFERED = "SELECT DISTINCT '/' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'a-b' END || '/f' || (c_custkey // 4) || '.gpx' AS path, 'f' || (c_custkey // 4) || '.gpx' AS base, c_custkey // 4 % 5 = 0 AS known FROM customer"


@query(f"SELECT path, base FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY string_split(path, '/')) AS rn FROM ({OFFERED})) WHERE known OR rn > 1")
def import_skipped(s, d):
    """The files that an import leaves out: their base name is there, or came before."""
    k = F.col("c_custkey")
    number = F.floor(k / 4).cast("string")
    files = X.table(s, d, "customer").select(F.concat(F.lit("/"), F.when(k % 2 == 0, "a").otherwise("a-b"), F.lit("/f"), number, F.lit(".gpx")).alias("path"))
    there = X.table(s, d, "customer").where(F.floor(k / 4) % 5 == 0).select(F.concat(F.lit("f"), number, F.lit(".gpx")).alias("base"))
    return K.skipped(K.import_plan(files, there))


@query(f"""SELECT name, lat, lon, string_agg(tag, '|' ORDER BY {FOLD}, tag) AS raw, count(*) AS n FROM (SELECT DISTINCT name, lat, lon, tag FROM (SELECT * FROM waypoint_tags UNION ALL SELECT name, lat, lon, 'Coffee' FROM waypoint_tags WHERE tag = 'coffee')
    WHERE tag <> 'todo') GROUP BY name, lat, lon HAVING max(CASE WHEN tag = 'coffee' THEN 1 ELSE 0 END) = 1 OR (name, lat, lon) IN (SELECT (name, lat, lon) FROM waypoint_tags WHERE tag = 'todo')""")
def tag_replies(s, d):
    """What is said of places after one tag more (a likeness of another) or less."""
    tags = X.waypoint_tags(s, d)
    more, less = tags.where("tag = 'coffee'").withColumn("tag", F.lit("Coffee")), tags.where("tag = 'todo'")
    now = A.deleted(A.inserted(tags, more), less)
    out = A.replies(now, more.unionByName(less))
    return out.select("name", "lat", "lon", F.array_join(F.transform("tags", lambda t: t["raw"]), "|").alias("raw"), F.size("tags").cast("long").alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 50 >= 1 THEN (event_id % 50) * 60e0 + user_id ELSE CASE WHEN user_id >= 60 THEN user_id ELSE 3600e0 END END WHEN 1 THEN 3600e0 WHEN 2 THEN (user_id + 1) * 5400e0 ELSE 3600e0 END AS ttl,
    CASE WHEN event_id % 3 = 0 THEN 20000 WHEN event_id >= 100 THEN event_id ELSE 20000 END AS entries FROM events""")
def settings_read(s, d):
    """Settings as texts: durations of a minute at least, numbers of a hundred at least; others leave the default."""
    k, u = F.col("event_id"), F.col("user_id")
    text = F.when(k % 4 == 0, F.concat((k % 50).cast("string"), F.lit("m"), u.cast("string"), F.lit("s"))).when(k % 4 == 1, F.concat(F.lit("-"), u.cast("string"), F.lit("h"))).when(k % 4 == 2, F.concat(((u + 1) * 1.5).cast("string"), F.lit("h"))).otherwise(F.concat(u.cast("string"), F.lit(" m")))
    number = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
    return X.table(s, d, "events").select("event_id", S.setting(text, 3600.0, least=60.0).alias("ttl"), S.whole_setting(number, 20_000, 100).alias("entries"))


TYPED = "CASE event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' tag:' || event_type || ' and x' WHEN 2 THEN 'TAG:' || event_type WHEN 3 THEN event_type || ' AND b' WHEN 4 THEN 'tag:\"' || event_type || '\"' WHEN 5 THEN 'tag' END"


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'recent' WHEN 6 THEN 'recent' WHEN 1 THEN 'backendTagSuggest' WHEN 4 THEN 'backendTagSuggest' WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'noop' ELSE 'tagFetchDistinct' END ELSE 'backendSuggest' END AS route FROM events")
def typed_routes(s, d):
    """What each typed text asks for; a null one is empty."""
    text = F.expr(TYPED)
    return X.table(s, d, "events").select("event_id", Q.route_of(text, F.col("user_id") % 2 == 0).alias("route"))


ASKS = "SELECT event_id AS id, event_type || '-' || user_id AS query, event_id % 5 AS most, ts AS came FROM events"


@query(f"""SELECT id, pos, display_name, lat FROM (SELECT a.id, a.query || ' ' || k AS display_name, CASE WHEN k = 1 THEN 0e0 ELSE k + 0.5e0 END AS lat, row_number() OVER (PARTITION BY a.id ORDER BY k) - 1 AS pos, a.most
    FROM ({ASKS}) a JOIN (SELECT query, arg_min(most, (came, id)) AS stored FROM ({ASKS}) WHERE most > 0 GROUP BY query) f USING (query), range(6) r(k) WHERE k < stored AND k <> 2 AND a.most > 0) WHERE pos < most""")
def geocode_limits(s, d):
    """Requests through the geocoder's cache: the first of a query decides how many rows are stored; a third row has a blank name, a second an unreadable latitude."""
    e = X.table(s, d, "events")
    q = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    asks = e.select(F.col("event_id").alias("id"), q.alias("query"), (F.col("event_id") % 5).cast("int").alias("limit"), F.col("ts").alias("at"))
    row = lambda k: F.struct(F.when(k == 2, "").otherwise(F.concat("query", F.lit(" "), k.cast("string"))).alias("display_name"), F.when(k == 1, "x").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("lat"), F.lit("1").alias("lon"), F.lit("place").alias("class"), F.lit("city").alias("type"))
    answers = asks.select("query").distinct().withColumn("answer", F.transform(F.sequence(F.lit(0), F.lit(5)), row))
    return U.geocoded(asks, answers).select("id", "pos", "display_name", "lat")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 4 = 0 THEN 2 ELSE 3 END AS attempts, 'https://geo.example.org' AS server FROM events")
def geocode_attempts(s, d):
    """Requests that fail in a transient way are made again, twice at most; and the server's address without slashes at its end."""
    k = F.col("event_id")
    first = F.when(k % 3 == 0, "status 500").otherwise("unexpected end of JSON input")
    second = F.when(k % 4 == 0, None).otherwise("read: EOF")
    return X.table(s, d, "events").select("event_id", U.attempts(F.array(first, second, F.lit("EOF")), 2).alias("attempts"), S.server_url(F.concat(F.lit("https://geo.example.org"), F.repeat(F.lit("/"), (k % 3).cast("int")))).alias("server"))


@query(f"SELECT 21600 AS memory_ttl, -1 AS disk_ttl, count(*) FILTER (outcome IN ('mem-hit', 'disk-hit')) AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM {OUTCOMES.replace('+ 108000', '+ 100000000000')}")
def cache_stats_row(s, d):
    """The counters' row of a cache whose disk keeps everything, for which the time to live is -1."""
    rule = RULE | {"disk_ttl": 0}
    row = tilecache.counters(tilecache.outcomes(accesses(s, d), 4 * 86_400, **rule))
    return row.select(F.lit(R.shown_ttl(rule["memory_ttl"])).alias("memory_ttl"), F.lit(R.shown_ttl(rule["disk_ttl"])).alias("disk_ttl"), "hits", "misses")
