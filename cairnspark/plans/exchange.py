"""Queries on what the engine exchanges: requests, replies, files, and the client's lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.functions import scalars as S
from cairnspark.functions import tags as G
from cairnspark.operators import bodies as B
from cairnspark.operators import mutations as K
from cairnspark.operators import spatial as P
from cairnspark.operators import suggest as U
from cairnspark.operators import tagging as A
from cairnspark.plans import fixtures as X
from cairnspark.plans.registry import DICT, FOLD, NORMED, SERVER, points, query, r6
from cairnspark.sources import gpx

NOW = "2024-01-02T03:04:05Z"
KEY = "c_custkey"


def _json(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query(f"""SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'name is required' WHEN 2 THEN 'invalid JSON' END AS error, CASE WHEN c_custkey % 7 > 2 THEN c_name END AS name,
    CASE WHEN c_custkey % 7 > 2 THEN c_custkey + 0.5e0 END AS lat, CASE WHEN c_custkey % 7 > 2 THEN 0e0 END AS ele, CASE WHEN c_custkey % 7 > 2 THEN '{NOW}' END AS time, CASE WHEN c_custkey % 7 > 2 THEN true END AS bookmark,
    CASE WHEN c_custkey % 7 > 3 THEN 'a|' || lower(c_mktsegment) END AS tags FROM customer""")
def create_replies(s, d):
    k, name = F.col(KEY), F.col("c_name")
    good = _json('{"name":"', name, '","lat":', k, '.5,"lon":-1.25,"tags":', F.when(k % 7 > 3, _json('["a","', F.lower("c_mktsegment"), '"]')).otherwise("[]"), "}")
    body = F.when(k % 7 == 0, _json('{"name":"', name)).when(k % 7 == 1, '{"name":"  ","lat":1,"lon":2}').when(k % 7 == 2, _json('{"name":"', name, '","lat":"north"}')).otherwise(good)
    rows = B.created(X.table(s, d, "customer").select(k.alias("k"), body.alias("body")), NOW)
    return rows.select("k", "error", "saved.name", "saved.lat", "saved.ele", "saved.time", "saved.bookmark", F.array_join("saved.tags", "|").alias("tags"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'oldName and newName required' END AS rename, CASE WHEN c_custkey % 4 = 0 THEN 'name required' WHEN c_custkey % 6 = 1 THEN 'invalid lat/lon' END AS gone FROM customer""")
def change_errors(s, d):
    k = F.col(KEY)
    old, new = F.when(k % 3 == 0, " ").otherwise(F.col("c_name")), F.when(k % 5 != 0, F.lit("n"))
    name, lat = F.when(k % 4 != 0, F.col("c_name")).otherwise(""), F.when(k % 6 == 1, "12,5").otherwise(k.cast("string"))
    return X.table(s, d, "customer").select(k.alias("k"), B.rename_error(old, new).alias("rename"), B.delete_error(name, lat, F.lit("1e1")).alias("gone"))


@query("""SELECT c_custkey AS k, unnest(['a ' || c_custkey, 'b']) AS query, CAST(NULL AS DOUBLE) AS lat, 2 AS stored, true AS multiple FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_name, c_custkey + 0.25e0, 1, false FROM customer WHERE c_custkey % 3 = 1""")
def history_bodies(s, d):
    k = F.col(KEY)
    body = F.when(k % 3 == 0, _json('{"queries":[" a ', k, ' "," ","b"],"lat":3}')).when(k % 3 == 1, _json('{"query":"', F.col("c_name"), ' ","lat":', k, ".25}")).otherwise('{"query":" "}')
    rows = B.history_rows(X.table(s, d, "customer").select(k.alias("k"), body.alias("body")))
    return rows.select("k", F.explode("searches").alias("q"), "stored", "multiple").select("k", "q.query", "q.lat", "stored", "multiple")


@query("""SELECT c_custkey AS k, 'recent' AS source, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE unnest(['x', c_name]) END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 0.5e0 END AS lat FROM customer WHERE c_custkey % 2 = 1
    UNION ALL SELECT c_custkey, 'recent', c_name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 0.5e0 END FROM customer WHERE c_custkey % 2 = 0""")
def recent_replies(s, d):
    k, name = F.col(KEY), F.col("c_name")
    entries = _json('{"queries":["old"],"entries":[{"query":"","lat":1},{"query":"', name, '","lat":', F.when(k % 4 == 0, _json(k, ".5")).otherwise('"north"'), "}]}")
    body = F.when(k % 2 == 0, entries).otherwise(_json('{"queries":["x","","', name, '"]}'))
    return B.recent_rows(X.table(s, d, "customer").select(k.alias("k"), body.alias("body"))).select("k", "source", "name", "lat")


@query(f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'q or one of street, city, county, state, postalcode is needed' END AS error, CASE WHEN c_custkey % 5 <> 0 THEN '{SERVER}search?format=json' || CASE WHEN c_custkey % 2 = 0 THEN '&accept-language=en%2Cde' ELSE '' END
    || CASE c_custkey % 5 WHEN 1 THEN '&q=Rue+' || c_custkey ELSE '&city=C' || c_custkey || '&state=S' END || CASE WHEN c_custkey % 3 = 0 THEN '&countrycodes=de%2Cfr' ELSE '' END || CASE WHEN c_custkey % 3 = 1 THEN '&viewbox=1%2C2' ELSE '' END
    || '&bounded=' || CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END || '&polygon=0&addressdetails=1' || CASE WHEN c_custkey % 7 = 0 THEN '&email=a%40b.example' ELSE '' END || CASE WHEN c_custkey % 3 = 2 THEN '&exclude_place_ids=' || c_custkey || '%2C9' ELSE '' END
    || CASE WHEN c_custkey % 4 > 0 THEN '&limit=' || c_custkey % 4 ELSE '' END || '&polygon_geojson=' || CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END || '&polygon_kml=0&polygon_svg=0&polygon_text=0' END AS url FROM customer""")
def geocode_full_url(s, d):
    k, off = F.col(KEY), F.lit(False)
    none, text = F.array().cast("array<string>"), lambda *p: _json(*p)
    cols = {"q": F.when(k % 5 == 1, text("Rue ", k)), "street": F.lit(""), "city": F.when(k % 5 != 0, text("C", k)), "county": F.lit(None).cast("string"), "state": F.when(k % 5 != 0, F.lit("S")), "postalcode": F.lit(""), "accept_language": F.when(k % 2 == 0, "en,de"), "countrycodes": F.when(k % 3 == 0, F.array(F.lit("de"), F.lit("fr"))).otherwise(none), "viewbox": F.when(k % 3 == 1, "1,2"), "bounded": k % 3 == 1, "polygon": off, "addressdetails": F.lit(True), "email": F.when(k % 7 == 0, "a@b.example"), "exclude_place_ids": F.when(k % 3 == 2, F.array(k.cast("string"), F.lit("9"))), "limit": (k % 4).cast("int"), "polygon_geojson": k % 2 == 0, "polygon_kml": off, "polygon_svg": off, "polygon_text": off}
    url, error = U.full_search_url(SERVER)
    return X.table(s, d, "customer").withColumns(cols).select(k.alias("k"), error.alias("error"), url.alias("url"))


@query(f"""SELECT u.tag AS raw, lower(u.norm) AS normal, coalesce(a.emoji, CASE WHEN run THEN b.emoji END) AS emoji FROM (SELECT *, strlen(tag) > 1 AND replace(tag, tag[1], '') = '' AS run FROM (SELECT norm, arg_min(tag, (strlen(tag), {FOLD}, tag)) AS tag FROM {NORMED} WHERE norm <> '' GROUP BY norm)) u
    LEFT JOIN {DICT} a ON a.key = lower(u.tag) LEFT JOIN {DICT.replace('dict(', 'dict2(')} b ON b.key = lower(u.tag[1])""".replace(") dict(key, emoji, label) a", ") a(key, emoji, label)").replace(") dict2(key, emoji, label) b", ") b(key, emoji, label)"))
def tag_vocabulary_emoji(s, d):
    return A.listed(X.waypoint_tags(s, d), emoji=True).select("raw", "normal", "emoji")


@query("SELECT DISTINCT trim(tag) AS tag FROM waypoint_tags WHERE trim(tag) <> ''")
def tag_vocabulary_client(s, d):
    return A.client_vocabulary(X.waypoint_tags(s, d))


@query(f"SELECT w.ord, string_agg(t.tag, '|' ORDER BY t.f, t.tag) AS tags FROM wp w JOIN (SELECT *, {FOLD} AS f FROM (SELECT name, lat, lon, norm, arg_min(tag, (strlen(tag), {FOLD}, tag)) AS tag FROM {NORMED} WHERE norm <> '' GROUP BY ALL)) t ON w.name = t.name AND w.lat = t.lat AND w.lon = t.lon GROUP BY w.ord")
def tags_of_waypoints_emoji(s, d):
    rows = A.with_tags(points(s, d), X.waypoint_tags(s, d), enrich=True).where("tags is not null")
    return rows.select("ord", F.array_join(F.transform("tags", lambda t: t["raw"]), "|").alias("tags"))


@query(f"SELECT w.ord, string_agg(t.tag, '|' ORDER BY {FOLD.replace('tag,', 't.tag,')}, t.tag) AS tags FROM wp w JOIN (SELECT DISTINCT * FROM waypoint_tags ) t ON w.name = t.name AND w.lat = t.lat AND w.lon = t.lon GROUP BY w.ord")
def tags_of_waypoints_ordered(s, d):
    return A.with_tags(points(s, d), X.waypoint_tags(s, d)).where("tags is not null").select("ord", F.array_join("tags", "|").alias("tags"))


@query("""SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM wp w WHERE EXISTS (SELECT 1 FROM waypoint_tags t WHERE w.name = t.name AND w.lat = t.lat AND w.lon = t.lon AND lower(t.tag) = 'coffee')""")
def tag_filter_bounds(s, d):
    hit = A.filter_of(A.with_tags(points(s, d), X.waypoint_tags(s, d)), "tag: Coffee ")
    return P.bounds(hit).select("min_lat", "max_lat", "min_lon", "max_lon")


@query("SELECT ord, ord % 2 = 0 AND NOT bookmark AS clears, CASE WHEN ord % 5 = 0 THEN false ELSE ord % 2 = 0 AND NOT bookmark END AS clears_some FROM wp ")
def selection_cleared(s, d):
    show_all = F.col("ord") % 2 != 0
    return points(s, d).select("ord", P.clears_selection(show_all, F.col("bookmark")).alias("clears"), P.clears_selection(show_all, F.when(F.col("ord") % 5 != 0, F.col("bookmark"))).alias("clears_some"))


@query("SELECT ord FROM wp WHERE ord % 11 = 0 OR ord % 3 <> 0")
def selection_visible(s, d):
    p = points(s, d)
    model = p.select("name", "lat", "lon", F.lit("waypoint").alias("type"), F.when(F.col("ord") % 3 == 0, 2).otherwise(1).alias("cnt")).withColumn("type", F.when(F.col("cnt") > 1, "cluster").otherwise("waypoint"))
    return P.visible_selection(p.select("ord", "name", "lat", "lon", (F.col("ord") % 11 == 0).alias("transient")), model).select("ord")


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'Location' ELSE c_name END AS name, c_acctbal AS lat, false AS bookmark, true AS transient, count(*) AS n FROM customer GROUP BY ALL")
def geocode_picks(s, d):
    c = X.table(s, d, "customer").select(F.when(F.col(KEY) % 4 != 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lon"))
    return B.picked(c).groupBy("name", "lat", "bookmark", "transient").agg(F.count("*").alias("n"))


@query("SELECT ord, CASE WHEN ord % 3 = 0 THEN name || '!' ELSE name END AS name FROM wp UNION ALL SELECT -ord, name FROM wp WHERE ord % 3 = 1")
def list_upsert(s, d):
    p = points(s, d)
    changed = p.where("ord % 3 = 0").withColumn("name", F.concat("name", F.lit("!")))
    return K.upserted(p, changed.unionByName(p.where("ord % 3 = 1").withColumn("ord", -F.col("ord")))).select("ord", "name")


@query("SELECT count(*) AS waypoints, count(*) FILTER (abs(lat) <= 30 AND abs(lon) <= 60) AS visible, count(*) FILTER (bookmark) AS bookmarks FROM wp ")
def list_counts(s, d):
    p = points(s, d).withColumn("seen", F.col("lat").between(-30, 30) & F.col("lon").between(-60, 60))
    return p.agg(F.count("*").alias("waypoints"), F.count_if("seen").alias("visible"), F.count_if("bookmark").alias("bookmarks"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS parsed FROM events")
def time_texts(s, d):
    text = S.now_text(F.col("ts"))
    read = S.timestamp_or_null(F.when(F.col("event_id") % 2 == 0, text).otherwise("some day")).cast("timestamp_ntz")
    return X.table(s, d, "events").select("event_id", text.alias("at"), read.alias("parsed"))


@query(f"""SELECT (SELECT count(*) FROM customer WHERE c_nationkey % 7 <> 0) AS count, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 7 <> 0) AS files,
    (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 7 = 0) + (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 5 = 0) AS skipped,
    (SELECT count(*) FROM (SELECT DISTINCT name, CAST(round(lat*1e6) AS BIGINT), CAST(round(lon*1e6) AS BIGINT) FROM (SELECT name, lat, lon FROM wp WHERE ord > 1000000 UNION ALL SELECT c_name, {X.LAT.format(k=KEY)}, {X.LON.format(k=KEY)} FROM customer WHERE c_nationkey % 7 <> 0))) AS dedup_count""")
def import_counts(s, d):
    k = F.col(KEY)
    wpts = gpx.waypoint_xml(X.table(s, d, "customer").select("c_nationkey", F.col("c_name").alias("name"), X.lat(k).alias("lat"), X.lon(k).alias("lon"), F.lit("").alias("time"), F.lit("").alias("desc")))
    bodies = wpts.groupBy("c_nationkey").agg(F.array_join(F.collect_list("xml"), "").alias("x"))  # the files of this test are small
    whole = bodies.select("c_nationkey", F.concat(F.lit('<gpx version="1.1">'), "x", F.lit("</gpx >\n")).alias("value"))
    path = lambda folder: F.concat(F.lit(f"/{folder}/"), F.col("c_nationkey").cast("string"), F.lit(".gpx"))
    files = whole.select(path("a").alias("path"), "value").unionByName(whole.where("c_nationkey % 5 = 0").select(path("b").alias("path"), "value"))
    there = bodies.where("c_nationkey % 7 = 0").select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".gpx")).alias("base"))
    return K.imported(points(s, d).where("ord > 1000000"), files, there)[1]


@query("SELECT * FROM (VALUES ('New York City', 40.7128e0), ('London', 51.5074e0), ('Paris', 48.8566e0), ('Tokyo', 35.6762e0), ('Brasília', -15.7975e0), ('Sydney', -33.8688e0), ('Ulaanbaatar', 47.8864e0), ('Moscow', 55.7558e0)) t(name, lat)")
def default_list(s, d):
    return gpx.default_points(s).select("name", "lat")


@query("SELECT count(*) AS n, count(*) FILTER (o IN ('mem-hit', 'disk-hit')) AS hits, count(*) FILTER (o = 'miss' AND event_id % 9 <> 0) AS stored, count(*) FILTER (o = 'miss' AND event_id % 9 = 0) AS errors FROM (SELECT event_id, CASE WHEN mem_age < 3600 THEN 'mem-hit' WHEN disk_age < 50000 THEN 'disk-hit' WHEN in_flight THEN 'wait-hit' ELSE 'miss' END AS o FROM tile_access )")
def cache_fetches(s, d):
    from cairnspark.operators import retention as R

    log = R.outcome(X.tile_access(s, d), disk_ttl=50_000).withColumn("failed", F.col("event_id") % 9 == 0)
    return R.fetch_counters(log)
