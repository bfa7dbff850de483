"""The queries on points and, where there is one, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import mercator as M
from cairnspark.functions import scalars as S
from cairnspark.functions import tagquery as Q
from cairnspark.functions import tags as G
from cairnspark.operators import identity as I
from cairnspark.operators import mutations as K
from cairnspark.operators import retention as R
from cairnspark.operators import spatial as P
from cairnspark.operators import suggest as U
from cairnspark.operators import tagging as A
from cairnspark.plans import fixtures as X
from cairnspark.sources import gpx
from cairnspark.sources.shared import shared_folder
from cairnspark.streaming import location as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SERVER = "https://geo.example.org/"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = X.oracle(" ".join(sql.split()) + " ")
        return f

    return add


def r6(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


def points(s: SparkSession, d: str) -> DataFrame:
    return I.first_of_each(X.waypoints(s, d))


# merging and identity


@query("SELECT ord, name, lat, lon, ele, bookmark FROM wp")
def merge_dedupe(s, d):
    return points(s, d)


@query("SELECT name, CAST(round(lat*1e6) AS BIGINT) AS klat, CAST(round(lon*1e6) AS BIGINT) AS klon, count(*) AS n, min(ord) AS first_ord FROM waypoint GROUP BY ALL")
def dedupe_key_counts(s, d):
    n, a, o = I.key()
    return X.waypoints(s, d).groupBy(n.alias("name"), a.alias("klat"), o.alias("klon")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("SELECT DISTINCT w.ord FROM wp w JOIN waypoint_tags t ON abs(w.lat - t.lat) < 1e-9 AND abs(w.lon - t.lon) < 1e-9")
def same_place(s, d):
    return I.same_place(points(s, d), X.waypoint_tags(s, d).select("lat", "lon").distinct()).select("ord")


# clusters and views


def _px(z):
    return f"(lon + 180e0) / 360e0 * (256e0 * {2**z})", f"(0.5e0 - ln((1e0 + sin(lat * pi() / 180e0)) / (1e0 - sin(lat * pi() / 180e0))) / (4e0 * pi())) * (256e0 * {2**z})"


def _cells(z, g, floor=False, source="wp", where="true"):
    x, y = _px(z)
    cell = (lambda c: f"CAST(floor({c} / {g}e0) AS BIGINT)") if floor else (lambda c: f"CAST(CASE WHEN {c} >= 0 THEN floor({c} / {g}e0) ELSE ceil({c} / {g}e0) END AS BIGINT)")
    return f"""SELECT bx, "by", CASE WHEN cnt = 1 THEN 'waypoint' ELSE 'cluster' END AS type, round(CASE WHEN cnt = 1 THEN lat ELSE atan(sinh(pi() * (1e0 - 2e0 * ((ly + hy) / 2e0) / (256e0 * {2**z})))) * 180e0 / pi() END, 6) AS lat,
        round(CASE WHEN cnt = 1 THEN lon ELSE (lx + hx) / 2e0 / (256e0 * {2**z}) * 360e0 - 180e0 END, 6) AS lon, CASE WHEN cnt = 1 THEN name END AS name, CASE WHEN cnt = 1 THEN bookmark END AS bookmark, cnt
        FROM (SELECT {cell('x')} AS bx, {cell('y')} AS "by", count(*) AS cnt, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(name) AS name, min(lat) AS lat, min(lon) AS lon, bool_and(bookmark) AS bookmark
        FROM (SELECT *, {x} AS x, {y} AS y FROM {source} WHERE abs(lat) < 90 AND {where}) GROUP BY 1, 2)"""


def _clusters(df):
    return df.select("bx", "by", "type", *r6("lat", "lon"), "name", "bookmark", "cnt")


@query(_cells(5, 60))
def cluster_grid(s, d):
    return _clusters(P.clusters(points(s, d), 5, 60))


@query(_cells(4, 30, True))
def cluster_grid_floor(s, d):
    return _clusters(P.clusters(points(s, d), 4, 30, floor=True))


@query(_cells(3, 60, where="bookmark"))
def cluster_bookmarks_only(s, d):
    return _clusters(P.clusters(points(s, d), 3, "x", bookmarks_only=True))


@query(f"SELECT * FROM ({_cells(9, 8)}) WHERE cnt = 1")
def cluster_singletons(s, d):
    return _clusters(P.clusters(points(s, d), 9, 8).where("cnt = 1"))


@query(f"SELECT ord, round({_px(7)[0]}, 6) AS x, round({_px(7)[1]}, 6) AS y FROM wp ")
def mercator_forward(s, d):
    return points(s, d).select("ord", F.round(M.pixel_x(F.col("lon"), 7), 6).alias("x"), F.round(M.pixel_y(F.col("lat"), 7), 6).alias("y"))


@query("SELECT ord, round(lat, 6) AS lat, round(lon, 6) AS lon FROM wp ")
def mercator_inverse_roundtrip(s, d):
    p = points(s, d).select("ord", M.pixel_x(F.col("lon"), 7).alias("x"), M.pixel_y(F.col("lat"), 7).alias("y"))
    return p.select("ord", F.round(M.latitude(F.col("y"), 7), 6).alias("lat"), F.round(M.longitude(F.col("x"), 7), 6).alias("lon"))


@query("SELECT ord, name, lat, lon FROM wp WHERE lat BETWEEN -10 AND 35 AND lon BETWEEN -20 AND 60 ORDER BY name, lat, lon, ord")
def viewport_table(s, d):
    return P.table_order(P.merged_viewport(X.waypoints(s, d), 35, -20, -10, 60)).select("ord", "name", "lat", "lon")


@query("""SELECT min_lat, max_lat, min_lon, max_lon, round((min_lat + max_lat) / 2e0, 6) AS lat, round((min_lon + max_lon) / 2e0, 6) AS lon,
    round(greatest(1e0, least(18e0, 10e0 - log2(greatest(max_lat - min_lat, max_lon - min_lon) * 10e0))), 6) AS zoom FROM (SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM wp )""")
def bounds_fit_zoom(s, d):
    return P.bounds(points(s, d)).select("min_lat", "max_lat", "min_lon", "max_lon", *r6("lat", "lon", "zoom"))


@query("SELECT ord, name, bookmark FROM wp WHERE lower(name) = 'customer#000000020' ORDER BY bookmark DESC, ord LIMIT 1")
def find_by_name(s, d):
    return P.by_name(points(s, d), "customer#000000020").select("ord", "name", "bookmark")


@query("SELECT coalesce(min(w.ord), -1) AS ord FROM wp w JOIN (SELECT * FROM waypoint WHERE ord = 7) q ON w.name = q.name AND abs(w.lat - q.lat) < 1e-9 AND abs(w.lon - q.lon) < 1e-9")
def find_index(s, d):
    q = X.waypoints(s, d).where("ord = 7")
    return I.first_matches(points(s, d), q.select("name", "lat", "lon"), I.LIST_TOLERANCE).agg(F.coalesce(F.min("match_ord"), F.lit(-1)).alias("ord"))


# tags

NORM = "lower(trim(tag))"
for _key, _symbol, _ in G.SYMBOLS:
    NORM = f"replace({NORM}, '{_symbol}', '{_key}')"
FOLD = "translate(tag, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NORMED = f"(SELECT name, lat, lon, tag, {NORM} AS norm FROM waypoint_tags )"
DICT = "(VALUES " + ", ".join(f"('{k}', '{e}', '{n}')" for k, e, n in G.SYMBOLS) + ") dict(key, emoji, label)"


@query("SELECT w.ord, w.name, t.tags FROM wp w LEFT JOIN (SELECT name, lat, lon, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM waypoint_tags GROUP BY ALL) t ON w.name = t.name AND w.lat = t.lat AND w.lon = t.lon")
def waypoints_with_tags(s, d):
    return A.with_tags(points(s, d), X.waypoint_tags(s, d)).select("ord", "name", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT ord, name, lat, lon, nullif(ele, 0e0) AS ele FROM wp ")
def waypoints_sparse(s, d):
    return P.sparse(points(s, d)).select("ord", "name", "lat", "lon", "ele")


@query(f"SELECT tag, {NORM} AS norm, count(*) AS n FROM waypoint_tags GROUP BY ALL")
def tag_normalize(s, d):
    return X.waypoint_tags(s, d).groupBy("tag", G.normalized(F.col("tag")).alias("norm")).agg(F.count("*").alias("n"))


@query(f"""SELECT tag, coalesce(a.emoji, CASE WHEN run THEN b.emoji END) AS emoji, coalesce(a.label, CASE WHEN run THEN b.label END) AS label,
    CASE WHEN a.emoji IS NOT NULL AND strlen(tag) = 1 THEN a.emoji WHEN a.emoji IS NOT NULL THEN a.emoji || ' ' || tag WHEN run AND b.emoji IS NOT NULL THEN repeat(b.emoji, length(tag)) ELSE tag END AS display
    FROM (SELECT DISTINCT tag, strlen(tag) > 1 AND replace(tag, tag[1], '') = '' AS run FROM waypoint_tags ) LEFT JOIN {DICT} a ON a.key = lower(tag) LEFT JOIN {DICT.replace('dict(', 'dict2(')} b ON b.key = lower(tag[1])""".replace(") dict(key, emoji, label) a", ") a(key, emoji, label)").replace(") dict2(key, emoji, label) b", ") b(key, emoji, label)"))
def tag_enrich(s, d):
    e = A.vocabulary(X.waypoint_tags(s, d)).select("tag", G.enriched(F.col("tag")).alias("e"))
    return e.select("tag", "e.emoji", F.col("e.name").alias("label"), "e.display")


@query(f"SELECT norm, arg_min(tag, (strlen(tag), {FOLD}, tag)) AS tag FROM {NORMED} WHERE norm <> '' GROUP BY norm")
def tag_unify(s, d):
    return A.unified(X.waypoint_tags(s, d))


@query("SELECT DISTINCT tag FROM waypoint_tags ")
def tag_distinct(s, d):
    return A.vocabulary(X.waypoint_tags(s, d))


@query(f"SELECT name, lat, lon, norm, arg_min(tag, (strlen(tag), {FOLD}, tag)) AS tag FROM {NORMED} WHERE norm <> '' GROUP BY ALL")
def tags_per_waypoint_unified(s, d):
    return A.unified(X.waypoint_tags(s, d), *A.POINT)


@query("SELECT name, CASE WHEN length(t) > 40 THEN left(t, 37) || '…' ELSE t END AS label FROM (SELECT name, string_agg(tag || ' of ' || name, ', ' ORDER BY tag) AS t FROM waypoint_tags GROUP BY name)")
def tag_format(s, d):
    t = X.waypoint_tags(s, d).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("tag", F.concat_ws(" of ", "tag", "name").alias("v")))).alias("l"))
    return t.select("name", G.joined(F.col("l.v")).alias("label"))


def _tag_sql(having: str, mode: str) -> str:
    return f"""SELECT name, lat, lon, CASE WHEN coalesce(own, true) THEN 'bookmark' ELSE 'waypoint' END AS source, 'tag' AS class, '{mode}' AS type FROM (SELECT h.name, h.lat, h.lon, arg_min(w.bookmark, w.ord) AS own
        FROM (SELECT name, lat, lon FROM {NORMED} GROUP BY ALL HAVING {having}) h LEFT JOIN wp w ON h.name = w.name AND abs(h.lat - w.lat) < 1e-9 AND abs(h.lon - w.lon) < 1e-9 GROUP BY ALL) ORDER BY lower(name), name, lat, lon LIMIT 8"""


def _tag(text):
    return lambda s, d: A.tag_query(text, X.waypoint_tags(s, d), points(s, d))


for _name, _text, _having, _mode in [
    ("tag_query_single", "tag:coffee", "bool_or(norm = 'coffee')", "single"),
    ("tag_query_and", 'TAG:"home AND building"', "bool_or(norm = 'home') AND bool_or(norm = 'building')", "AND"),
    ("tag_query_or", "tag:diving or ⭐", "bool_or(norm = 'diving') OR bool_or(norm = '*')", "OR"),
    ("tag_query_mixed", "tag:home AND coffee OR todo", "bool_or(norm = 'home') AND bool_or(norm = 'coffee or todo')", "AND"),
]:
    QUERIES[_name] = _tag(_text)
    ORACLE_SQL[_name] = X.oracle(_tag_sql(_having, _mode) + " ")


@query("SELECT DISTINCT w.ord FROM wp w JOIN waypoint_tags t ON w.name = t.name AND w.lat = t.lat AND w.lon = t.lon WHERE lower(t.tag) = 'home'")
def tag_filter_local(s, d):
    return A.local_filter(A.with_tags(points(s, d), X.waypoint_tags(s, d)), " Home ").select("ord")


VOCAB = "(SELECT row_number() OVER (ORDER BY tag) AS pos, tag AS raw FROM (SELECT DISTINCT tag FROM waypoint_tags ))"


def _vocab(s, d):
    rows = I.numbered(A.vocabulary(X.waypoint_tags(s, d)), F.substr("tag", F.lit(1), F.lit(1)), "tag")
    return rows.select(F.col("number").alias("pos"), F.col("tag").alias("raw"), G.enriched(F.col("tag"))["display"].alias("display"))


@query(f"SELECT pos, raw, 'tag:' || raw AS name FROM {VOCAB} WHERE starts_with(raw, '$') ORDER BY pos")
def tag_completion_symbol(s, d):
    return A.completions(_vocab(s, d), "tag:$")


@query(f"SELECT pos, raw, 'tag:home AND ' || raw AS name FROM {VOCAB} WHERE contains(lower(raw), 'o') ORDER BY pos")
def tag_completion_fuzzy(s, d):
    return A.completions(_vocab(s, d), "tag:home and o")


@query("SELECT t.* FROM (SELECT name || '!' AS name, lat, lon, tag FROM waypoint_tags WHERE tag = 'todo' UNION ALL SELECT * FROM waypoint_tags ) t ANTI JOIN wp w ON t.name = w.name AND t.lat = w.lat AND t.lon = w.lon")
def orphan_tags(s, d):
    t = X.waypoint_tags(s, d)
    return A.orphans(t.where("tag = 'todo'").withColumn("name", F.concat("name", F.lit("!"))).unionByName(t), points(s, d))


@query("SELECT DISTINCT name, lat, lon, tag FROM (SELECT * FROM waypoint_tags UNION ALL SELECT name, lat, lon, 'new' FROM waypoint_tags WHERE tag = 'home')")
def tag_insert_ignore(s, d):
    t = X.waypoint_tags(s, d)
    new = t.where("tag = 'home'").select(*A.POINT, F.explode(F.array(F.lit(" new "), F.lit("  "), F.lit("home"))).alias("tag"))
    return A.inserted(t, new)


@query("SELECT name, lat, lon, tag FROM waypoint_tags WHERE tag <> 'coffee'")
def tag_delete(s, d):
    t = X.waypoint_tags(s, d)
    return A.deleted(t, t.where("tag = 'coffee'"))


@query("SELECT c_custkey AS k, c_mktsegment || ',a,' || c_name AS tags FROM customer")
def entered_tags(s, d):
    return X.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(A.entered(F.concat(F.lit(" "), "c_mktsegment", F.lit(", a,,"), "c_name", F.lit(" ,"), "c_mktsegment")), ",").alias("tags"))


# search


@query("SELECT ord, name, lat, lon FROM wp WHERE name <> '' AND contains(lower(name), 'click-1') ORDER BY lower(name), name, ord LIMIT 8")
def suggest_name(s, d):
    return U.by_name(points(s, d), "CLICK-1").select("ord", "name", "lat", "lon")


def _named(cache):
    """The cache with one of its keys as a name that points have too."""
    return cache.replace("nation_7", "customer#000000007", ["query"])


@query("""SELECT name, lat, lon, source FROM (SELECT 0 AS a, lower(name) AS b, name AS c, ord AS e, name, lat, lon, CASE WHEN bookmark THEN 'bookmark' ELSE 'waypoint' END AS source FROM wp WHERE contains(lower(name), 'customer#000000007')
    UNION ALL SELECT 1, '', '', pos, display_name, lat, lon, 'geocode' FROM geocode WHERE query = 'nation_7') ORDER BY a, b, c, e LIMIT 8""")
def suggest_fill_geocode(s, d):
    return U.filled(points(s, d), _named(X.geocode_cache(s, d)), "Customer#000000007")


@query("SELECT query, id, lat FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id DESC) AS rn FROM search_history WHERE query <> '') WHERE rn = 1 ORDER BY id DESC LIMIT 10")
def recent_queries(s, d):
    return U.recent(X.search_history(s, d), 500)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) + 1000 AS id, n_name AS query FROM nation WHERE n_nationkey % 3 <> 0")
def history_append(s, d):
    n = X.table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "n_name", F.lit("\n"))).alias("query"))
    return U.recorded(n, 1000)


@query("SELECT query, pos, display_name, lat, lon, class, type FROM geocode ")
def geocode_decode(s, d):
    return U.decoded(X.geocode_cache(s, d))


@query(f"SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN '{SERVER}search?format=json' || CASE WHEN n_nationkey % 2 = 0 THEN '&q=' || replace(n_name, ' ', '+') ELSE '&street=Main+1&city=' || replace(n_name, ' ', '+') END || '&bounded=0&polygon=0&addressdetails=1' || CASE WHEN n_nationkey % 3 > 0 THEN '&limit=' || (n_nationkey % 3) ELSE '' END END AS url FROM nation")
def geocode_search_url(s, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    none = F.lit(None).cast("string")
    on = k % 5 != 0
    t = X.table(s, d, "nation").select(k.alias("k"), F.when(on & (k % 2 == 0), n).alias("q"), F.when(on & (k % 2 == 1), "Main 1").alias("street"), F.when(on, n).alias("city"), none.alias("county"), none.alias("state"), none.alias("postalcode"), (k % 3).alias("limit"), F.lit(False).alias("bounded"), F.lit(False).alias("polygon"), F.lit(True).alias("addressdetails"))
    return t.select("k", U.search_url(SERVER).alias("url"))


@query(f"""SELECT k, CASE WHEN error IS NULL THEN '{SERVER}reverse?format=json&osm_type=' || t || '&osm_id=' || k || '&lat=1.5&lon=2.5&zoom=' || k || '&addressdetails=0' END AS url, error
    FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN 'V' ELSE 'W' END AS t, CASE WHEN n_nationkey % 4 = 3 THEN 'OsmType must be ''N'', ''W'' or ''R''' WHEN n_nationkey % 7 = 0 THEN 'Cannot search without a latitude. Set field Lat' WHEN n_nationkey > 18 THEN 'Zoom must be within 0 and 18. ' || n_nationkey || ' is out of range' END AS error FROM nation)""")
def geocode_reverse_url(s, d):
    k = F.col("n_nationkey")
    t = X.table(s, d, "nation").select(k.alias("k"), F.when(k % 4 == 3, "V").otherwise("W").alias("osm_type"), k.cast("string").alias("osm_id"), F.when(k % 7 != 0, "1.5").alias("lat"), F.lit("2.5").alias("lon"), k.alias("zoom"), F.lit(False).alias("address_details"))
    url, error = U.reverse_url(SERVER)
    return t.select("k", url.alias("url"), error.alias("error"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'empty' WHEN 2 THEN 'parse' WHEN 3 THEN 'none' ELSE 'ok' END AS answer FROM nation")
def geocode_classify(s, d):
    k = F.col("n_nationkey")
    body = F.when(k % 5 == 1, " ").when(k % 5 == 2, "oops").when(k % 5 == 3, "[]").otherwise('[{"display_name":"a"}]')
    return X.table(s, d, "nation").select(k.alias("k"), U.answer_class(F.when(k % 5 == 0, 500).otherwise(200), body).alias("answer"))


# mutations

NEW = "(SELECT ord, CASE WHEN ord % 2 = 0 THEN name ELSE name || '+' END AS name, lat + 4e-7 AS lat, lon, ele, false AS bookmark FROM wp )"


def _new(p):
    return p.select("ord", F.when(F.col("ord") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("+"))).alias("name"), (F.col("lat") + 4e-7).alias("lat"), "lon", "ele", F.lit(False).alias("bookmark"))


@query(f"SELECT * FROM wp UNION ALL SELECT n.* FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM wp w WHERE w.name = n.name AND abs(w.lat - n.lat) < 1e-6 AND abs(w.lon - n.lon) < 1e-6)")
def bookmark_append(s, d):
    p = points(s, d)
    return K.appended(p, _new(p))


@query(f"SELECT n.ord FROM {NEW} n WHERE EXISTS (SELECT 1 FROM wp w WHERE w.name = n.name AND abs(w.lat - n.lat) < 1e-6 AND abs(w.lon - n.lon) < 1e-6)")
def bookmark_duplicates(s, d):
    p = points(s, d)
    return K.duplicates(p, _new(p)).select("ord")


@query(f"SELECT w.* FROM wp w WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE w.name = n.name AND abs(w.lat - n.lat) < 1e-6 AND abs(w.lon - n.lon) < 1e-6)")
def bookmark_delete(s, d):
    p = points(s, d)
    return K.deleted(p, _new(p))


@query("SELECT ord, CASE WHEN ord IN (SELECT min(ord) FROM waypoint WHERE name IN ('click-3', 'view-5') GROUP BY name) THEN name || ' new' ELSE name END AS name, lat, lon FROM waypoint ")
def bookmark_rename_first(s, d):
    w = X.waypoints(s, d)
    names = w.where("name in ('click-3', 'view-5')").select("name", "lat", "lon").distinct().withColumn("new_name", F.concat("name", F.lit(" new")))
    return K.first_renamed(w, names).select("ord", "name", "lat", "lon")


@query("SELECT w.* FROM wp w WHERE NOT bookmark")
def bookmark_delete_first(s, d):
    p = points(s, d)
    return K.first_deleted(p, p.select("name", "lat", "lon"), I.LIST_TOLERANCE)


@query("""SELECT state, count(*) AS files FROM (SELECT CASE WHEN k % 5 = 0 OR row_number() OVER (PARTITION BY k // 2 ORDER BY dir) > 1 THEN 'skipped' ELSE 'copied' END AS state FROM
    (SELECT n_nationkey AS k0, (n_nationkey // 2) * 2 AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'a-b' END AS dir FROM nation)) GROUP BY state""")
def import_summary(s, d):
    k = F.col("n_nationkey")
    even = (F.floor(k / 2) * 2).cast("int")
    files = X.table(s, d, "nation").select(F.concat(F.lit("/"), F.when(k % 2 == 0, "a").otherwise("a-b"), F.lit("/f"), even.cast("string"), F.lit(".gpx")).alias("path"))
    there = X.table(s, d, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".gpx")).alias("base"))
    return K.import_plan(files, there).groupBy("state").agg(F.count("*").alias("files"))


# caches


@query("SELECT page_id FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, path) AS rn, sum(bytes) OVER (ORDER BY mtime DESC, path ROWS UNBOUNDED PRECEDING) AS run FROM tile_file WHERE mtime > 0) WHERE rn <= 100 AND run <= 200000")
def cache_prune(s, d):
    now = 10_000_000
    return R.pruned(X.tile_files(s, d), now, now, 100, 200_000).select("page_id")


@query("SELECT page_id FROM tile_file ORDER BY mtime DESC, page_id LIMIT 50")
def cache_evict(s, d):
    return R.kept_in_memory(X.tile_files(s, d).select("page_id", F.col("mtime").alias("stored_at"), F.col("page_id").alias("key")), 50).select("page_id")


OUTCOME = "CASE WHEN mem_age < 3600 THEN 'mem-hit' WHEN disk_age < 50000 THEN 'disk-hit' WHEN in_flight THEN 'wait-hit' ELSE 'miss' END"


@query(f"SELECT event_id, {OUTCOME} AS outcome FROM tile_access ")
def cache_outcome(s, d):
    return R.outcome(X.tile_access(s, d), disk_ttl=50_000).select("event_id", "outcome")


@query(f"SELECT count(*) FILTER (o IN ('mem-hit', 'disk-hit')) AS hits, count(*) FILTER (o = 'disk-hit') AS disk_hits, count(*) FILTER (o = 'miss') AS misses, count(*) FILTER (o = 'wait-hit') AS waits FROM (SELECT {OUTCOME} AS o FROM tile_access )")
def cache_stats(s, d):
    return R.counters(R.outcome(X.tile_access(s, d), disk_ttl=50_000))


@query("SELECT tile, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, count(*) AS requests FROM tile_access GROUP BY ALL")
def coalesce_requests(s, d):
    return R.coalesced(X.tile_access(s, d), "tile", 3600)


# streams


@query("SELECT device, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, event_id FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS rn FROM location_fix WHERE NOT (lat = 0 AND lon = 0)) WHERE rn = 1")
def latest_fix(s, d):
    return L.latest(X.location_fixes(s, d)).select("device", "ts", *r6("lat", "lon"), "event_id")


@query("""SELECT device, count(*) AS n, max_by(event_id, (ts, event_id)) AS event_id FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts, event_id) AS burst FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM location_fix )) GROUP BY device, burst""")
def debounce_last(s, d):
    return L.debounced(X.location_fixes(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "device", "6 hours")


METRES = f"2 * {S.EARTH_M}e0 * asin(sqrt(least(1e0, pow(sin((f.lat - w.la) * pi() / 360e0), 2) + cos(w.la * pi() / 180e0) * cos(f.lat * pi() / 180e0) * pow(sin((f.lon - w.lo) * pi() / 360e0), 2))))"
STEPS = "SELECT device, epoch(ts) AS t, lat, lon, event_id, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM location_fix"


# files


def _roundtrip(s, p):
    path = shared_folder(s, "gpx")
    gpx.write_gpx(p, path)
    return gpx.read_gpx(s, path).select("name", S.fixed(F.col("lat"), 6).alias("lat"), S.fixed(F.col("lon"), 6).alias("lon"))


def _text(p):
    p = p.withColumns({"name": F.concat("name", F.lit("&<")), "time": F.lit(""), "desc": F.lit(None).cast("string")})
    return gpx.waypoint_xml(p).select("ord", "xml")


@query("SELECT name, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon FROM wp ")
def gpx_roundtrip(s, d):
    return _roundtrip(s, points(s, d))


@query("SELECT ord, '<wpt lat=\"' || printf('%.6f', lat) || '\" lon=\"' || printf('%.6f', lon) || '\"><name>' || name || '&amp;&lt;</name></wpt>' AS xml FROM wp ")
def gpx_text(s, d):
    return _text(points(s, d))


# scalars


@query("SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc, 'nope' AS bad FROM events")
def time_normalize(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".75+02:00"))
    return X.table(s, d, "events").select("event_id", S.utc_time(text).alias("utc"), S.utc_time(F.lit("nope")).alias("bad"))


@query("SELECT event_id, strftime(ts, '%-I:%M %p') AS clock, strftime(ts, '%-d, %b') AS day FROM events")
def time_display(s, d):
    return X.table(s, d, "events").select("event_id", S.clock_time(F.col("ts")).alias("clock"), S.short_date(F.col("ts")).alias("day"))


@query("SELECT ord, printf('%.5f', lat) AS lat, printf('%.4f', lon) AS lon FROM wp ")
def coord_format(s, d):
    return points(s, d).select("ord", S.fixed(F.col("lat"), 5).alias("lat"), S.fixed(F.col("lon"), 4).alias("lon"))


@query(f"SELECT ord, round(m, 3) AS m, m < 1000000 AS near FROM (SELECT ord, 2 * {S.EARTH_M}e0 * asin(sqrt(least(1e0, pow(sin((lat - 10e0) * pi() / 360e0), 2) + cos(10e0 * pi() / 180e0) * cos(lat * pi() / 180e0) * pow(sin((lon - 20e0) * pi() / 360e0), 2)))) AS m FROM wp )")
def haversine_near(s, d):
    m = S.haversine(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon"))
    return points(s, d).select("ord", F.round(m, 3).alias("m"), (m < 1000000).alias("near"))


@query("SELECT page_id, CAST(page_id % 6 AS INT) AS z, CAST(page_id*31 % 64 AS INT) AS x, CAST(page_id*17 % 64 AS INT) AS y FROM tile_file WHERE page_id % 50 <> 0")
def tile_path_parse(s, d):
    return X.tile_files(s, d).select("page_id", S.tile_path(F.col("path")).alias("t")).where("t is not null").select("page_id", "t.z", "t.x", "t.y")


@query("SELECT n_nationkey AS k, 'https://t.example.org/' || n_nationkey || '/1/2.png' AS url, CASE WHEN n_nationkey <= 5 THEN 2 * n_nationkey ELSE 30 END AS wait, round(greatest(1e0, least(18e0, 5e0 + log2(n_nationkey + 1e0))), 6) AS zoom, '/d/' || n_nationkey AS dir FROM nation")
def request_scalars(s, d):
    k = F.col("n_nationkey")
    return X.table(s, d, "nation").select(k.alias("k"), S.tile_url("https://t.example.org/%d/%d/%d.png", k, F.lit(1), F.lit(2)).alias("url"), S.back_off(k).alias("wait"), F.round(S.pinched(F.lit(5.0), k + 1.0), 6).alias("zoom"), S.directory_path(F.concat(F.lit("file:///d/"), k.cast("string"), F.lit("/"))).alias("dir"))


@query("SELECT route, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'recent' WHEN n_nationkey % 4 = 1 THEN 'backendTagSuggest' WHEN n_nationkey % 4 = 2 THEN 'tagFetchDistinct' ELSE 'backendSuggest' END AS route FROM nation) GROUP BY route")
def route_text(s, d):
    texts = ["", "tag:a AND b", "tag:a", "a AND b"]
    made = F.create_map(*(F.lit(v) for k, t in enumerate(texts) for v in (k, Q.route(t, False))))
    return X.table(s, d, "nation").select(F.element_at(made, F.col("n_nationkey") % 4).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


from cairnspark.plans import exchange, more, stored, timed  # noqa: E402, F401  they add their queries
