"""Name suggestions, recent searches and the geocoder's cache and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.scalars import float_or_zero, query_escape, trimmed
from cairnspark.operators.identity import numbered

CAP = 8
#: Positions that are numbered in one task.
BLOCK = 100_000
PAYLOAD = "array<struct<display_name:string,lat:double,lon:double,class:string,type:string>>"
FLAGS = ("bounded", "polygon", "addressdetails")
STRUCTURED = ("street", "city", "county", "state", "postalcode")


def by_name(points: DataFrame, text: str, cap: int = CAP) -> DataFrame:
    """Points whose name holds the text, case aside and without wildcards."""
    hit = points.where((F.col("name") != "") & F.contains(F.lower("name"), F.lit(text.strip().lower())))
    return hit.orderBy(F.lower("name"), "name", "ord").limit(cap)


def decoded(cache: DataFrame) -> DataFrame:
    """The rows of cached geocoder answers; blank names are skipped, missing fields are zero or empty."""
    rows = cache.select("query", F.posexplode(F.from_json("json", PAYLOAD)).alias("pos", "r"))
    zero, empty = F.lit(0.0), F.lit("")
    return rows.where(trimmed(F.col("r.display_name")) != "").select("query", "pos", F.col("r.display_name").alias("display_name"), F.coalesce("r.lat", zero).alias("lat"), F.coalesce("r.lon", zero).alias("lon"), F.coalesce("r.class", empty).alias("class"), F.coalesce("r.type", empty).alias("type"))


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each query."""
    return cache.unionByName(new).groupBy("query").agg(F.max_by("json", "fetched_at").alias("json"), F.max("fetched_at").alias("fetched_at"))


def filled(points: DataFrame, cache: DataFrame, text: str, cap: int = CAP) -> DataFrame:
    """Local suggestions first, then cached answers for the text in the places left."""
    local = by_name(points, text, cap).select(F.lit(0).alias("src"), F.lower("name").alias("k1"), F.col("name").alias("k2"), F.col("ord").cast("bigint").alias("k3"), "name", "lat", "lon", F.when(F.col("bookmark"), "bookmark").otherwise("waypoint").alias("source"))
    remote = decoded(cache.where(F.col("query") == text.strip().lower())).select(F.lit(1).alias("src"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.col("pos").cast("bigint").alias("k3"), F.col("display_name").alias("name"), "lat", "lon", F.lit("geocode").alias("source"))
    return local.unionByName(remote).orderBy("src", "k1", "k2", "k3").limit(cap).select("name", "lat", "lon", "source")


def recent(history: DataFrame, n=10) -> DataFrame:
    """The latest entry of each query, newest first."""
    try:
        limit = int(n) if 1 <= int(n) <= 200 else 10
    except (TypeError, ValueError):
        limit = 10
    rows = history.where("query <> ''")
    return rows.groupBy("query").agg(F.max("id").alias("id"), F.max_by("lat", "id").alias("lat")).orderBy(F.desc("id")).limit(limit)


def recorded(queries: DataFrame, last_id: int) -> DataFrame:
    """Trimmed queries with ids after last_id, in order of pos (whole numbers); blank ones are ignored."""
    rows = queries.withColumn("query", trimmed(F.col("query"))).where("query <> ''")
    return numbered(rows, F.floor(F.col("pos") / BLOCK), "pos").select((F.col("number") + last_id).cast("bigint").alias("id"), "query")


def search_url(server: str) -> Column:
    """Search request of columns q, street, city, county, state, postalcode, limit, flags; null if neither q nor a field is set."""
    part = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"&{name}="), query_escape(F.col(name)))).otherwise("")
    fields = F.concat(*map(part, STRUCTURED))
    flags = F.concat(*(F.concat(F.lit(f"&{f}="), F.when(F.coalesce(F.col(f), F.lit(False)), "1").otherwise("0")) for f in FLAGS))
    what = F.when(F.coalesce("q", F.lit("")) != "", part("q")).otherwise(F.nullif(fields, F.lit("")))
    return F.concat(F.lit(server.rstrip("/") + "/search?format=json"), what, flags, F.when(F.col("limit") > 0, F.concat(F.lit("&limit="), F.col("limit").cast("string"))).otherwise(""))


ALL_FLAGS = ("polygon_geojson", "polygon_kml", "polygon_svg", "polygon_text")


def uses_fields() -> Column:
    """Whether a request has one of the structured fields."""
    return F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in STRUCTURED)) != ""


def full_search_url(server: str) -> tuple[Column, Column]:
    """The whole search request, and the error: search_url() with accept_language, countrycodes, viewbox, email, exclude_place_ids and the polygon flags."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    part = lambda name, c, text=None: F.when(filled(c) if text is None else F.size(c) > 0, F.concat(F.lit(f"&{name}="), query_escape(F.col(c) if text is None else text))).otherwise("")
    flag = lambda c: F.concat(F.lit(f"&{c}="), F.when(F.coalesce(F.col(c), F.lit(False)), "1").otherwise("0"))
    error = F.lit("no server is set") if not server else F.when(~filled("q") & ~uses_fields(), "q or one of street, city, county, state, postalcode is needed")
    what = F.when(filled("q"), part("q", "q")).otherwise(F.concat(*(part(c, c) for c in STRUCTURED)))
    codes, ids = (F.array_join(c, ",") for c in ("countrycodes", "exclude_place_ids"))
    limit = F.when(F.col("limit") > 0, F.concat(F.lit("&limit="), F.col("limit").cast("string"))).otherwise("")
    url = F.concat(F.lit((server or "").rstrip("/") + "/search?format=json"), part("accept-language", "accept_language"), what, part("countrycodes", "countrycodes", codes), part("viewbox", "viewbox"), *map(flag, FLAGS), part("email", "email"), part("exclude_place_ids", "exclude_place_ids", ids), limit, *map(flag, ALL_FLAGS))
    return F.when(error.isNull(), url), error


def reverse_url(server: str) -> tuple[Column, Column]:
    """Reverse request, and the error, of columns osm_type, osm_id, lat, lon (text), zoom, address_details. The id is sent as it is."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = F.lit("no server is set") if not server else F.when(~blank("osm_type") & ~F.col("osm_type").isin("N", "W", "R"), "OsmType must be 'N', 'W' or 'R'").when(blank("lat"), "Cannot search without a latitude. Set field Lat").when(blank("lon"), "Cannot search without a longitude. Set field Lon").when(~F.col("zoom").between(0, 18), F.concat(F.lit("Zoom must be within 0 and 18. "), F.col("zoom").cast("string"), F.lit(" is out of range")))
    part = lambda name, c: F.when(blank(c), "").otherwise(F.concat(F.lit(f"&{name}="), F.col(c)))
    url = F.concat(F.lit(server.rstrip("/") + "/reverse?format=json"), part("osm_type", "osm_type"), part("osm_id", "osm_id"), part("lat", "lat"), part("lon", "lon"), F.lit("&zoom="), F.col("zoom").cast("string"), F.lit("&addressdetails="), F.when(F.coalesce("address_details", F.lit(False)), "1").otherwise("0"))
    return F.when(error.isNull(), url), error


def answer_class(status: Column, body: Column) -> Column:
    """What a geocoder's answer is worth."""
    rows = F.from_json(body, PAYLOAD)
    return F.when(status != 200, "http").when(F.coalesce(F.length(trimmed(body)), F.lit(0)) == 0, "empty").when(~trimmed(body).startswith("[") | rows.isNull(), "parse").when(F.size(rows) == 0, "none").otherwise("ok")


def transient(error: Column) -> Column:
    return F.contains(error, F.lit("unexpected end of JSON")) | F.contains(error, F.lit("EOF"))


RETRIES, MOST_RETRIES = 1, 5


def attempts(errors: Column, retries: int = RETRIES) -> Column:
    """How many requests are made, given the error (or null) of each in turn: a transient one is tried again, retries times at most."""
    most = retries if 0 <= retries <= MOST_RETRIES else RETRIES
    again = F.transform(F.slice(errors, 1, most), lambda e: F.coalesce(transient(e), F.lit(False)))
    first = F.array_position(again, F.lit(False))
    return F.when(first > 0, first).otherwise(F.size(again) + 1).cast("int")


def payload(answers: Column, limit: Column) -> Column:
    """What is stored of an answer (structs of text: display_name, lat, lon, class, type): the first limit rows as JSON, coordinates as numbers."""
    row = lambda r: F.struct(r["display_name"].alias("display_name"), float_or_zero(r["lat"]).alias("lat"), float_or_zero(r["lon"]).alias("lon"), r["class"].alias("class"), r["type"].alias("type"))
    return F.to_json(F.transform(F.slice(answers, 1, limit), row))


def geocoded(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (id, pos, display_name, lat, lon, class, type) for requests (id, query, limit, at) served through the cache.

    The first request of a query with a limit above 0 fetches its answer
    (query, answer) and stores as many rows as its limit; the cache knows the
    query alone, so later requests get no more than that, whatever their limit.
    Blank names are skipped when rows are read, and rows count after that.
    """
    asked = requests.where(F.col("limit") > 0)
    first = asked.groupBy("query").agg(F.min_by("limit", F.struct("at", "id")).alias("stored"))
    cache = first.join(answers, "query").select("query", payload(F.col("answer"), F.col("stored")).alias("json"))
    rows = F.filter(F.from_json("json", PAYLOAD), lambda r: F.coalesce(r["display_name"], F.lit("")) != "")
    served = asked.join(cache, "query").select("id", F.posexplode(F.slice(rows, F.lit(1), F.col("limit"))).alias("pos", "r"))
    return served.select("id", "pos", "r.*")
