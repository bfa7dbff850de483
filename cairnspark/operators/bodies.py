"""Requests and replies as JSON texts: decoding, validation and what is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.scalars import trimmed

BAD = "_corrupt_record"
CREATE = "name string, lat double, lon double, ele double, time string, desc string, tags array<string>"
HISTORY = "query string, queries array<string>, lat double, lon double"


def body_of(text: Column, schema: str) -> Column:
    """The body as a struct; its field BAD is set if the text is no JSON of that shape."""
    return F.from_json(text, f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"})


def _blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def invalid(body: Column) -> Column:
    return body.isNull() | body[BAD].isNotNull()


def created(requests: DataFrame, now: str, text: str = "body") -> DataFrame:
    """requests with an error, or the point that is stored (a bookmark; now stands for a missing time) and its tags."""
    rows = requests.withColumn("b", body_of(F.col(text), CREATE))
    b = F.col("b")
    error = F.when(invalid(b), "invalid JSON").when(_blank(b["name"]), "name is required")
    point = F.struct(b["name"].alias("name"), F.coalesce(b["lat"], F.lit(0.0)).alias("lat"), F.coalesce(b["lon"], F.lit(0.0)).alias("lon"), F.coalesce(b["ele"], F.lit(0.0)).alias("ele"), F.coalesce(F.nullif(b["time"], F.lit("")), F.lit(now)).alias("time"), F.coalesce(b["desc"], F.lit("")).alias("desc"), F.lit(True).alias("bookmark"), F.when(F.size(b["tags"]) > 0, b["tags"]).alias("tags"))
    return rows.withColumn("error", error).withColumn("saved", F.when(error.isNull(), point)).drop("b")


def rename_error(old: Column, new: Column) -> Column:
    return F.when(_blank(old) | _blank(new), "oldName and newName required")


def delete_error(name: Column, lat: Column, lon: Column) -> Column:
    """name, lat and lon are texts of parameters."""
    return F.when(F.coalesce(name, F.lit("")) == "", "name required").when(lat.try_cast("double").isNull() | lon.try_cast("double").isNull(), "invalid lat/lon")


def history_rows(requests: DataFrame, text: str = "body") -> DataFrame:
    """requests with the searches to store, in order: all of queries without coordinates, else the one query with its own; blank ones are ignored."""
    b = body_of(F.col(text), HISTORY)
    none = F.lit(None).cast("double")
    several = F.size(b["queries"]) > 0
    asked = F.when(several, F.transform(b["queries"], lambda q: F.struct(q.alias("query"), none.alias("lat"), none.alias("lon")))).otherwise(F.array(F.struct(b["query"].alias("query"), b["lat"].alias("lat"), b["lon"].alias("lon"))))
    kept = F.filter(F.transform(asked, lambda a: F.struct(trimmed(a["query"]).alias("query"), a["lat"].alias("lat"), a["lon"].alias("lon"))), lambda a: F.coalesce(a["query"], F.lit("")) != "")
    bad = invalid(b)
    return requests.select("*", F.when(bad, "invalid JSON").alias("error"), F.when(~bad, kept).alias("searches"), F.when(~bad, F.size(kept)).alias("stored"), F.when(~bad, F.coalesce(several, F.lit(False))).alias("multiple"))


def recent_rows(answers: DataFrame, text: str = "body") -> DataFrame:
    """answers with pos and the suggestions of recent searches: entries, or the queries where there are none; a coordinate that is no number is null."""
    b = F.from_json(F.col(text), "queries array<string>, entries array<string>")
    entry = lambda e: F.from_json(e, "query string, lat double, lon double")
    plain = F.transform(F.coalesce(b["queries"], F.array().cast("array<string>")), lambda q: F.struct(q.alias("query"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
    rows = answers.select("*", F.posexplode(F.coalesce(F.transform(b["entries"], entry), plain)).alias("pos", "e"))
    return rows.where(F.coalesce(F.col("e.query"), F.lit("")) != "").select(*answers.columns, "pos", F.col("e.query").alias("name"), "e.lat", "e.lon", F.lit("recent").alias("source"))


def shown_when_empty(recent: DataFrame, text: str, most: int = 10) -> DataFrame:
    """The first recent suggestions while nothing is typed."""
    return recent.orderBy("pos").limit(most if not text.strip() else 0)


def tag_entries(tags: Column) -> Column:
    """raw and display of each element of an array of structs (raw, emoji, display) or of strings in raw; nulls are dropped."""
    made = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.struct(t["raw"].alias("raw"), t["emoji"].alias("emoji"), F.coalesce(F.nullif(t["display"], F.lit("")), F.when(F.coalesce(t["emoji"], F.lit("")) != "", F.concat(t["emoji"], F.lit(" "), t["raw"])).otherwise(t["raw"])).alias("display")))
    return F.coalesce(made, F.array().cast("array<struct<raw:string,emoji:string,display:string>>"))


def picked(suggestions: DataFrame) -> DataFrame:
    """Points for picked answers of the geocoder, which are kept nowhere."""
    return suggestions.select(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Location")).alias("name"), "lat", "lon", F.lit(False).alias("bookmark"), F.lit(True).alias("transient"))
