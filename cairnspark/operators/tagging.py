"""Tags on points: vocabulary, joins, the query language and completions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import tagquery as Q
from cairnspark.functions import tags as G
from cairnspark.functions.scalars import ascii_lower
from cairnspark.operators.identity import LIST_TOLERANCE, in_cells, near_in_cell

CAP = 8
POINT = ["name", "lat", "lon"]


def unified(tags: DataFrame, *by: str) -> DataFrame:
    """One tag for each normalized form (of each group): the shortest in bytes, then the first without case."""
    rows = tags.withColumn("norm", G.normalized(F.col("tag"))).where("norm <> ''")
    return rows.groupBy(*by, "norm").agg(F.min_by("tag", F.struct(F.octet_length("tag"), ascii_lower(F.col("tag")), "tag")).alias("tag"))


def vocabulary(tags: DataFrame) -> DataFrame:
    return tags.select("tag").distinct()


def listed(tags: DataFrame, emoji: bool = False) -> DataFrame:
    """The vocabulary in order; with emoji unified, and with what enriches each tag."""
    if not emoji:
        return vocabulary(tags).orderBy(ascii_lower(F.col("tag")), "tag")
    rows = unified(tags).select(G.enriched(F.col("tag")).alias("e")).select("e.*")
    return rows.orderBy(F.lower("raw"), "raw")


def client_vocabulary(tags: DataFrame) -> DataFrame:
    """Distinct trimmed tags, by lower case."""
    return tags.select(G.trimmed(F.col("tag")).alias("tag")).where("tag <> ''").distinct().orderBy(F.lower("tag"), "tag")


def filter_of(points_with_tags: DataFrame, text: str) -> DataFrame | None:
    """Points that a typed query filters to; None clears the filter (no tag query, an operator, quotes, or no match)."""
    if not Q.is_tag_query(text) or Q.has_operator(text[4:]) or not text[4:].strip():
        return None
    hit = local_filter(points_with_tags, text[4:])
    return None if hit.isEmpty() else hit


def with_tags(points: DataFrame, tags: DataFrame, enrich: bool = False) -> DataFrame:
    """points with the ordered list of their tags (exact match; null without any)."""
    rows = unified(tags, *POINT) if enrich else tags
    entry = F.struct(ascii_lower(F.col("tag")).alias("k"), "tag")
    lists = rows.groupBy(*POINT).agg(F.transform(F.array_sort(F.collect_set(entry)), lambda s: s["tag"]).alias("tags"))
    if enrich:
        lists = lists.withColumn("tags", F.transform("tags", G.enriched))
    return points.join(lists.where("name <> ''"), POINT, "left")


def tag_query(text: str, tags: DataFrame, points: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Tagged places that satisfy a query, by name; source tells what the first matching point is."""
    mode, terms = Q.parse(text)
    asked = tags.where(G.normalized(F.col("tag")).isin(terms)) if terms else tags  # others decide nothing
    sets = asked.groupBy(*POINT).agg(F.collect_set(G.normalized(F.col("tag"))).alias("norms"))
    hits = sets.where(Q.matches(text, F.col("norms"))).drop("norms")
    named = points.join(hits.select("name").distinct(), "name", "left_semi")  # goes below a merging of points by name
    pairs = in_cells(hits, LIST_TOLERANCE).alias("h").join(named.alias("w"), near_in_cell("w", "h", LIST_TOLERANCE), "left")
    found = pairs.groupBy(*(F.col(f"h.{c}") for c in POINT)).agg(F.min_by("w.bookmark", "w.ord").alias("own"))
    source = F.when(F.coalesce("own", F.lit(True)), "bookmark").otherwise("waypoint")
    out = found.select(*POINT, source.alias("source"), F.lit("tag").alias("class"), F.lit(mode).alias("type")).orderBy(F.lower("name"), *POINT)
    return out if cap is None else out.limit(cap)


def local_filter(points_with_tags: DataFrame, term: str) -> DataFrame:
    """Points with a tag that equals a term in any case; symbols are not translated."""
    return points_with_tags.where(F.exists("tags", lambda t: F.lower(t) == term.strip().lower()))


def completions(vocab: DataFrame, text: str, cap: int = 50) -> DataFrame:
    """tag: suggestions for the last operand of a query; vocab has pos, raw, display."""
    body = text.strip()[4:]
    head, op, last = "", "", body
    if m := re.match(r"(?is)^(.*)\s(AND|OR)\s(.*)$", body):
        head, op, last = m[1].strip() + " ", m[2].upper() + " ", m[3]
    fragment = last.strip().strip('"').strip()
    if fragment and re.fullmatch(r"[^A-Za-z0-9\s]+", fragment):
        hit = F.col("raw").startswith(fragment)
    elif fragment:
        low = fragment.lower()
        forms = [F.lower("raw"), F.lower("display"), G.symbol_form(F.col("raw")), G.symbol_form(F.col("display"))]
        hit = F.lit(False)
        for f in forms:
            hit = hit | f.contains(low)
    else:
        hit = F.lit(True)
    return vocab.where(hit).orderBy("pos").limit(cap).select("pos", "raw", F.concat(F.lit("tag:" + head + op), "raw").alias("name"))


def orphans(tags: DataFrame, points: DataFrame) -> DataFrame:
    """Tags whose place is no point, exactly compared."""
    return tags.join(points.select(*POINT).distinct(), POINT, "left_anti")


def inserted(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags with new ones: trimmed, blank ones skipped, present ones ignored."""
    rows = new.withColumn("tag", G.trimmed(F.col("tag"))).where("tag <> ''")
    return tags.unionByName(rows.select(*tags.columns)).dropDuplicates([*POINT, "tag"])


def deleted(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, [*POINT, "tag"], "left_anti")


def entered(text):
    """The tags of a comma-separated entry, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), G.trimmed), lambda t: t != ""))


def replies(tags: DataFrame, changed: DataFrame) -> DataFrame:
    """Name, lat, lon and all tags, in order and enriched one by one, of the places (name, lat, lon) whose tags changed; none is left out for its likeness to another."""
    entry = F.struct(ascii_lower(F.col("tag")).alias("k"), "tag")
    lists = tags.groupBy(*POINT).agg(F.array_sort(F.collect_set(entry)).alias("found"))
    rows = changed.select(*POINT).distinct().join(lists, POINT, "left")
    return rows.select(*POINT, F.transform(F.coalesce("found", F.array().cast("array<struct<k:string,tag:string>>")), lambda s: G.enriched(s["tag"])).alias("tags"))
