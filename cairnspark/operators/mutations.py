"""Keyed changes to point lists as transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.identity import FILE_TOLERANCE, first_matches, first_of_each, matching


def appended(points: DataFrame, new: DataFrame) -> DataFrame:
    """points with those of new that match none, in file tolerance; of equal new ones the first."""
    fresh = matching(first_of_each(new, "ord"), points, FILE_TOLERANCE, "left_anti")
    return points.unionByName(fresh.select(*points.columns))


def duplicates(points: DataFrame, new: DataFrame) -> DataFrame:
    return matching(new, points, FILE_TOLERANCE)


def deleted(points: DataFrame, gone: DataFrame, tolerance: float = FILE_TOLERANCE) -> DataFrame:
    """points without any that match."""
    return matching(points, gone, tolerance, "left_anti")


def first_deleted(points: DataFrame, gone: DataFrame, tolerance: float) -> DataFrame:
    """points without the first bookmark that matches each of gone."""
    hit = first_matches(points.where("bookmark"), gone, tolerance).select(F.col("match_ord").alias("ord")).distinct()
    return points.join(hit, "ord", "left_anti")


def first_renamed(points: DataFrame, renames: DataFrame, tolerance: float = FILE_TOLERANCE) -> DataFrame:
    """points with the first match of each rename (name, lat, lon, new_name) renamed."""
    hit = first_matches(points, renames, tolerance).groupBy("match_ord").agg(F.min("new_name").alias("new_name"))
    return points.join(hit, points["ord"] == hit["match_ord"], "left").withColumn("name", F.coalesce("new_name", "name")).drop("match_ord", "new_name")


def tags_replaced(points: DataFrame, changes: DataFrame, tolerance: float) -> DataFrame:
    """points (with tags) whose match in changes has other tags take those."""
    hit = first_matches(points, changes.select("name", "lat", "lon", F.col("tags").alias("new_tags")), tolerance)
    best = hit.groupBy("match_ord").agg(F.min("new_tags").alias("new_tags"))
    return points.join(best, points["ord"] == best["match_ord"], "left").withColumn("tags", F.coalesce("new_tags", "tags")).drop("match_ord", "new_tags")


def new_errors(requests: DataFrame) -> DataFrame:
    """requests with the reason for which one is refused, else null."""
    from cairnspark.functions.scalars import trimmed

    return requests.withColumn("error", F.when(F.coalesce(trimmed(F.col("name")), F.lit("")) == "", "name is required").when(F.col("lat").try_cast("double").isNull() | F.col("lon").try_cast("double").isNull(), "invalid coordinates"))


def with_time(points: DataFrame, now: str) -> DataFrame:
    """points whose missing time is now (RFC 3339 in UTC)."""
    return points.withColumn("time", F.coalesce(F.nullif(F.col("time"), F.lit("")), F.lit(now)))


def upserted(points: DataFrame, rows: DataFrame) -> DataFrame:
    """points with rows in place of those of the same ord, and the others of rows behind."""
    return points.join(rows.select("ord"), "ord", "left_anti").unionByName(rows.select(*points.columns))


def imported(points: DataFrame, files: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list after an import of files (path, value), and its summary.

    Copied files are parsed; their points follow those of the list, and the
    whole is de-duplicated. The summary has count (points parsed), files and
    skipped (numbers of files), and dedup_count (points in all).
    """
    from cairnspark.sources.gpx import parse_gpx

    plan = import_plan(files.select("path"), existing)
    parsed = parse_gpx(files.join(plan.where("state = 'copied'").select("path"), "path", "left_semi"))
    both = points.select(F.lit(0).alias("rank"), F.lit("").alias("path"), F.col("ord").alias("pos"), "name", "lat", "lon")
    both = both.unionByName(parsed.select(F.lit(1).alias("rank"), "path", F.col("pos").cast("long").alias("pos"), "name", "lat", "lon"))
    merged = first_of_each(both, "rank", "path", "pos")
    names = ("count", "files", "skipped", "dedup_count")
    parts = [(parsed, {"count": F.count("*")}), (plan, {s: F.count_if(F.col("state") == t) for s, t in (("files", "copied"), ("skipped", "skipped"))}), (merged, {"dedup_count": F.count("*")})]
    rows = [df.agg(*(counts.get(n, F.max(F.lit(0).cast("long"))).alias(n) for n in names)) for df, counts in parts]
    return merged, reduce(DataFrame.unionByName, rows).agg(*(F.sum(n).alias(n) for n in names))


def import_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """path, base, state: the first file of each base name that is not there is copied, others are skipped."""
    from cairnspark.functions.scalars import base_name

    rows = files.withColumn("base", base_name(F.col("path")))
    first = rows.groupBy("base").agg(F.min_by("path", F.split("path", "/")).alias("first"))  # combines before the exchange
    known = existing.select("base", F.lit(True).alias("known")).distinct()
    # a path that is named twice counts once
    marked = rows.distinct().join(first, "base").join(known, "base", "left")
    return marked.select("path", "base", F.when(F.col("known") | (F.col("path") != F.col("first")), "skipped").otherwise("copied").alias("state"))


def skipped(plan: DataFrame) -> DataFrame:
    """The files that an import leaves out, for its reply."""
    return plan.where("state = 'skipped'").select("path", "base")
