"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Two multinomials over ``BUCKETS`` hashed features (words and pairs of
neighbouring words) are counted: the raw one over every document, the trusted
one over documents with a label of quality 1. A document's score is the mean,
over its features, of the logarithm of trusted over raw probability, in
fixed-point numbers, so that sums do not depend on their order.

A part of the trusted documents (``HELD_OUT``) is counted in the raw
multinomial alone, as an unlabelled document is. Every document is then kept if
its score reaches the one that all but ``LOSS`` of those held-out documents
reach; scores are compared in steps of ``STEP``, so the limit comes from a
table of at most a few thousand counts and is the same in each run.

The counts, the limit, the scores and the rules cover every document and every
trusted id, each of which has one of the two parts. Up to ``BROADCAST_ROWS``
trusted ids are broadcast; more of them meet the documents in a shuffle, which
rows without a doc_id stay out of. What is gathered from the corpus is one pair
of counts for each bucket, whatever the input.

Defined results: null, empty and blank texts have no words and fail the rules;
very long texts are judged whole, in time that grows with n log n; repeated
rows are judged alike, each with a row in the result; rows with equal or null
doc_ids are judged one by one; labels with a null doc_id or quality are left
out, and a doc_id is trusted if one of its labels is; without trusted or
without held-out documents, or on an empty table, the ratio decides nothing and
the rules alone do; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, PRIOR = 1 << 16, 8.0
#: Of five parts of the trusted documents one sets the limit; it may lose LOSS of them.
HELD_OUT, LOSS = 5, 0.002
#: So many trusted ids are broadcast; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Numbers a unit of the logarithm, and how many of them are a step of the limit.
UNIT, STEP = 1 << 20, 1 << 10
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def pairs_of(hashes: Column) -> Column:
    """One hash for each two neighbours."""
    rest = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, rest), F.slice(hashes, 2, rest), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words' hashes h and pairs' hashes p."""
    return docs.withColumn("h", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))).withColumn("p", pairs_of(F.col("h")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id and held (it sets the limit) of all documents with a label of quality 1."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return common.stored(good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")


def met(ids: DataFrame, few: bool) -> DataFrame:
    """ids to join with: broadcast, or shuffled whatever size Spark takes them for."""
    return F.broadcast(ids) if few else ids.hint("merge")


def marked(docs: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """text and good: 1 if the row's doc_id is one of ids, else 0."""
    ids = met(ids.select(F.col("doc_id").alias("good_id")), few)
    rows, null = docs.select("doc_id", "text"), F.col("doc_id").isNull()
    out = (rows if few else rows.where(~null)).join(ids, F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().cast("long").alias("good"))
    return out if few else out.unionAll(rows.where(null).select("text", F.lit(0).cast("long").alias("good")))  # else they would meet in one task


def feature_counts(docs: DataFrame, trusted: DataFrame, few: bool = True) -> DataFrame:
    """bucket, raw and good (occurrences in all and in the trusted documents); one row a bucket at most."""
    each = hashed(marked(docs, trusted.where("not held"), few)).select("good", F.explode(F.concat("h", "p")).alias("f"))
    return each.groupBy(bucket(F.col("f")).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("good").alias("good"))


def weights(counts: DataFrame) -> list[int] | None:
    """The fixed-point logarithm of each bucket's two probabilities' ratio; None without trusted features."""
    counts = common.stored(counts, "counts")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    if not good:
        return None
    share = PRIOR * good / raw  # the prior of both is the same distribution, so unseen features weigh little
    value = F.log((F.col("good") + share) / (good + share * BUCKETS)) - F.log((F.col("raw") + PRIOR) / (raw + PRIOR * BUCKETS))
    out = [0] * BUCKETS
    for b, w in counts.select("bucket", F.round(value * UNIT).cast("long")).collect():  # at most BUCKETS rows
        out[b] = w
    return out


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def repeated(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"]))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    starts = F.transform(F.array(placed), repeated)[0]
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, first, lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")), lambda acc: acc["n"].cast("long"))


def measured(docs: DataFrame, weight: list[int] | None) -> DataFrame:
    """The rules' numbers of each document, and the sum of its features' weights."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.select("doc_id", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.withColumn("p", pairs_of(F.col("h")))
    whole = F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))
    windows = F.transform(F.slice("p", 1, whole), lambda x, i: F.xxhash64(x, F.get(F.col("p"), i + 2), F.get(F.col("h"), i + 4)))
    table = F.split(F.lit(",".join(map(str, weight))), ",").cast("array<bigint>") if weight else F.array(F.lit(0).cast("long"))  # a literal once the plan is optimised
    place = bucket if weight else lambda _: F.lit(0)
    total = F.aggregate(F.concat("h", "p"), F.lit(0).cast("long"), lambda acc, f: acc + F.get(table, place(f)))
    rows = rows.withColumn("w", windows).withColumn("ratio_sum", total).drop("h", "p")
    repeats = F.when(F.size(F.array_distinct("w")) < F.size("w"), _covered(F.col("w"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("n_repeat_words", repeats).withColumn("n_features", F.greatest(2 * F.col("n_words") - 1, F.lit(0).cast("long"))).drop("w")


def limit(scored: DataFrame, trusted: DataFrame, few: bool = True) -> int | None:
    """The step that all but LOSS of the held-out trusted documents reach; None without any."""
    held = scored.where("n_features > 0").select("doc_id", "step").join(met(trusted.where("held").select("doc_id"), few), "doc_id")
    steps = sorted(map(tuple, held.groupBy("step").count().collect()))  # as many rows as steps, a few thousand at most
    allowed = int(sum(n for _, n in steps) * LOSS)
    for step, n in steps:
        if n > allowed:
            return step
        allowed -= n
    return None


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rules' numbers, base_failed, kept, and score (the mean logarithm of the ratio; null without words)."""
    trusted = trusted_ids(labels)
    few = trusted.count() <= BROADCAST_ROWS
    weight = weights(feature_counts(docs, trusted, few))
    step = F.expr(f"ratio_sum div ({STEP} * greatest(n_features, 1)) - if(ratio_sum < 0, 1, 0)")  # a division that rounds down, but for multiples below zero
    scored = common.stored(measured(docs, weight).withColumn("step", step), "scored")
    least = limit(scored, trusted, few) if weight else None
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    reached = F.lit(True) if least is None else F.col("step") >= least
    score = F.when(F.col("n_features") > 0, F.col("ratio_sum") / (F.col("n_features") * UNIT))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & reached).alias("kept"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
