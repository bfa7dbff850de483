"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

A test item gives windows of ``WINDOW`` consecutive words (one shorter window
if it has fewer). The corpus is read once for the frequency of every test
term, and once for the index: the postings (term, document, position) of the
terms that are among the rarest of some window, each with the words around it,
stored in the shared folder. The posting lists of a window's rarest terms,
shifted by their offsets in the window, are intersected; the words around the
rarest term then decide whether the whole window stands there.

Where there are more test terms than may be broadcast, a bit filter of fixed
size takes their place in both reads, so no token of the corpus is exchanged
before it has passed. Frequencies are then counted before they meet the terms.
Postings of words that only pass the filter are stored too, and meet no term
later. Of the rarest terms, the BROADCAST_ROWS most frequent are still
broadcast; only lists shorter than theirs are exchanged by term.

Words are runs of letters and digits after A-Z are lower-cased; characters
beyond ASCII count as letters. Terms are looked up in the lower case of all
scripts, which is quick and misses nothing; whole windows are compared in the
case that the words have.

Defined results: null and empty texts have no words and are clean; items
without words give no window; repeated rows are judged alike, each with a row
in the result; rows with equal or null doc_ids and different texts are judged
one by one; very long texts are searched whole; an empty table of documents
gives no row, one of items leaves all documents clean; other columns are left
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, RAREST = 10, 2
#: Test tables of up to so many rows (terms, or WINDOW words and their offsets) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Words of 64 bits in the filter of test terms, which is broadcast at any number of terms.
FILTER_WORDS = 1 << 18
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands behind the last word of each document; no word equals it.
LAST = "\n"


def raw_words(text: Column) -> Column:
    """The words of a text before they are lower-cased; the first and the last may be empty strings."""
    return F.split(F.coalesce(text, F.lit("")), BREAKS, -1)


def lowered(words: Column) -> Column:
    return F.transform(words, common.ascii_lower)


def word_count(words: Column) -> Column:
    edge = lambda at: F.when(F.element_at(words, at) == "", 1).otherwise(0)
    return (F.size(words) - edge(1) - F.when(F.size(words) > 1, edge(-1)).otherwise(0)).cast("long")


def bits_of(terms: DataFrame) -> DataFrame:
    """slot, bits: a filter of terms with one hash, FILTER_WORDS rows at most."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term) div {FILTER_WORDS}, 64) as int))")
    return terms.select(F.pmod(F.xxhash64("term"), F.lit(FILTER_WORDS)).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def passing(tokens: DataFrame, bits: DataFrame) -> DataFrame:
    """The tokens whose term may be one of the filter's; no term of it is missed."""
    keyed = tokens.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(FILTER_WORDS)))
    met = keyed.join(F.broadcast(bits), "slot")
    return met.where(F.expr(f"getbit(bits, cast(pmod(xxhash64(term) div {FILTER_WORDS}, 64) as int)) = 1")).drop("slot", "bits")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (a number), words, and ids of the items of each different window."""
    words = items.select("item_id", lowered(F.filter(raw_words(F.col("text")), lambda w: w != "")).alias("all")).where(F.size("all") > 0)
    starts = words.select("item_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("i"))
    each = starts.select("item_id", F.slice("all", F.col("i") + 1, window).alias("words"))
    return each.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("win", F.sha2(F.array_join("words", " "), 256))


class PositionalIndex:
    """Postings of the rarest terms of each window, over all documents.

    terms: win, term, offset, df, rank (1: rarest), lists (ranks of the window), words.
    postings: doc_id, text_key, n_words, term, pos, around, around_from. The
    term LAST has one row for each row of the documents.
    """

    def __init__(self, terms: DataFrame, n_terms: int, postings: DataFrame, window: int):
        self.terms, self.n_terms, self.postings, self.window = terms, n_terms, postings, window

    @classmethod
    def build(cls, docs: DataFrame, windows: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> PositionalIndex:
        positions = windows.select("win", "words", F.posexplode(F.transform("words", F.lower)).alias("offset", "term")).groupBy("win", "words", "term").agg(F.min("offset").alias("offset"))
        positions = common.stored(positions, "test-terms")
        vocabulary = positions.select("term").distinct()
        n = vocabulary.count()
        found = docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
        if n <= BROADCAST_ROWS:
            frequency = found.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
        else:
            frequency = passing(found, bits_of(vocabulary)).groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term")
        order = Window.partitionBy("win").orderBy("df", "term")
        size = F.count("*").over(Window.partitionBy("win"))
        ranked = positions.join(frequency, "term", "left").withColumn("seen", F.count("df").over(Window.partitionBy("win"))).withColumn("distinct", size)
        ranked = ranked.where(F.col("seen") == F.col("distinct")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rarest)
        terms = common.stored(ranked.select("win", "term", "offset", "df", "rank", F.least("distinct", F.lit(rarest)).alias("lists"), "words"), "rarest-terms")
        n_terms = terms.count()
        wanted = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(LAST).alias("term")))
        rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw_words(F.col("text")).alias("words"))
        rows = rows.withColumn("n_words", word_count(F.col("words")))
        tokens = rows.select("doc_id", "text_key", "n_words", "words", F.posexplode(F.array_append("words", F.lit(LAST))).alias("pos", "word")).withColumn("term", F.lower("word"))
        low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        around = F.when(F.col("term") != LAST, F.slice("words", low + 1, F.col("pos") - low + window))
        met = tokens.join(F.broadcast(wanted), "term") if n_terms <= BROADCAST_ROWS else passing(tokens, bits_of(wanted))
        postings = met.select("doc_id", "text_key", "n_words", "term", "pos", around.alias("around"), low.alias("around_from"))
        return cls(terms, n_terms, common.stored(postings, "postings"), window)

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == LAST).select("doc_id", "text_key", "n_words")

    def lists(self, terms: DataFrame) -> DataFrame:
        """The postings of terms, each with its rows of terms."""
        postings = self.postings.where(F.col("term") != LAST)
        if self.n_terms <= BROADCAST_ROWS:
            return postings.join(F.broadcast(terms), "term")
        limit = terms.select("df").orderBy(F.desc("df")).offset(BROADCAST_ROWS).limit(1).agg(F.max("df")).first()[0] or 0
        often, rest = terms.where(F.col("df") > limit), terms.where(F.col("df") <= limit)
        short = postings.join(F.broadcast(often.select("term").distinct()), "term", "left_anti")
        return postings.join(F.broadcast(often), "term").unionByName(short.join(rest, "term"))

    def exact(self) -> DataFrame:
        """doc_id, text_key, win, start, length of each place where a whole window stands."""
        lists = self.lists(self.terms)
        start = F.col("pos") - F.col("offset")
        whole = F.when((F.col("rank") == 1) & (start >= F.col("around_from")), lowered(F.slice("around", F.greatest(start - F.col("around_from"), F.lit(0)) + 1, F.size("words"))) == F.col("words"))
        adjusted = lists.where(start >= 0).select("doc_id", "text_key", "win", start.alias("start"), F.size("words").alias("length"), "rank", "lists", whole.alias("whole")).where((F.col("rank") > 1) | F.col("whole"))
        both = adjusted.groupBy("doc_id", "text_key", "win", "start", "length", "lists").agg(F.count_distinct("rank").alias("met"), F.max("whole").alias("whole"))
        return both.where((F.col("met") == F.col("lists")) & F.col("whole")).select("doc_id", "text_key", "win", "start", "length")

    def near(self, slop: int) -> DataFrame:
        """doc_id, text_key, win, pos of each place of a window's rarest term with all its words, in any order, at most slop words away (slop below the window's length)."""
        if not 0 < slop < self.window:
            raise ValueError("slop must be from 1 to the window's length less 1")
        lists = self.lists(self.terms.where("rank = 1"))
        low = F.greatest(F.col("pos") - slop, F.lit(0))
        words = lowered(F.slice("around", low - F.col("around_from") + 1, F.col("pos") - low + slop + 1))
        return lists.where(F.size(F.array_except("words", words)) == 0).select("doc_id", "text_key", "win", "pos")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: its words, hit words and the items whose windows occur."""
    windows = common.stored(windows_of(items, window), "windows")
    index = PositionalIndex.build(docs, windows, window)
    hits = common.stored(index.exact(), "hits")
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans.withColumn("covered", covered).groupBy("doc_id", "text_key").agg(F.sum("covered").alias("n_hit"))
    met = hits.select("doc_id", "text_key", "win").distinct().join(windows.select("win", "items"), "win")
    item_ids = met.select("doc_id", "text_key", F.explode("items").alias("item")).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = n_hit.join(item_ids.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n_hit", "items")
    rows = index.documents().join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")), "left")
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return rows.select("doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; each row is judged by its own text."""
    key, same_id, same_key = (common.free_name(docs, c) for c in ("text_hash", "found_id", "found_hash"))
    found = decontaminate(docs, common.read_table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(same_id), F.col("text_key").alias(same_key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col(same_id)) & (F.col(key) == F.col(same_key)), "left_anti").drop(key)
