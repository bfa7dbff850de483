"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of its bytes up to ``ORDER`` bytes deep, with
frozen counts. A context with N occurrences and q distinct followers gives a
follower seen n times the probability n / (N + q) and the escape q / (N + q)
(method C, no exclusion); an escape goes one byte shorter, at the end to a
uniform choice of 256. Contexts that a language never saw cost nothing and are
skipped. The code length of a text is the exact sum over its bytes, and the
language of the shortest code wins.

A text is in no language if its contexts tell nothing: the shortest code is
longer than that of a coder without contexts (the frequencies of bytes in all
training texts together, or 8 bits a byte where those do worse), and so are the
codes of more than half of its words, taken one by one, in every language. The
second test keeps texts with a long secret or in two languages; neither has a constant that is set by hand, and
both are the same for texts of every length.

The trees of all languages are laid out as tables, one row for each context
and byte with a code length per language, so that a batch of texts is scored
with a few array lookups a byte.

Defined results: null texts and texts without a letter are ``und`` with score
0; equal code lengths go to the language that sorts first; without labelled
rows all is ``und``. Rows are judged one by one, so repeated ids and null ids
make no difference, and other columns are passed through; very long texts are
read whole, in slices; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 3
#: The classifier is fitted on a bounded sample: whole texts of so many labelled rows for each language.
SAMPLE_PER_LANG = 400
SLICE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> list[tuple[str, bytes]]:
    """(lang, text) of the rows with the smallest hashes of doc_id in each language, held-out rows apart."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "doc_id", F.xxhash64("text").alias("hash"), "text")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "hash"))
    # the first ones of each share of a language, and of those the first ones of the language
    picked = rows.select("lang", "doc_id", "hash").withColumn("share", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(64)))
    picked = picked.withColumn("rank", first("lang", "share")).where(F.col("rank") <= per_lang).withColumn("rank", first("lang")).where(F.col("rank") <= per_lang)
    sample = rows.join(F.broadcast(picked.select("lang", "doc_id", "hash").distinct()), ["lang", "doc_id", "hash"])  # per_lang rows of each language at most
    return sorted({(r[0], r[3].encode()): None for r in sample.dropDuplicates(["lang", "doc_id", "hash"]).collect()})


class PpmModel:
    """Frozen context trees of several languages as lookup tables."""

    def __init__(self, langs, symbol, n_symbols, context_rows, bases, costs, plain):
        self.langs, self.symbol, self.n_symbols, self.plain = langs, symbol, n_symbols, plain
        self.context_rows, self.bases, self.costs = context_rows, bases, costs

    @classmethod
    def fit(cls, rows: list[tuple[str, bytes]]) -> PpmModel:
        langs = sorted({lang for lang, _ in rows})
        if not langs:
            return cls([], np.zeros(256, np.int64), 1, [], [], np.zeros((0, 0), np.float32), np.full(256, 8.0))
        counts = np.zeros(256)
        for _, text in rows:
            counts += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        seen = counts > 0
        n, q = counts.sum(), max(1, int(seen.sum()))
        plain = np.full(256, np.log2(n + q) - np.log2(q) + 8.0)  # an escape and a uniform byte, as in the trees
        plain[seen] = np.log2(n + q) - np.log2(counts[seen])
        a = int(seen.sum()) + 1  # the last symbol stands for all bytes that training never saw
        symbol = np.full(256, a - 1, np.int64)
        symbol[seen] = np.arange(a - 1)
        grams = []  # by language and order: distinct context+symbol numbers and their counts
        for lang in langs:
            parts = [symbol[np.frombuffer(t, np.uint8)] for name, t in rows if name == lang]
            flat = np.concatenate(parts)
            at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
            del parts
            by_order, code = [], flat.copy()
            for k in range(ORDER + 1):
                if k:
                    code[k:] += flat[:-k] * a**k
                by_order.append(np.unique(code[at >= k], return_counts=True))
            grams.append(by_order)
        del flat, at, code
        context_rows, bases, base, shorter_rows, shorter_row = [], [], 0, [], np.zeros(1, np.int32)
        for k in range(ORDER + 1):
            contexts = np.unique(np.concatenate([g[k][0] // a for g in grams] + [np.zeros(int(k == 0), np.int64)]))
            row = np.full(a**k, -1, np.int32)
            row[contexts] = np.arange(len(contexts))
            context_rows.append(row)
            bases.append(base)
            shorter_rows.append(shorter_row[contexts % a ** max(0, k - 1)])
            base += len(contexts) * a
            shorter_row = row
        costs = np.empty((len(langs), base), np.float32)
        for j, g in enumerate(grams):  # one language after the other, so that one is held in double precision
            cost = np.full((1, a), 8.0)  # order -1: a uniform byte
            for k, (codes, counts) in enumerate(g):
                cost = cost[shorter_rows[k]]
                at, follower = context_rows[k][codes // a], codes % a
                total = np.bincount(at, counts, len(cost))
                kinds = np.bincount(at, minlength=len(cost))
                have = np.flatnonzero(total > 0)
                escape = np.zeros(len(cost))
                escape[have] = np.log2(total[have] + kinds[have]) - np.log2(kinds[have])
                cost += escape[:, None]
                cost[at, follower] = np.log2(total[at] + kinds[at]) - np.log2(counts)
                costs[j, bases[k] : bases[k] + cost.size] = cost.ravel()
        return cls(langs, symbol, a, context_rows, bases, costs, plain)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language: rows by languages."""
        n, a = len(offsets) - 1, self.n_symbols
        bits = np.zeros((n, len(self.langs)))
        first = 0
        while first < n:  # whole texts, as many as fit; a longer text goes in slices that see the bytes before them
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
            lo, hi = int(offsets[first]), int(offsets[last])
            for start in range(lo, hi, SLICE):
                stop = min(hi, start + SLICE)
                back = min(ORDER, start - lo)
                s = self.symbol[data[start - back : stop]]
                cuts = np.unique(np.clip(offsets[first:last], start, stop))
                cuts = cuts[cuts < stop]
                owner = np.searchsorted(offsets, cuts, "right") - 1
                at = np.arange(start, stop) - np.repeat(offsets[owner], np.diff(np.append(cuts, stop)))
                index = np.empty(stop - start, np.int64)
                todo = None
                code = [s[back:]]
                for k in range(1, ORDER + 1):
                    lead = np.zeros(stop - start, np.int64)
                    if k <= back:
                        lead[:] = s[back - k : len(s) - k]
                    else:
                        lead[k - back :] = s[: len(s) - k]
                    code.append(code[-1] + lead * a**k)
                for k in range(ORDER, -1, -1):
                    if todo is None:
                        row = self.context_rows[k][code[k] // a]
                        good = (row >= 0) & (at >= k)
                        index[:] = self.bases[k] + row.astype(np.int64) * a + code[0]
                        todo = np.flatnonzero(~good)
                    elif len(todo):
                        c = code[k][todo]
                        row = self.context_rows[k][c // a].astype(np.int64)
                        good = (row >= 0) & (at[todo] >= k)
                        hit = todo[good]
                        index[hit] = self.bases[k] + row[good] * a + code[0][hit]
                        todo = todo[~good]
                for j in range(len(self.langs)):
                    sums = np.add.reduceat(self.costs[j][index], cuts - start, dtype=np.float64)
                    bits[owner, j] += sums
            first = last
        return bits

    def plain_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text without any context: by the bytes' frequencies, or 8 a byte where that is less."""
        sums = np.concatenate([[0.0], np.cumsum(self.plain[data])])
        return np.minimum(sums[offsets[1:]] - sums[offsets[:-1]], 8.0 * np.diff(offsets))

    def words_told(self, data: np.ndarray) -> bool:
        """Whether contexts of some language shorten the codes of half of a text's words or more; a word has the white space behind it."""
        white = WHITE[data]
        starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        cuts = np.append(starts, len(data))
        return 2 * int((self.code_lengths(data, cuts).min(axis=1) <= self.plain_lengths(data, cuts)).sum()) >= len(starts)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """By text its language, the score, and whether it is in any language at all."""
        data, offsets = common.texts_of(texts)
        values = texts.to_pylist()
        letters = np.array([bool(v and LETTER.search(v)) for v in values], bool)
        if not self.langs:
            return ["und"] * len(values), np.zeros(len(values)), np.zeros(len(values), bool)
        bits = self.code_lengths(data, offsets)
        best = bits.argmin(axis=1)
        shortest = bits[np.arange(len(bits)), best]
        share = 1.0 / np.exp2(np.maximum(shortest[:, None] - bits, -1000.0)).sum(axis=1)
        told = letters & (shortest <= self.plain_lengths(data, offsets))
        for k in np.flatnonzero(letters & ~told):
            told[k] = self.words_told(data[offsets[k] : offsets[k + 1]])
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, share, 0.0), told


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> PpmModel:
    model = PpmModel.fit(training_rows(docs, per_lang))
    common.release()  # the driver's memory is small, and free pieces of it would stay
    return model


def identify(docs: DataFrame, model: PpmModel, text: str = "text", pred: str = "lang_pred", score: str = "score", told: str | None = None) -> DataFrame:
    """docs with the predicted language of each whole text, its share of 2^-bits among the languages and, if asked for, whether the text is in any of them at all."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)
    common.release()
    schema = common.with_columns(docs.schema, T.StructField(pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False), *([T.StructField(told, T.BooleanType(), False)] if told else []))

    def run(batches):
        ppm = shared.value
        for b in batches:
            langs, shares, known = ppm.predict(b.column(b.schema.get_field_index(text)))
            more = [pa.array(langs, pa.string()), pa.array(shares, pa.float64()), *([pa.array(known, pa.bool_())] if told else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return docs.mapInArrow(common.trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language, those without a letter among them; others keep their columns."""
    pred, score, told = (common.free_name(docs, c) for c in ("lang_pred", "score", "told"))
    return identify(docs, fit(docs), pred=pred, score=score, told=told).where(told).select(*(F.col(f"`{c}`") for c in docs.columns))
