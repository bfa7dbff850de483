"""Token ids in ORC files, in ascending order of doc_id.

Each document's ids, with an end id, are one row of an ORC file. ORC stores
the id lists with integer run-length encoding in stripes that are read in
parallel, with row indexes and Bloom filters on doc_id, so that a lookup of
documents reads the stripes that may hold them. Files hold ranges of doc_id in
order; a row has the number of ids before it in its file, and the ids before
a file come from one sum for each file.

The tokenizer runs on one word at a time: this vocabulary's normalizer and
splitting rule never look across white space. The different words of a batch
are found with Arrow; plain letters with symbols behind them, as nearly all are,
are cut there, and the ids of each lower-case part are remembered. New parts of
letters are merged together, one piece after another. A text that holds the string of a special token is encoded as a whole.

Defined results: null and empty texts hold the end id alone; very long texts
are encoded whole; null doc_ids come first; rows with equal doc_ids are ordered
by their text, nulls first; an empty table gives files without rows, and no row
when they are read. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

END_ID = 1
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
CACHE_WORDS = 400_000
#: Letters whose lower case is one letter and whose composed form is themselves; a run of them is one piece, and so is one of symbols behind it.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u0513]"
PLAIN = re.compile(f"{LETTERS}+").fullmatch
#: ASCII's symbols without the apostrophe, which has rules of its own.
WORD = rf"^(?P<head>{LETTERS}*)(?P<tail>[!-&(-/:-@\[-`{{-~]*)$"
_LOADED: dict[int, WordTokenizer] = {}


class WordTokenizer:
    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(model)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces = self._pieces(json.loads(model))
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, model: dict):
        """The same merges on lower-case pieces between spaces, or None if ids do not tell where a piece ends."""
        from tokenizers import Tokenizer, pre_tokenizers

        end, vocab = model["model"].get("end_of_word_suffix"), model["model"]["vocab"]
        if not end or any(c + end not in vocab for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(end)]] = True
        pieces = Tokenizer.from_str(json.dumps({**model, "normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return pieces

    def learn(self, parts: list[str]) -> None:
        """Puts the ids of parts of words, as bytes, into the newer half of what is remembered."""
        known, older, plain, other = self.newer, self.older, [], []
        for w in parts:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            else:
                (plain if self.pieces is not None and PLAIN(w) else other).append(w)
        if plain := list(dict.fromkeys(plain)):
            ids = np.array(self.pieces.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int32)
            cuts, flat = [0, *(4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()], ids.tobytes()
            known.update(zip(plain, (flat[i:j] for i, j in pairwise(cuts)), strict=True))
        for w, coded in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = array("i", coded.ids).tobytes()

    def ids_of(self, parts: list[str]) -> list[bytes]:
        known = list(map(self.newer.get, parts))
        new = [w for w, ids in zip(parts, known, strict=True) if ids is None]
        if not new:
            return known
        if len(self.newer) + len(new) > CACHE_WORDS:
            self.older, self.newer, new = self.newer, {}, parts
        self.learn(new)
        return [self.newer[w] if ids is None else ids for w, ids in zip(parts, known, strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool)
        for t in self.special:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(special)
        plain = pc.if_else(pa.array(~special), texts, "") if len(whole) else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        cut = pc.extract_regex(words.dictionary, WORD)
        heads = pc.if_else(cut.is_valid(), pc.utf8_lower(cut.field("head")), words.dictionary).dictionary_encode()
        tails = pc.if_else(cut.is_valid(), cut.field("tail"), "").dictionary_encode()
        ids = self.ids_of([*heads.dictionary.to_numpy(zero_copy_only=False), *tails.dictionary.to_numpy(zero_copy_only=False)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        both = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], axis=1).ravel()
        flat, sizes = _runs(np.frombuffer(b"".join(ids), np.int32), sizes, both)
        flat, sizes = _runs(flat, sizes.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()]
        counts = np.diff(ends)
        if len(whole):
            coded = [self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids for k in whole.tolist()]
            counts[whole] = [len(c) for c in coded]
            flat = np.insert(flat, np.repeat(ends[whole], counts[whole]), np.array(list(chain.from_iterable(coded)), np.int32))
        return flat, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        flat, counts = self.encode_column(pa.array(texts, pa.string()))
        return [flat[i:j].tobytes() for i, j in pairwise([0, *np.cumsum(counts).tolist()])]


def _runs(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes that make up flat: those numbered which, one after the other, and their sizes."""
    n = sizes[which]
    move = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
    return flat[np.arange(n.sum()) + np.repeat(move, n)], n


def loaded(model: str) -> WordTokenizer:
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = WordTokenizer(model)
    return _LOADED[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, model_path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes doc_id, part, before (ids before it in the part), n and the n ids to ORC files in ascending order of doc_id."""
    spark = docs.sparkSession
    common.tune(spark)
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", "text").repartitionByRange(parts or common.shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        tokenizer, before = loaded(model.value), 0
        for b in batches:
            coded, counts = tokenizer.encode_column(b.column(1))
            ends = np.concatenate([[0], np.cumsum(counts + 1)])
            flat = np.insert(coded, np.cumsum(counts), end_id)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), ids], names=["doc_id", "part", "before", "n", "ids"])
            before += int(ends[-1])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    options = {"compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true", "orc.row.index.stride": str(INDEX_ROWS), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.mapInArrow(common.trimmed(run), schema).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids, those rows alone, found by stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def summarize(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_tokens() gives."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            offsets, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    schema = T.StructType([tokens.schema["doc_id"], tokens.schema["part"], tokens.schema["before"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    common.tune(tokens.sparkSession)
    rows = tokens.select("doc_id", "part", "before", "ids").mapInArrow(common.trimmed(run), schema)
    ends = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("size"))  # one row for each part
    starts = ends.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("first"))
    return rows.join(starts, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write_tokens(common.read_table(spark, sf_dir, "documents"), path, default_model())
    return summarize(read_tokens(spark, path))
