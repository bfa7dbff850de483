"""Alignment of two tokenizers by divide and conquer at shared cuts.

Each text is encoded by a byte-level BPE (A, of a space and the text) and by a
SentencePiece model (B, which adds the space). Where tokens of both end at one
byte offset, the text can be cut. An interval between two cuts is halved: from
its middle the nearest common end on each side is located by bisecting the
ends of one tokenizer for those of the other; what lies between the two is
without a cut and becomes a group, and both remaining parts are halved again.
All intervals of one depth, over all texts of a batch, are worked on together.

Tokens of A and B link where their bytes overlap. The different pairs of ids of
each document are stored with their numbers of links; an id pair's count is the
number of documents that hold it. The most frequent pairs (``FREQUENT_PAIRS`` at
most, whole powers of two of the count) are broadcast; all others meet their
counts in a shuffle, in which no key can be frequent.

Defined results: texts that are null, empty, or whose tokens' bytes differ from
a space and the text have no tokens, zeros and an empty string; very long texts
are aligned whole; repeated rows, rows with equal or null doc_ids are documents
of their own, each with a row in the result and each counted; an empty table
gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FREQUENT_PAIRS = 500_000
#: The words of byte-level BPE; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_LOADED: dict[int, TokenPair] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_bpe(model: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level BPE file whose ids are in order of its merges, and each id's bytes."""
    parts = json.loads(model)
    special = {t["id"] for t in parts["added_tokens"]}
    code = byte_of_character()
    ranks = {bytes(code[c] for c in token): i for token, i in parts["model"]["vocab"].items() if i not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in parts["model"]["merges"]]
    made = [parts["model"]["vocab"][m] for m in merged]
    if made != sorted(made) or len(made) + 256 != len(ranks):
        raise ValueError("the vocabulary's ids are not in order of its merges")
    of = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        of[i] = token
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), of


def piece_bytes(sp: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    n = sp.get_piece_size()
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places in a of the ends that a and b (ascending ends; the last is the same) share, ascending."""
    if len(a) < 2:
        return np.arange(len(a))
    found = [np.array([len(a) - 1])]
    lo, hi = np.array([0]), np.array([len(a) - 1])  # ends of a that may be cuts: lo <= place < hi
    while len(lo):
        mid = (lo + hi) >> 1
        left, right = mid.copy(), mid + 1
        # the nearest cut at or before the middle; lo - 1 if there is none
        open_ = np.arange(len(lo))
        while len(open_):
            at = left[open_]
            j = np.searchsorted(b, a[at], side="right") - 1  # the last end of b that is not after it
            before = np.where(j >= 0, b[j], -1)
            going = before != a[at]
            open_, before = open_[going], before[going]
            left[open_] = np.searchsorted(a, before, side="right") - 1
            open_ = open_[left[open_] >= lo[open_]]
        left = np.maximum(left, lo - 1)
        # the nearest cut after the middle, if the middle is none; hi if there is none
        exact = left == mid
        open_ = np.flatnonzero(~exact & (right < hi))
        while len(open_):
            at = right[open_]
            j = np.searchsorted(b, a[at], side="left")  # the first end of b that is not before it
            going = b[j] != a[at]
            open_, after = open_[going], b[j[going]]
            right[open_] = np.searchsorted(a, after, side="left")
            open_ = open_[right[open_] < hi[open_]]
        right = np.minimum(right, hi)
        found.append(left[left >= lo])
        found.append(right[~exact & (right < hi)])
        after = np.where(exact, left + 1, right + 1)
        lo, hi = np.concatenate([lo, after]), np.concatenate([left, hi])
        some = lo < hi
        lo, hi = lo[some], hi[some]
    return np.sort(np.concatenate(found))


class TokenPair:
    def __init__(self, byte_model: str, piece_model: bytes):
        self.a, a_bytes = byte_bpe(byte_model)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        b_bytes = piece_bytes(self.b)
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.a_bytes, self.b_bytes = np.array([*a_bytes, b""], object)[:-1], np.array([*b_bytes, b""], object)[:-1]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (a_bytes, b_bytes))
        numbers = [f"{i}" for i in range(max(self.n_a, self.n_b))]
        #: Ids as they stand in a group: of A, of A's last; of B, of B's last.
        self.words = np.array([f"{x}{end}" for n, end in ((self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")) for x in numbers[:n]], object)

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B of each text; none where their bytes are not a space and the text."""
        some = [t for t in texts if t]
        pieces = iter(self.b.encode(some, num_threads=1))
        none = np.zeros(0, np.int64)
        out = []
        for t in texts:
            if not t:
                out.append((none, none))
                continue
            a, b = np.array(self.a.encode_ordinary(f" {t}"), np.int64), np.array(next(pieces), np.int64)
            whole = b" " + t.encode()
            same = self.a_sizes[a].sum() == len(whole) == self.b_sizes[b].sum() and b"".join(self.b_bytes[b].tolist()) == whole == b"".join(self.a_bytes[a].tolist())
            out.append((a, b) if same else (none, none))
        return out

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """For each text its counts, the hash of its groups, and its different pairs of ids with their numbers of links."""
        coded = self.tokens(texts)
        n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in coded)]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])  # texts stand end to end, and where one ends is a cut
        a_cuts = shared_cuts(a_ends, b_ends)
        b_cuts = np.searchsorted(b_ends, a_ends[a_cuts])
        text_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(text_a[a_cuts], minlength=len(texts))
        # A's tokens of a group, then B's, then the next group
        kinds = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[a_cuts], last_b[b_cuts] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        b_before, a_before = np.concatenate([[0], b_cuts + 1]), np.concatenate([a_cuts + 1, [0]])
        kinds[np.arange(len(a)) + b_before[group_a]] = a + self.n_a * last_a
        kinds[np.arange(len(b)) + a_before[group_b]] = b + 2 * self.n_a + self.n_b * last_b
        words = self.words[kinds].tolist()
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        hashes = [hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]
        # every A token links with the B tokens from the one that covers its first byte to the one that covers its last
        first = np.searchsorted(b_ends, a_ends - self.a_sizes[a], side="right")
        many = np.searchsorted(b_ends, a_ends, side="left") - first + 1
        link_a = np.repeat(np.arange(len(a)), many)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + first[link_a]
        text_of, pair = text_a[link_a], a[link_a] * self.n_b + b[link_b]
        order = np.lexsort((pair, text_of))
        text_of, pair = text_of[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text_of[1:] != text_of[:-1])])) if len(pair) else np.zeros(0, np.int64)
        offsets = np.searchsorted(text_of[new], np.arange(len(texts) + 1)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
        times = np.diff(np.append(new, len(pair)))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(text_of, minlength=len(texts)), "groups_sha256": hashes, "pairs": lists(pair[new], pa.int64()), "times": lists(times, pa.int32())}


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def loaded(byte_model: str, piece_model: bytes) -> TokenPair:
    key = hash((byte_model, piece_model))
    if key not in _LOADED:
        _LOADED[key] = TokenPair(byte_model, piece_model)
    return _LOADED[key]


def encoded(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """row (a number of its own), doc_id, the counts and hash of each document, and its pairs (A id * B's size + B id) with their times."""
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        pair = loaded(*models.value)
        for b in batches:
            ids, rows, texts = b.column(1), b.column(0), b.column(2).to_pylist()
            done = 0
            while done < len(texts):  # about a million characters at a time
                upto, size = done, 0
                while upto < len(texts) and (upto == done or size + len(texts[upto] or "") < 1 << 20):
                    size += len(texts[upto] or "")
                    upto += 1
                found = pair.align(texts[done:upto])
                yield pa.RecordBatch.from_arrays([rows.slice(done, upto - done), ids.slice(done, upto - done), *(v if isinstance(v, pa.Array) else pa.array(v) for v in found.values())], names=["row", "doc_id", *found])
                done = upto

    common.tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(common.trimmed(run), ENCODED.format(id=kind))


def frequent_from(counts: DataFrame, most: int = FREQUENT_PAIRS) -> int:
    """The least power of two such that at most so many pairs have that count or more."""
    bins = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bin")).count().collect()  # 63 rows at most
    total, least = 0, 62
    for k, n in sorted(map(tuple, bins), reverse=True):
        total += n
        if total > most:
            break
        least = k
    return 1 << least


def align(docs: DataFrame, byte_path: str, piece_path: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """One row for each row of docs: tokens, groups, links, and sums over its links of what the corpus says of their pairs."""
    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    rows = common.stored(encoded(docs, byte_path, piece_path), "aligned")
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = common.stored(counts, "pair-counts")
    first = F.expr(f"pair div {size_b}")
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("high"))  # one row for each id of A
    known = counts.withColumn("a", first).join(highest, "a").select(F.col("pair").alias("known"), "n", (F.col("n") == F.col("high")).alias("best"))
    least = frequent_from(counts, frequent)
    links = rows.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    met = links.join(F.broadcast(known.where(F.col("n") >= least)), F.col("pair") == F.col("known"), "left")  # FREQUENT_PAIRS rows at most
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    often = met.where(F.col("known").isNotNull()).groupBy("row").agg(*sums)
    rest = common.stored(counts.where(F.col("n") < least).limit(1), "rest").count() > 0
    if rest:
        seldom = met.where(F.col("known").isNull()).select("row", "pair", "times").join(known.where(F.col("n") < least), F.col("pair") == F.col("known"))
        often = often.unionByName(seldom.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(often, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.read_table(spark, sf_dir, "documents"), *default_models())
