"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the merge result of its text exactly if every two
neighbours are: re-merging their joined text gives the same two pieces. So the
encoder walks forward with the longest piece an Aho-Corasick automaton finds
at each place, tests it against the piece before it, tries shorter ones when
they do not go together, and steps back when none is left; a bitfield of
failed places keeps it from entering one twice.

The text is cut where no piece can cross: before each run of word marks, and
around line ends if no piece holds one. Runs of several word marks are merged
directly, as their pieces all have the same score and order then depends on
the place. Short units are remembered, so each frequent word is encoded once
in a worker, or where encode() shares it with other stages, in a task.

Defined results: null and empty texts have no ids; characters without a piece
become byte pieces; very long texts are encoded whole; rows are encoded one by
one, so repeated ids and null ids make no difference; an empty table gives no
row. digests() leaves other columns out. encode() passes them through and takes
the names of its new columns as they are, so where the table may have them
already, ask common.free_name() for others, as the pipeline's stages do.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Units that a task remembers, and the longest that it does.
CACHE_UNITS, CACHE_CHARS = 250_000, 48
#: Punctuation before which units may end, if the vocabulary allows it.
CUTS = ",.;:!?"
_LOADED: dict[int, BacktrackingBpe] = {}


class _Units(dict):
    """Ids of units met so far; the older half is dropped when both halves are full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit):
        if (ids := self.older.get(unit)) is None:
            ids = self.encode(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class BacktrackingBpe:
    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.marked = {i for p, i in self.ids.items() if p[0] == MARK}
        self.number_text = [str(i) for i in range(n)]
        alone = {p for p in self.ids if len(p) == 1}
        #: Characters inside longer pieces that are no piece themselves; units with them are merged directly.
        self.loose = {c for p in self.ids for c in p} - alone
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self.merge(p) == [p]:
                self.machine.add_word(p, len(p))
        self.machine.make_automaton()
        self.breaks_at_lines = not any("\n" in p for p in self.ids)
        self.crosses_marks = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units = _Units(lambda unit: self._unit(unit.replace(" ", MARK)))
        #: A unit of letters ends before punctuation; letters that stand before it in a piece are left out.
        letter = re.compile(r"[^\W\d_]")
        odd = re.escape("".join(sorted({p[i] for p in self.ids for i in range(len(p) - 1) if p[i + 1] in CUTS and letter.match(p[i])})))
        self.cut = re.compile(rf"\n|  +[^ \n]*| ?[^\W\d_{odd}]+(?=[ \n{re.escape(CUTS)}]|\Z)| ?[^ \n]+| ")

    def forget(self) -> None:
        """Drops what was remembered of texts, so that an idle worker holds little."""
        self.units.clear()
        self.units.older = {}
        self.pairs.clear()

    def merge(self, text: str) -> list[str]:
        """The pieces by merging neighbours in order of score, then place."""
        n, scores = len(text), self.scores
        symbols, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (s := scores.get(text[i : i + 2])) is not None:
                heap.append((-s, i, text[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(joined + symbols[k])) is not None:
                    heapq.heappush(heap, (-s, i, joined + symbols[k]))
            if (h := before[i]) >= 0 and (s := scores.get(symbols[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, symbols[h] + joined))
        return [s for s in symbols if s]

    def together(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= 2 * CACHE_UNITS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        n = len(text)
        found: list[list[int]] = [[1] for _ in text]
        for end, length in self.machine.iter(text):
            found[end + 1 - length].append(length)  # ends ascend, so lengths do
        failed = bytearray(n + 1)
        out: list[str] = []
        tries: list[int] = []  # of each piece, its number among the lengths found at its place
        pairs, last, place = self.pairs, "", 0
        k = len(found[0]) - 1 if n else -1
        while place < n:
            lengths = found[place]
            while k >= 0:
                end = place + lengths[k]
                if not failed[end]:
                    piece = text[place:end]
                    if not last:
                        break
                    if (good := pairs.get((last, piece))) is None:
                        good = self.together(last, piece)
                    if good:
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                tries.append(k)
                last, place = piece, end
                k = len(found[end]) - 1 if end < n else -1
            else:
                failed[place] = 1
                if not out:
                    return self.merge(text)
                place -= len(out.pop())
                k = tries.pop() - 1
                last = out[-1] if out else ""
        return out

    def _unit(self, text: str) -> tuple[int, ...]:
        """The ids of a unit that no piece leaves."""
        if (piece := self.ids.get(text)) is not None and len(text) == 1:
            return (piece,)
        ids: list[int] = []
        if not self.loose and MARK + MARK not in text and not self.crosses_marks and all(map(self.ids.__contains__, text)):
            return tuple(map(self.ids.__getitem__, self.backtrack(text)))
        direct = MARK + MARK in text or self.crosses_marks or (self.loose and not self.loose.isdisjoint(text))
        start = 0
        for at in [i for i, c in enumerate(text) if c not in self.ids and c not in self.loose] + [len(text)]:
            if at > start:
                part = text[start:at]
                for piece in self.merge(part) if direct else self.backtrack(part):
                    known = self.ids.get(piece)
                    ids.extend((known,) if known is not None else (self.byte_ids[b] for b in piece.encode()))
            if at < len(text):
                ids.extend(self.byte_ids[b] for b in text[at].encode())
            start = at + 1
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if self.crosses_marks or not self.breaks_at_lines:
            return list(self._unit(text.replace(" ", MARK)))
        return list(chain.from_iterable(map(self.units.__getitem__, self.cut.findall(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte piece that is in no valid character gives U+FFFD."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        lead = next((i for i in ids if self.bytes_of[i]), None)  # control pieces have no text
        if lead is not None and not self.is_byte[lead] and lead in self.marked:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            pass
        out, k = [], 0
        while k < len(joined):
            for length in (1, 2, 3, 4):
                try:
                    out.append(joined[k : k + length].decode())
                    k += length
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


def loaded(model: bytes) -> BacktrackingBpe:
    """One encoder for each model in a worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = BacktrackingBpe(model)
    return _LOADED[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each whole text and, if asked for, the text decoded from them."""
    spark = docs.sparkSession
    common.tune(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        more.append(T.StructField(decoded, T.StringType(), False))

    def run(batches):
        bpe = loaded(model.value)
        for b in batches:
            coded = [bpe.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            new = [pa.array(coded, pa.list_(pa.int32()))]
            if decoded:
                new.append(pa.array([bpe.decode(c) for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f.name for f in more)])
        bpe.forget()

    return docs.mapInArrow(common.trimmed(run), common.with_columns(docs.schema, *more))


def digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, made where the ids are."""
    spark = docs.sparkSession
    common.tune(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        bpe = loaded(model.value)
        number = bpe.number_text.__getitem__
        for b in batches:
            counts, id_hashes, text_hashes = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                text_hashes.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", text).mapInArrow(common.trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read_table(spark, sf_dir, "documents"), default_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their ids; the last stage, so it adds a column."""
    return encode(docs, default_model(), ids=common.free_name(docs, "ids"))


def round_trip_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their ids and the text that these decode to."""
    return encode(docs, default_model(), ids=common.free_name(docs, "ids"), decoded=common.free_name(docs, "decoded"))
