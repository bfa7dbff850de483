"""Removal of byte strings that also start in an earlier document.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller doc_id. Strings are found exactly, in these steps:

1. Later copies of whole texts go first: all their strings are in the first.
2. Each string holds a q-gram with the least hash in it, its anchor. Anchors
   are exchanged in packed form to find those that several documents have; an
   anchor that repeats inside a task is sent once by it.
3. Around each shared anchor, the stretch of strings that it anchors is sent
   by anchor and neighbouring bytes, once for equal stretches of a task.
   Strings near the left end of the anchor go by the bytes on its right, the
   others by those on its left, so that a passage in very many documents is
   spread over tasks where its surroundings differ.
4. A task sorts the suffixes of its stretches by bucket-pointer refinement:
   first by q-grams of 8 bytes, then by the bucket of the suffix 8, 16 and 18
   bytes on, each pass reusing the buckets of the pass before, up to LENGTH
   bytes. In each bucket all but the smallest doc_id lose the string. Where a
   key has more stretches than a task should hold, their strings are dealt
   out once more by all their bytes.
5. The spans of each document are merged and cut out.

Defined results: null and empty texts have no bytes; rows with a null doc_id
are kept whole and take nothing from others; rows with equal doc_ids and
texts are treated alike; different texts of one doc_id are judged each against
all smaller doc_ids, never against each other; very long texts are worked on in
slices; an empty table gives no row; other columns are left out.

An owner is a doc_id, or where a doc_id has several texts, all doc_ids are
moved up by some bits, below which the texts have numbers of their own; owners
are compared without these bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard import _batch, _gathered, _powers, _restricted, _split, mix

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
LEFT, RIGHT = 8, 22
#: Bytes of text that are hashed at once (below 1 << 24), anchors that a task gathers before it packs them (four times its stretches), and bytes that are sorted at once.
SLICE, CHUNK, SORTED = 1 << 19, 400_000, 1 << 20
#: Bytes of text (for anchors) or of stretches that a bucket has on average.
BUCKET = 24 << 20
#: Tables of up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_RANDOM = np.random.default_rng(1729).integers(0, 2**64, 256, dtype=np.uint64)
_I64, _I32, _U64, _U32 = np.int64, np.int32, np.uint64, np.uint32


class Stretch:
    """Anchors of some texts: owner (text number), pos, first and last string start (all in the text), hash, left, right."""

    def __init__(self, **columns):
        self.__dict__.update(columns)


def _segments(offsets: np.ndarray):
    """(text number, start, stop) of pieces of up to SLICE bytes that overlap so that no string is lost."""
    for k in range(len(offsets) - 1):
        n = int(offsets[k + 1] - offsets[k])
        at = 0
        while n - at >= LENGTH:
            yield k, int(offsets[k]) + at, int(offsets[k]) + min(n, at + SLICE)
            if at + SLICE >= n:
                break
            at += SLICE - LENGTH + 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> Stretch:
    """The anchors of all strings of LENGTH bytes, with the run of strings that each anchors."""
    out = {name: [] for name in ("owner", "pos", "first", "last", "hash", "left", "right")}
    group, size = [], 0

    def work():
        part = np.concatenate([data[a:b] for _, a, b in group])
        cuts = np.cumsum([0, *(b - a for _, a, b in group)])
        n = len(part)
        up, down = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, _U64), np.cumsum(_RANDOM[part] * up[:n], dtype=_U64)])
        span = lambda i, j: (sums[j] - sums[i]) * down[i]
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        key = (grams & ~_U64(0xFFFFFF)) | np.arange(len(grams), dtype=_U64)
        low, width = key, 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(key) - SPAN + 1], low[SPAN - width :])
        chosen = (low & _U64(0xFFFFFF)).astype(_I64)
        start = np.arange(len(chosen))
        piece = np.searchsorted(cuts, start, "right") - 1
        ok = start + LENGTH <= cuts[piece + 1]
        chosen, start, piece = chosen[ok], start[ok], piece[ok]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])]))
        end = np.append(new[1:], len(chosen)) - 1
        pos, piece = chosen[new], piece[new]
        base = np.array([a - int(offsets[k]) for k, a, _ in group], _I64)[piece] - cuts[piece]
        out["owner"].append(np.array([k for k, _, _ in group], _I64)[piece])
        out["hash"].append(grams[pos])
        out["left"].append(mix(span(np.maximum(pos - LEFT, cuts[piece]), pos) + _U64(1)))
        out["right"].append(mix(span(pos + GRAM, np.minimum(pos + GRAM + RIGHT, cuts[piece + 1])) + _U64(2)))
        for name, value in (("pos", pos), ("first", start[new]), ("last", start[end])):
            out[name].append(value + base)

    for seg in _segments(offsets):
        group.append(seg)
        size += seg[2] - seg[1]
        if size >= SLICE:
            work()
            group, size = [], 0
    if group:
        work()
    kinds = {"hash": _U64, "left": _U64, "right": _U64}
    return Stretch(**{k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, _I64)) for k, v in out.items()})


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _own_bucket(owners: np.ndarray, n: int) -> np.ndarray:
    return (mix(owners.astype(_U64)) % _U64(n)).astype(_I64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and the run number of each value."""
    new = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _several_owners(starts: np.ndarray, run: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """By run, whether it has more than one owner."""
    return np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts) if len(starts) else np.zeros(0, bool)


def _short(hashes: np.ndarray) -> np.ndarray:
    """31 bits of a hash; that two have the same ones by chance costs a comparison and changes no result."""
    return (hashes & _U64(0xFFFFFFFE)).astype(_U32)


def shared_anchors(docs: DataFrame, n_bytes: int) -> DataFrame:
    """doc_id and packed short hashes of the anchors that other documents have too. n_bytes: of all texts, about."""
    common.tune(docs.sparkSession)
    n_buckets = max(common.shuffle_parts(docs.sparkSession), -(-n_bytes // BUCKET))
    names, one = ["bucket", "owners", "hashes"], _U32(1)

    def told(owners, hashes):
        return [(-1 - k, _blob(owners[at]), _blob(hashes[at])) for k, at in _split(_own_bucket(owners, n_buckets), n_buckets)]

    def pack(batches):
        held, size = [], 0

        def flush():
            owners, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            owners, hashes = owners[order], hashes[order]
            starts, run = _runs(hashes)
            many = _several_owners(starts, run, owners)[run]
            short, buckets = _short(hashes), ((hashes >> _U64(33)) % _U64(n_buckets)).astype(_I64)
            own = told(owners[many], short[many])
            first = np.zeros(len(hashes), bool)
            first[starts] = True
            send = ~many | first  # the lowest bit marks those that need no answer
            owners, short, buckets = owners[send], short[send] | many[send], buckets[send]
            return _batch([(k, _blob(owners[at]), _blob(short[at])) for k, at in _split(buckets, n_buckets)] + own, names)

        for b in batches:
            found = anchors(*common.texts_of(b.column(1)))
            if len(found.pos):
                held.append((b.column(0).to_numpy(zero_copy_only=False).astype(_I64)[found.owner], found.hash))
                size += len(found.pos)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(batches):
        for some in common.keyed_batches(batches):
            k = some.column(0)[0].as_py()
            owners, hashes = _gathered([some], [_I64, _U32])
            if k < 0:
                yield _batch([(k, _blob(owners), _blob(hashes))], names)
                continue
            order = np.argsort(hashes >> one, kind="stable")
            owners, hashes = owners[order], hashes[order]
            starts, run = _runs(hashes >> one)
            good = _several_owners(starts, run, owners)[run] & (hashes & one == 0)
            yield _batch(told(owners[good], hashes[good]), names)

    def unite(batches):
        owners, hashes = _gathered(batches, [_I64, _U32])
        order = np.argsort(owners, kind="stable")
        owners, hashes = owners[order], hashes[order]
        starts, _ = _runs(owners)
        cuts = np.append(starts, len(owners)).tolist()
        for k in range(0, len(starts), 2000):
            lists = [_blob(np.unique(hashes[cuts[i] : cuts[i + 1]])) for i in range(k, min(k + 2000, len(starts)))]
            yield pa.RecordBatch.from_arrays([pa.array(owners[starts[k : k + 2000]]), pa.array(lists, pa.binary())], names=["doc_id", "anchors"])

    kind = "bucket int, owners binary, hashes binary"
    packed = docs.mapInArrow(common.trimmed(pack), kind).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(common.trimmed(meet), kind).repartition(n_buckets, "bucket").mapInArrow(common.trimmed(unite), "doc_id long, anchors binary")


def refine(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bucket numbers of the suffixes at each place by their first LENGTH bytes (-1 where fewer are left)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    words = np.ascontiguousarray(grams).view(">u8").reshape(-1).astype(_U64)
    bucket = np.full(n, -1, _I64)
    ok = np.flatnonzero(left >= 8)
    bucket[ok] = np.unique(words[ok], return_inverse=True)[1]
    for have, step in ((8, 8), (16, 16), (32, LENGTH - 32)):
        ok = np.flatnonzero(left >= have + step)
        later = bucket[ok + step]
        pairs = bucket[ok] * (n + 1) + later
        bucket = np.full(n, -1, _I64)
        bucket[ok] = np.unique(pairs, return_inverse=True)[1]
    return bucket


_STRETCHES = ["bucket", "keys", "owners", "firsts", "counts", "bytes"]
_KINDS = [_U64, _I64, _I32, _I32]


def _gone(owners: np.ndarray, firsts: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows of strings that go, by bucket of documents (below 0)."""
    return [(-1 - k, b"", *(_blob(x[at]) for x in (owners, firsts, counts)), b"") for k, at in _split(_own_bucket(owners, n_buckets), n_buckets)]


def _packed(keys, owners, firsts, counts, pieces: list[bytes], n_buckets: int, below: int) -> pa.RecordBatch:
    """Rows of stretches by bucket of keys; of equal stretches the first owner's alone, as those of others go."""
    prints = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in pieces], _U64)
    order = np.lexsort((owners, prints, keys))
    same = np.concatenate([[False], (keys[order][1:] == keys[order][:-1]) & (prints[order][1:] == prints[order][:-1]) & (counts[order][1:] == counts[order][:-1])])
    lead = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
    later = same & (owners[order] >> below > owners[order][lead] >> below)
    gone, keep = order[later], np.sort(order[~later])  # a text's own repeats are judged each
    rows = _gone(owners[gone], firsts[gone], counts[gone], n_buckets)
    for k, at in _split(((keys[keep] >> _U64(16)) % _U64(n_buckets)).astype(_I64), n_buckets):
        at = keep[at]
        rows.append((k, *(_blob(x[at]) for x in (keys, owners, firsts, counts)), b"".join([pieces[i] for i in at.tolist()])))
    return _batch(rows, _STRETCHES)


class _Held:
    """Stretches that a task holds: keys, owners, firsts, counts, and all bytes in a row."""

    def __init__(self):
        self.parts, self.bytes, self.size = [], [], 0

    def add(self, columns, data):
        self.parts.append(columns)
        self.bytes.append(data)
        self.size += len(data)

    def whole(self):
        keys, owners, firsts, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return keys, owners, firsts, counts, np.concatenate(self.bytes)


def _taken(columns, data: np.ndarray, some: np.ndarray):
    """The chosen stretches (a mask) and their bytes."""
    sizes = columns[3].astype(_I64) + LENGTH - 1
    return [c[some] for c in columns], data[np.repeat(some, sizes)]


def _strings(columns, data: np.ndarray, n_buckets: int, below: int):
    """Each string of the stretches as a stretch of its own, with a key of all its bytes."""
    _, owners, firsts, counts = columns
    begin = np.cumsum(counts.astype(_I64) + LENGTH - 1) - (counts + LENGTH - 1)
    for k in range(0, len(owners), CHUNK // 32):
        some = slice(k, k + CHUNK // 32)
        n = counts[some].astype(_I64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        body = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[np.repeat(begin[some], n) + inside]
        keys = mix((_RANDOM[body] * _powers(LENGTH)[0]).sum(axis=1, dtype=_U64))
        yield _packed(keys, np.repeat(owners[some], n), np.repeat(firsts[some], n) + inside.astype(_I32), np.ones(len(keys), _I32), [x.tobytes() for x in body], n_buckets, below)


def _sorted_out(held: _Held, n_buckets: int, below: int) -> list[tuple]:
    """Rows of the strings that go, by refinement of the suffixes of each group of stretches with one key."""
    keys, owners, firsts, counts, data = held.whole()
    ends = np.cumsum(counts.astype(_I64) + LENGTH - 1)
    order = np.argsort(keys, kind="stable")
    starts, run = _runs(keys[order])
    keep = order[_several_owners(starts, run, owners[order])[run]]  # a key of one document has no match
    total = np.cumsum(counts[keep].astype(_I64) + LENGTH - 1)
    done = [[np.zeros(0, _I64)], [np.zeros(0, _I32)], [np.zeros(0, _I32)]]
    cut = 0
    while cut < len(keep):  # groups of keys, so that a sort holds a bounded text
        stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + SORTED, "right")))
        stop = int(np.searchsorted(keys[keep], keys[keep[stop - 1]], "right"))
        some = keep[cut:stop]
        cut = stop
        sizes = counts[some].astype(_I64) + LENGTH - 1
        stretch = np.repeat(np.arange(len(some)), sizes)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = data[np.repeat(ends[some] - sizes, sizes) + inside]
        bucket = refine(text, sizes[stretch] - inside)
        at = np.flatnonzero(bucket >= 0)
        owner, bucket = owners[some][stretch[at]], bucket[at]
        least = np.full(int(bucket.max()) + 1, np.iinfo(_I64).max)
        np.minimum.at(least, bucket, owner)
        gone = owner >> below > least[bucket] >> below
        string = firsts[some][stretch[at]][gone].astype(_I64) + inside[at][gone]
        owner, part = owner[gone], stretch[at][gone]
        if len(string):
            new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (string[1:] != string[:-1] + 1)]))
            last = np.append(new[1:], len(string)) - 1
            for out, value in zip(done, (owner[new], string[new].astype(_I32), (string[last] - string[new] + 1).astype(_I32)), strict=True):
                out.append(value)
    return _gone(*map(np.concatenate, done), n_buckets)


def repeated_spans(docs: DataFrame, shared: DataFrame, n_bytes: int, held_bytes: int = 64 << 20, hot: int = 20_000, below: int = 0) -> DataFrame:
    """doc_id with packed starts and ends of the runs of bytes that go. n_bytes: of all stretches, about; below: low bits of doc_id that do not count.

    A task that holds more than held_bytes of a bucket sends the stretches of
    keys that have more than hot of them on, string by string, so that they
    are dealt out by all their bytes.
    """
    spark = docs.sparkSession
    common.tune(spark)
    n_buckets = max(common.shuffle_parts(spark), -(-n_bytes // BUCKET))
    joined = docs.join(shared, "doc_id").select("doc_id", "text", "anchors")

    def pack(batches):
        held, size = [], 0

        def flush():
            return _packed(*(np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True)), [p for h in held for p in h[4]], n_buckets, below)

        for b in batches:
            data, offsets = common.texts_of(b.column(1))
            found = anchors(data, offsets)
            if not len(found.pos):
                continue
            wanted = np.concatenate([np.frombuffer(x, _U32).astype(_I64) + (k << 32) for k, x in enumerate(b.column(2).to_pylist())])
            hit = np.isin(_short(found.hash).astype(_I64) + (found.owner << 32), wanted)
            pos, first, last, owner = (getattr(found, x)[hit] for x in ("pos", "first", "last", "owner"))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(_I64)
            turn_at = pos - LEFT  # strings up to here have all LEFT bytes before the anchor
            parts = [(first, np.minimum(last, turn_at), found.left[hit]), (np.maximum(first, turn_at + 1), last, found.right[hit])]
            for lo, hi, side in parts:
                for some in np.array_split(np.flatnonzero(lo <= hi), 1 + len(lo) // (CHUNK // 4)):
                    if len(some):
                        a, z, begin = lo[some], hi[some], offsets[owner[some]]
                        bits = [data[i:j].tobytes() for i, j in zip((begin + a).tolist(), (begin + z + LENGTH).tolist(), strict=True)]
                        held.append((mix(found.hash[hit][some] + side[some]), ids[owner[some]], a.astype(_I32), (z - a + 1).astype(_I32), bits))
                        size += len(some)
                    if size >= CHUNK // 4:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def sort(spread):
        def run(batches):
            now, held, limit, apart = None, _Held(), held_bytes, np.zeros(0, _U64)
            for b in batches:
                for k, *columns, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if k < 0:  # on its way to the document
                        yield _batch([(k, *columns, data)], _STRETCHES)
                        continue
                    if k != now:
                        if held.parts:
                            yield _batch(_sorted_out(held, n_buckets, below), _STRETCHES)
                        now, held, limit, apart = k, _Held(), held_bytes, np.zeros(0, _U64)
                    columns, data = [np.frombuffer(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], np.frombuffer(data, np.uint8)
                    if len(apart) and (some := np.isin(columns[0], apart)).any():
                        yield from _strings(*_taken(columns, data, some), n_buckets, below)
                        columns, data = _taken(columns, data, ~some)
                    held.add(columns, data)
                    if spread and held.size > limit:
                        *columns, data = held.whole()
                        keys, counts = np.unique(columns[0], return_counts=True)
                        apart = np.union1d(apart, keys[counts > hot])
                        some, held = np.isin(columns[0], apart), _Held()
                        yield from _strings(*_taken(columns, data, some), n_buckets, below)
                        held.add(*_taken(columns, data, ~some))
                        limit = max(limit, 2 * held.size)
            if held.parts:
                yield _batch(_sorted_out(held, n_buckets, below), _STRETCHES)

        return common.trimmed(run)

    def unite(batches):
        owners, lo, counts = _gathered((b.select(["bucket", "owners", "firsts", "counts"]) for b in batches), _KINDS[1:])
        order = np.lexsort((lo, owners))
        owners, lo = owners[order], lo[order].astype(_I64)
        own, rank = _runs(owners)
        a = lo + (rank << 33)  # apart by document
        z = np.maximum.accumulate(a + counts[order] - 1 + LENGTH) if len(a) else a
        new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]])) if len(a) else np.zeros(0, _I64)
        starts, ends = lo[new].astype(_I32), ((z - (rank << 33))[np.append(new[1:], len(a)) - 1] if len(a) else z).astype(_I32)
        cuts = np.append(np.searchsorted(new, own), len(new)).tolist()
        for k in range(0, len(own), 2000):
            some = range(k, min(k + 2000, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(owners[own[k : k + 2000]]), *(pa.array([_blob(x[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()) for x in (starts, ends))], names=["doc_id", "lo", "hi"])

    kind = "bucket int, keys binary, owners binary, firsts binary, counts binary, bytes binary"
    rows = joined.mapInArrow(common.trimmed(pack), kind)
    for spread in (True, False):
        rows = rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(sort(spread), kind)
    return rows.repartition(n_buckets, "bucket").mapInArrow(common.trimmed(unite), "doc_id long, lo binary, hi binary")


def _broadcast(df: DataFrame, *binaries: str) -> DataFrame:
    """df, broadcast if its binary columns and 64 bytes a row come to BROADCAST_BYTES at most."""
    n = df.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in binaries), F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df, stored, with a column number (from 0, in the order of its partitions), and its number of rows."""
    placed = common.stored(df.withColumn("at", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))  # one row a partition
    before = [sum(n for _, n in sizes[:k]) for k in range(len(sizes))]
    starts = F.broadcast(df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=True)], "part long, before long"))
    return placed.join(starts, part == F.col("part")).withColumn("number", F.col("before") + inside).drop("at", "part", "before"), sum(n for _, n in sizes)


def _owners(docs: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs and hashes with owner, and the bits of it that do not count."""
    texts = hashes.groupBy("doc_id").agg((F.min("hash") != F.max("hash")).alias("more"))
    several = common.stored(texts.where("more").select("doc_id"), "several-texts")
    if several.isEmpty():
        return docs.withColumn("owner", F.col("doc_id")), hashes.withColumn("owner", F.col("doc_id")), 0
    numbers, n = _counted(hashes.join(several, "doc_id").select("doc_id", "hash").distinct(), "text-numbers")
    numbers = numbers.select(F.col("doc_id").alias("n_id"), F.col("hash").alias("n_hash"), "number")
    bits = max(1, n.bit_length())
    least, most = hashes.agg(F.min("doc_id"), F.max("doc_id")).first()
    rank = None
    if max(-least, most) >> (62 - bits):  # ids that cannot be moved up are replaced by their ranks
        ranks, _ = _counted(hashes.select("doc_id").distinct().repartitionByRange(common.shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id"), "id-ranks")
        rank = ranks.select(F.col("doc_id").alias("r_id"), F.col("number").alias("rank"))

    def owned(rows: DataFrame, hash_: Column) -> DataFrame:
        rows = rows.join(numbers, (F.col("doc_id") == F.col("n_id")) & (hash_ == F.col("n_hash")), "left")
        if rank is not None:
            rows = rows.join(rank, F.col("doc_id") == F.col("r_id"), "left")
        high = F.col("doc_id") if rank is None else F.col("rank")
        return rows.withColumn("owner", F.shiftleft(high, bits) + F.coalesce("number", F.lit(0))).drop("n_id", "n_hash", "number", "r_id", "rank")

    return owned(docs, F.sha2("text", 256)), owned(hashes, F.col("hash")), bits


def removal(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, lo, hi and whole (a later copy) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    hashes = common.stored(docs.where(counted).select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("bytes")), "hashes")
    docs, hashes, bits = _owners(docs, hashes)
    firsts = hashes.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    copies = hashes.join(firsts, "hash").where(F.col("doc_id") > F.col("first")).select("owner", "hash").distinct()
    copies = common.stored(copies, "text-copies")
    kept = _restricted(docs.where(counted).select(F.col("owner").alias("doc_id"), "text"), common.stored(copies.select(F.col("owner").alias("doc_id")).distinct(), "copy-ids"), "left_anti")
    n_bytes = hashes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shared = common.stored(shared_anchors(kept, n_bytes), "anchors")
    n_anchors = shared.agg(F.coalesce(F.sum(F.octet_length("anchors") / 4), F.lit(0.0))).first()[0]
    spans = repeated_spans(kept, shared, int(n_anchors) * 2 * (LENGTH + SPAN), below=bits)
    spans = _broadcast(common.stored(spans, "spans"), "lo", "hi").withColumnRenamed("doc_id", "span_owner")
    marks = _broadcast(copies.select(F.col("owner").alias("copy"), F.col("hash").alias("copy_hash")), "copy_hash")
    rows = docs.join(spans, F.col("owner") == F.col("span_owner"), "left").join(marks, (F.col("owner") == F.col("copy")) & (F.sha2("text", 256) == F.col("copy_hash")), "left")
    long_enough = lambda c: F.when(counted, F.col(c)).alias(c)  # noqa: E731  a short text may share its owner with a long one
    return rows.select("doc_id", "text", long_enough("lo"), long_enough("hi"), F.col("copy").isNotNull().alias("whole"))


def kept_bytes(body: bytes, lo: bytes | None, hi: bytes | None, whole: bool) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if whole:
        return b"", int(len(body) > 0)
    if not lo:
        return body, 0
    starts, ends = np.frombuffer(lo, _I32).tolist(), np.frombuffer(hi, _I32).tolist()
    return b"".join([body[a:z] for a, z in zip([0, *ends], [*starts, len(body)], strict=True)]), len(starts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, lo, hi, whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = (text or "").encode()
                rest, spans = kept_bytes(body, lo, hi, whole)
                out.append((doc_id, len(body), len(body) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removal(common.read_table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
