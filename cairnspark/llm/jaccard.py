"""Near duplicates by an exact Jaccard join of word shingles.

Two texts link if their sets of 5-word shingles have a Jaccard similarity of
at least 75 / 100. Texts with equal sets are one class from the start; the
rest is a size-aware heavy-light join between class representatives:

1. *Shared shingles.* Of a set of n shingles that links with another, at most
   n // 4 are missing there. Half of the hash space (all of it for small sets)
   is exchanged in packed form to count each set's shingles that other sets
   have; sets with too few go no further. A shingle that repeats inside a
   task is sent once by it, so a frequent one costs a row a task.
2. *Rarity.* The remaining sets learn how frequent their shingles are, forget
   those that nobody shares, and order the others from rare to frequent.
   Linked sets share one of the first n // 4 + 1 and two of the first
   n // 4 + 2 shingles of that order.
3. *Pivots.* In two rounds each set is compared with the pivot that it shares
   most lists with, which joins large groups of near copies without their
   pairs. Lists whose members all have one root by then are closed.
4. *Heavy and light.* For what is left, light sets enumerate the pairs
   (subsets of size 2) of their tokens of open lists, packed by the rarer
   token; heavy ones are found by scanning their open lists. The boundary is
   the size at which the summed cost of both, by size band, is least. Sets
   just below it are scanned too, so that no link across it is lost. Members
   outside of a list's largest component are counted against all others, in
   blocks; only pairs that share as many firsts as linked sets of their sizes
   must go on. A comparison is exact.

Hashes of shingles and of sets have 64 and 128 bits.

Defined results: a null text or one without words has the empty set and links
with nothing; a text of fewer words than a shingle has one element; rows with
a null doc_id are in the result but link with nothing (component_id null);
rows with equal doc_ids are one node, which links with all that one of its
texts links with; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Sets of up to SMALL shingles exchange all of them; sets of up to SMALL_PARTNER may link with those.
SMALL, SMALL_PARTNER = 48, 64
#: Rounds in which sets outside of a list's largest component are compared with a pivot in it, before all pairs that are left.
PIVOT_ROUNDS = 2
#: Tokens that a task gathers before it packs them, and that a bucket holds on average.
CHUNK, BUCKET = 500_000, 1_000_000
#: Members of a list that meet in a task, twice; pairs that are counted at once.
BLOCK, CELLS = 2048, 4_000_000
#: Lists of doc_ids of up to so many rows (two numbers each, some 10 MB as a broadcast table) are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Size bands grow by the ratio of sizes that can still link.
BAND = float(np.log(4 / 3))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256 + 8, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int = WORDS, slice_bytes: int = 1 << 19):
    """Yields the sorted distinct shingle hashes of each whole text."""
    data, offsets = common.texts_of(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        lo, hi = offsets[first], offsets[last]
        part, cuts = _LOWER[data[lo:hi]], offsets[first : last + 1] - lo
        gap = _BREAK[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        inner = cuts[1:-1]
        if len(inner) and len(part):  # a word also ends where its text does
            inside = inner[(inner > 0) & (inner < len(part))]
            inside = np.unique(inside[~gap[inside] & ~gap[inside - 1]])
            edge = np.sort(np.concatenate([edge, inside, inside]))
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers(max(1, len(part)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[part] * up[: len(part)], dtype=np.uint64)])
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, cuts)
        if len(words) >= k:
            rows = words[: len(words) - k + 1] * _RANDOM[256]
            for j in range(1, k):
                rows = mix(rows) + words[j : len(words) - k + 1 + j] * _RANDOM[256 + j]
            rows = mix(rows)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i >= k:
                yield np.unique(rows[i : j - k + 1])
            elif j > i:
                h = np.array([j - i], np.uint64)
                for at in range(i, j):
                    h = mix(h) + words[at : at + 1] * _RANDOM[256]
                yield mix(h)
            else:
                yield np.zeros(0, np.uint64)
        first = last


def missing_at_most(n):
    """How many of n shingles a linked set may lack."""
    return n // 4


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), checked (shingles counted in step 1), and two sums that name the set."""
    common.tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, checked, one, two = [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                checked.append(len(s) if len(s) <= SMALL else int(np.count_nonzero(s >> np.uint64(63) == 0)))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                two.append(int(mix(s + np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, checked, one, two))], names=["doc_id", "n", "checked", "one", "two"])

    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id long, n long, checked long, one long, two long")


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the size and the two sums that name the text's set."""
    common.tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1)))
            one = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
            two = [int(mix(s + np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], one, two))], names=["doc_id", "text", "n", "one", "two"])

    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id long, text string, n long, one long, two long")


def numbered(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """node, doc_id, text: one row for each doc_id and set, with a number of its own; the texts of repeated doc_ids alone are shuffled."""
    named = docs.where(F.col("doc_id").isNotNull())
    once = _restricted(named, repeated, "left_anti").select("doc_id", "text")
    more = with_sets(_restricted(named, repeated, "left_semi")).dropDuplicates(["doc_id", "n", "one", "two"]).select("doc_id", "text")
    return common.stored(once.unionByName(more).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _restricted(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the stored ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def bucket_count(spark: SparkSession, tokens: int) -> int:
    """So many buckets that each holds BUCKET tokens or fewer on average."""
    return max(common.shuffle_parts(spark), -(-tokens // BUCKET))


def _split(part: np.ndarray, n: int):
    """(k, where part is k) for each k below n that occurs."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _by_owner(owners: np.ndarray, n: int) -> np.ndarray:
    return (mix(owners.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _gathered(batches, kinds: list) -> list[np.ndarray]:
    """The packed columns after the first one, each as one array."""
    found = [[np.zeros(0, k)] for k in kinds]
    for b in batches:
        for column, out, kind in zip(b.columns[1:], found, kinds, strict=True):
            out.extend(np.frombuffer(x, kind) for x in column.to_pylist())
    return [np.concatenate(x) for x in found]


def shared_counts(docs: DataFrame, tokens: int) -> DataFrame:
    """doc_id and credits: how many of its checked shingles other documents have. tokens: how many shingles docs has, about."""
    common.tune(docs.sparkSession)
    n_buckets = bucket_count(docs.sparkSession, tokens // 2)
    names, one = ["bucket", "owners", "tokens"], np.uint64(1)

    def credited(owners):
        ids, counts = np.unique(owners, return_counts=True)
        return [(k, ids[at].tobytes(), counts[at].astype(np.int64).tobytes()) for k, at in _split(_by_owner(ids, n_buckets), n_buckets)]

    def pack(batches):
        ids, sets, size = [], [], 0

        def flush():
            owners, tokens = np.repeat(np.array(ids, np.int64), [len(s) for s in sets]), np.concatenate(sets)
            order = np.argsort(tokens)
            tokens, owners = tokens[order], owners[order]
            new = np.concatenate([[True], (tokens[1:] >> one) != (tokens[:-1] >> one)])
            runs = np.diff(np.append(np.flatnonzero(new), len(new)))
            many = np.repeat(runs > 1, runs)
            own = credited(owners[many & (tokens & one == 1)])
            tokens = np.where(many, tokens & ~one, tokens)[new]  # those have their credit
            owners = owners[new]
            buckets = ((tokens >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            return _batch([(k, owners[at].tobytes(), tokens[at].tobytes()) for k, at in _split(buckets, n_buckets)] + [(-1 - k, i, c) for k, i, c in own], names)

        for b in batches:
            for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                half = (s >> np.uint64(63)) == 0
                if len(s) > SMALL_PARTNER:
                    s, counts = s[half], one
                else:
                    counts = one if len(s) <= SMALL else half.astype(np.uint64)
                if len(s):
                    # the lowest bit tells whether a meeting counts for this document
                    sets.append((s & ~one) | counts)
                    ids.append(doc_id)
                    size += len(s)
                if size >= CHUNK:
                    yield flush()
                    ids, sets, size = [], [], 0
        if size:
            yield flush()

    def meet(batches):
        for some in common.keyed_batches(batches):
            k = some.column(0)[0].as_py()
            owners, tokens = _gathered([some], [np.int64, np.uint64])
            if k < 0:  # credits on their way
                yield _batch([(-1 - k, owners.tobytes(), tokens.tobytes())], names)
                continue
            order = np.argsort(tokens)
            tokens, owners = tokens[order], owners[order]
            same = (tokens[1:] >> one) == (tokens[:-1] >> one)
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield _batch(credited(owners[met & (tokens & one == 1)]), names)

    def total(batches):
        owners, counts = _gathered(batches, [np.int64, np.int64])
        if len(owners):
            ids, inverse = np.unique(owners, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(inverse, counts).astype(np.int64))], names=["doc_id", "credits"])

    kind = "bucket int, owners binary, tokens binary"
    packed = docs.select("doc_id", "text").mapInArrow(common.trimmed(pack), kind)
    met = packed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(common.trimmed(meet), kind)
    return met.repartition(n_buckets, "bucket").mapInArrow(common.trimmed(total), "doc_id long, credits long")


def rarity_ordered(docs: DataFrame, tokens: int) -> DataFrame:
    """doc_id, n, tokens (shared ones, ascending), first (rare shared ones, the rarest first, of which linked sets have two in common)."""
    common.tune(docs.sparkSession)
    n_buckets = bucket_count(docs.sparkSession, tokens)
    names = ["bucket", "owners", "tokens", "often"]

    def pack(batches):
        held, size = [], 0

        def flush():
            owners, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            return _batch([(k, owners[at].tobytes(), tokens[at].tobytes(), b"") for k, at in _split(((tokens >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), n_buckets)], names)

        for b in batches:
            for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                held.append((np.full(len(s), doc_id, np.int64), s))
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        for some in common.keyed_batches(batches):
            owners, tokens, _ = _gathered([some], [np.int64, np.uint64, np.int32])
            _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            often = counts[inverse].astype(np.int32)
            yield _batch([(k, owners[at].tobytes(), tokens[at].tobytes(), often[at].tobytes()) for k, at in _split(_by_owner(owners, n_buckets), n_buckets)], names)

    def order(batches):
        owners, tokens, often = _gathered(batches, [np.int64, np.uint64, np.int32])
        by = np.lexsort((tokens, often, owners))
        owners, tokens, often = owners[by], tokens[by], often[by]
        ids, starts = np.unique(owners, return_index=True)
        cuts, alone, out = np.append(starts, len(owners)).tolist(), np.add.reduceat(often == 1, starts).tolist() if len(starts) else [], []
        for k, doc_id in enumerate(ids.tolist()):
            n, rare = cuts[k + 1] - cuts[k], tokens[cuts[k] + alone[k] : cuts[k + 1]]
            left = missing_at_most(n) + 2 - alone[k]  # those that nobody shares come first
            if left > 1 and len(rare):
                out.append((doc_id, n, np.sort(rare).tobytes(), rare[:left].tobytes()))
            if len(out) == 512 or (out and k + 1 == len(ids)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "n", "tokens", "first"])
                out = []

    kind = "bucket int, owners binary, tokens binary, often binary"
    packed = docs.select("doc_id", "text").mapInArrow(common.trimmed(pack), kind).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    counted = packed.mapInArrow(common.trimmed(count), kind).repartition(n_buckets, "bucket")
    return counted.mapInArrow(common.trimmed(order), "doc_id long, n long, tokens binary, first binary")


def postings(sets: DataFrame) -> DataFrame:
    """sig, doc_id, n, pos: the inverted lists of the first tokens; pos counts from the rarest."""

    def run(batches):
        for b in batches:
            first = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            sizes = [len(x) for x in first]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), *(pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (0, 1)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))], names=["sig", "doc_id", "n", "pos"])

    return sets.select("doc_id", "n", "first").mapInArrow(common.trimmed(run), "sig long, doc_id long, n long, pos int")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough, compared exactly."""
    sets = sets.select("doc_id", "n", "tokens")
    left = pairs.join(sets, F.col("a") == F.col("doc_id")).select("a", "b", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    both = left.join(sets, F.col("b") == F.col("doc_id")).select("a", "b", "na", "ta", F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches):
        for b in batches:
            keep = []
            for na, ta, nb, tb in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                shared = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                keep.append(DENOMINATOR * shared >= NUMERATOR * (na + nb - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(common.trimmed(run), "a long, b long")


def open_lists(rooted: DataFrame) -> DataFrame:
    """The rows of lists whose members have several roots, with the root of most (top), and how many have that one (inside) and others (outside)."""
    by_root = rooted.groupBy("sig", "root").agg(F.count("*").alias("size"))
    tops = by_root.groupBy("sig").agg(F.min(F.struct((-F.col("size")).alias("less"), "root")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    inside = -F.col("top.less")
    return rooted.join(tops.select("sig", F.col("top.root").alias("top"), inside.alias("inside"), (F.col("all") - inside).alias("outside")), "sig")


def unrooted_lists(lists: DataFrame) -> DataFrame:
    """open_lists() while each member is its own root."""
    tops = lists.groupBy("sig").agg(F.min("doc_id").alias("top"), F.count("*").alias("all")).where("all > 1")
    return lists.withColumn("root", F.col("doc_id")).join(tops.select("sig", "top", F.lit(1).cast("long").alias("inside"), (F.col("all") - 1).alias("outside")), "sig")


def pivot_links(members: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Links of members that are not of their list's top root with the pivot of that root that they meet in most lists."""
    pivot = members.where("root = top").groupBy("sig").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id")).alias("p")).select("sig", F.col("p.doc_id").alias("b"))
    tried = members.where("root <> top").select("sig", F.col("doc_id").alias("a")).join(pivot, "sig")
    best = tried.groupBy("a", "b").agg(F.count("*").alias("met")).groupBy("a").agg(F.max(F.struct("met", "b")).alias("best"))
    return linked(best.select("a", "best.b"), sets)


def boundary(members: DataFrame) -> int:
    """The largest size of light sets, by the least summed cost over size bands.

    In ids that are moved, a light set costs its subsets of size 2, and a heavy
    one all members of its lists.
    """
    each = members.groupBy("doc_id", "n").agg(F.count("*").alias("k"), F.sum(F.col("inside") + F.col("outside")).alias("heavy"))
    bands = each.groupBy(F.floor(F.log("n") / BAND).alias("band")).agg(F.sum(F.col("k") * (F.col("k") + 1) / 2).alias("light"), F.sum("heavy").alias("heavy"), F.max("n").alias("n")).orderBy("band").collect()
    best = cost = sum(r["heavy"] for r in bands)
    cut = 0
    for r in bands:
        cost += r["light"] - r["heavy"]
        if cost < best:
            best, cut = cost, r["n"]
    return int(cut)


def least_common(na, nb):
    """How many of their first tokens linked sets of these sizes have in common at least.

    Linked sets share ceil(3 (na + nb) / 7) tokens. Of those that are not among
    the first ones of both, the set whose firsts end earlier has all beyond
    its firsts: n - (n // 4 + 2) at most.
    """
    return (3 * (na + nb) + 6) // 7 - np.maximum(np.maximum(na - na // 4 - 2, nb - nb // 4 - 2), 0)


def _meetings(lists: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of whole lists, of two roots and sizes that can link, that share as many subsets as linked ones must.

    Each row stands for the subsets of its list's token and one of ``rest``.
    Pairs are counted in a table of a list's outsiders by all of its members.
    """
    of = {k: lists.column(k).to_numpy() for k in ("doc_id", "n", "root", "outsider")}
    key = np.concatenate([[0], np.cumsum(np.any([np.diff(lists.column(k).to_numpy()) != 0 for k in ("sig", "x", "y")], axis=0))])
    starts = np.searchsorted(key, np.arange(key[-1] + 2))
    size = np.diff(starts)
    column = np.arange(len(key)) - starts[key]
    outsiders = np.flatnonzero(of["outsider"])
    out_count = np.bincount(key[outsiders], minlength=len(size))
    row = np.zeros(len(key), np.int64)
    row[outsiders] = np.arange(len(outsiders)) - (np.cumsum(out_count) - out_count)[key[outsiders]]
    cells = out_count * size
    rest = lists.column("rest").combine_chunks()
    bounds, rest = rest.offsets.to_numpy() - rest.offsets[0].as_py(), rest.flatten().to_numpy()
    lengths = np.diff(bounds)
    found = []
    at = 0
    while at < len(size):  # some lists at a time, so that the table of pairs stays small
        stop = at + max(1, int(np.searchsorted(np.cumsum(cells[at:]), CELLS, "right")))
        members = np.arange(starts[at], starts[stop])
        base = np.concatenate([[0], np.cumsum(cells[at:stop])])
        owner, second = np.repeat(members, lengths[members]), rest[bounds[starts[at]] : bounds[starts[stop]]]
        order = np.lexsort((second, key[owner]))
        owner, second = owner[order], second[order]
        new = np.concatenate([[True], (second[1:] != second[:-1]) | (key[owner][1:] != key[owner][:-1])]) if len(owner) else np.zeros(0, bool)
        first_of = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        runs = np.diff(np.append(first_of, len(owner)))
        asks = np.flatnonzero(of["outsider"][owner] & (runs[run] > 1)) if len(owner) else np.zeros(0, np.int64)
        met = np.zeros(int(base[-1]), np.int32)
        sums = np.cumsum(runs[run[asks]])
        begin = 0
        while begin < len(asks):
            end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + CELLS // 4, "right")))
            part = asks[begin:end]
            many = runs[run[part]]
            partner = np.repeat(first_of[run[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, b = np.repeat(owner[part], many), owner[partner]
            np.add.at(met, base[key[a] - at] + row[a] * size[key[a]] + column[b], 1)
            begin = end
        hit = np.flatnonzero(met)
        which = np.searchsorted(base, hit, "right") - 1
        offset = hit - base[which]
        first_outsider = (np.cumsum(out_count) - out_count)[at + which]
        a = outsiders[first_outsider + offset // size[at + which]]
        b = starts[at + which] + offset % size[at + which]
        na, nb = of["n"][a], of["n"][b]
        good = (of["root"][a] != of["root"][b]) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (met[hit] + 1 >= least_common(na, nb))
        found.append((of["doc_id"][a[good]], of["doc_id"][b[good]]))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def light_pairs(members: DataFrame, light: int) -> DataFrame:
    """a, b: pairs of light sets of two roots that share enough subsets of size 2.

    A row of a list holds a token and the later ones of a set, which are all
    subsets that begin with the token. The members of the top root and the
    others are dealt to blocks, which meet in as many tasks as needed, none
    with more than two blocks.
    """
    some = members.where(F.col("n") <= light)
    tokens = some.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sig"))).alias("own"))  # a light set has few
    rows = some.join(tokens, "doc_id").withColumn("rest", F.transform(F.filter("own", lambda t: t["pos"] > F.col("pos")), lambda t: t["sig"]))
    blocks = {k: F.ceil(F.col(k) / BLOCK).cast("int") for k in ("inside", "outside")}
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("root") == F.col("top"), blocks["inside"]).otherwise(blocks["outside"])).cast("int")
    rows = rows.withColumn("mine", mine)
    # outsiders of block i meet insiders of block j as (i, j), and outsiders of block j >= i as (i, -1 - j)
    others = F.sequence(F.lit(0), blocks["outside"] - 1)
    meets_in = F.transform(F.sequence(F.lit(0), blocks["inside"] - 1), lambda j: F.struct(F.col("mine").alias("x"), j.alias("y"), F.lit(True).alias("outsider")))
    meets_out = F.transform(others, lambda j: F.struct(F.least("mine", j).alias("x"), (-1 - F.greatest("mine", j)).alias("y"), F.lit(True).alias("outsider")))
    meets_top = F.transform(others, lambda i: F.struct(i.alias("x"), F.col("mine").alias("y"), F.lit(False).alias("outsider")))
    apart = F.when(F.col("inside") + F.col("outside") <= BLOCK, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("root") != F.col("top")).alias("outsider"))))
    meets = apart.when(F.col("root") == F.col("top"), meets_top).otherwise(F.concat(meets_in, meets_out))
    rows = rows.select("sig", "doc_id", "n", "root", F.explode(meets).alias("m"), "rest")
    rows = rows.select("sig", "m.x", "m.y", "m.outsider", "doc_id", "n", "root", "rest")

    def run(batches):
        for lists in common.keyed_batches(batches, ("sig", "x", "y"), least=20_000):
            a, b = _meetings(lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = rows.repartition(common.shuffle_parts(members.sparkSession), "sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(common.trimmed(run), "a long, b long").distinct()


def heavy_pairs(members: DataFrame, light: int) -> DataFrame:
    """a, b: pairs of two roots, a heavy, found by scanning the lists of a; b heavy too, or just below the boundary."""
    heavy = members.where(F.col("n") > light).select("sig", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    scanned = members.where(4 * F.col("n") > 3 * light).select("sig", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = heavy.join(scanned, "sig").where((F.col("ra") != F.col("rb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & ((F.col("nb") <= light) | (F.col("a") < F.col("b"))))
    beyond = F.greatest(*(F.col(n) - F.floor(F.col(n) / 4) - 2 for n in ("na", "nb")), F.lit(0))
    least = F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7) - beyond
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.min(least).alias("least")).where(F.col("met") >= F.col("least"))
    return met.select("a", "b")


def components(sets: DataFrame) -> DataFrame:
    """node and root of all sets that link with another."""
    members, links = common.stored(unrooted_lists(postings(sets)), "lists"), None
    for turn in range(PIVOT_ROUNDS):
        new = common.stored(pivot_links(members, sets, turn), "links")
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        roots = common.stored(connected_components(links), "roots")
        # a list of one root has nothing left to find, so the open ones alone go on
        now = members.select("sig", "doc_id", "n", "pos").join(roots, F.col("doc_id") == F.col("node"), "left")
        members = common.stored(open_lists(now.select("sig", "doc_id", "n", "pos", F.coalesce("root", "doc_id").alias("root"))), "open-lists")
    light = boundary(members)
    pairs = light_pairs(members, light).union(heavy_pairs(members, light))
    again = common.stored(linked(pairs, sets), "links")
    return connected_components(again if links is None else again.union(links))


def _connected(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """a and b of edges that join what near_duplicates() joins; docs and profile have a row for each doc_id."""
    sets = profile.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = sets.groupBy("one", "two", "n").agg(F.min("doc_id").alias("root"), F.count("*").alias("size")).where("size > 1")
    copies = common.stored(sets.join(classes, ["one", "two", "n"]).where(F.col("doc_id") > F.col("root")).select("doc_id", F.col("root").alias("same")), "copies")
    kept = _restricted(docs.where(F.col("doc_id").isNotNull()), copies.select("doc_id"), "left_anti")
    credits = shared_counts(kept, profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    alive = common.stored(sets.join(credits, "doc_id").where(F.col("credits") >= F.col("checked") - F.floor(F.col("n") / 4)).select("doc_id", "n"), "alive")
    count, tokens = alive.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = kept.join(F.broadcast(alive) if count <= BROADCAST_IDS else alive, "doc_id")
    ordered = common.stored(rarity_ordered(chosen, tokens), "sets")
    return components(ordered).select(F.col("node").alias("a"), F.col("root").alias("b")).union(copies.select(F.col("doc_id").alias("a"), F.col("same").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = common.stored(profiles(docs), "profiles")
    repeated = common.stored(profile.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        edges = _connected(docs, profile)
    else:
        nodes = numbered(docs, repeated)
        own = nodes.select(F.col("node").alias("doc_id"), "text")
        by_node = _connected(own, common.stored(profiles(own), "profiles"))
        for end in ("a", "b"):
            name = nodes.select(F.col("node").alias(end), F.col("doc_id").alias(f"doc_{end}"))
            by_node = by_node.join(name, end)
        edges = by_node.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).where("a <> b").distinct()
    roots = connected_components(edges)
    return profile.select("doc_id", F.col("n").alias("n_shingles")).join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row with the smallest doc_id.

    Of rows with equal doc_ids each is judged by its own text: equal texts are
    one group, other texts stay. Rows with a null doc_id, and texts without
    words, all stay. Which of rows alike in doc_id and text stays is not fixed.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if ids.where("count > 1").isEmpty():
        mark = common.free_name(docs, "gone")
        gone = near_duplicates(docs).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(mark))
        return docs.join(gone, F.col("doc_id") == F.col(mark), "left_anti")
    node, mark = common.free_name(docs, "node"), common.free_name(docs, "gone")
    rows = common.stored(docs.withColumn(node, F.monotonically_increasing_id()), "rows")
    named = rows.where("doc_id is not null").select("doc_id", "text", F.col(node).alias("own"))
    groups = near_duplicates(named.select(F.col("own").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("member"), "component_id")
    sized = common.stored(named.select("own", F.col("doc_id").alias("id")).join(groups, F.col("own") == F.col("member")), "groups")
    stays = sized.groupBy("component_id").agg(F.min(F.struct("id", "own")).alias("least"), F.count("*").alias("size")).where("size > 1").select("component_id", F.col("least.own").alias("stays"))
    gone = sized.join(stays, "component_id").where("own <> stays").select(F.col("own").alias(mark))
    return rows.join(gone, F.col(node) == F.col(mark), "left_anti").drop(node)
