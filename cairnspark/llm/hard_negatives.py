"""Hard negatives by Four-Russians scoring.

Components become whole numbers. Candidates are stored in blocks as bit planes
in two's complement: one byte holds the bits of one plane in eight dimensions.
For a block of anchors the 256 subset sums of each eight dimensions are
tabulated; a plane's share of all scores is then one lookup for each eight
dimensions, and the planes are joined from the highest down by shifting and
adding. The scores are the full exact inner products.

Candidates stay in the groups in which they were packed; each group meets every
block of anchors once for positives and once for negatives, and hands on its
best few of each anchor. The lists of all groups are merged by score and id. As
every anchor is scored against every row, the work is anchors times rows; what
is copied are the anchors, once for each group.

Defined results: rows with a null id or label, a null vector, or a null or
non-finite component take no part; rows with equal id, label and vector count
once; rows with equal ids that differ are anchors and candidates of their own,
but never of each other; empty vectors have score 0 among themselves; vectors
of different lengths are not compared; components beyond a long are its least
or greatest, and scores are longs that wrap around; anchors without a positive,
and positives without a row in their interval (all with a negative score), give
no row; an empty table gives none; other columns are left out, whatever their
names.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 128
POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
#: Pairs of blocks in one Arrow batch.
BATCH_PAIRS = 16
BLOCKS = "dim int, grp int, vec_ids binary, labels binary, planes binary"
ANCHORS = "dim int, block long, vec_ids binary, labels binary, whole binary"


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """The different rows that take part: vec_id, label, v (doubles)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("v")).distinct()
    return rows.select("vec_id", "label", F.col("v").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def relabelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v), kept inside a long."""
    scaled = np.floor(SCALE * v)
    inside = np.clip(scaled, -(2.0**63), 2.0**62).astype(np.int64)
    return np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled > 2.0**62, np.clip(scaled, 0, np.nextafter(2.0**63, 0)).astype(np.int64), inside))


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups of eight dimensions, rows) bytes of whole numbers in two's complement; the last plane is the sign."""
    n, dim = x.shape
    groups = -(-dim // 8)
    wide = np.zeros((n, 8 * groups), np.int64)
    wide[:, :dim] = x
    bits = 1 + max((int(v).bit_length() for v in (wide.max(initial=0), ~wide.min(initial=0))), default=0)
    out = np.empty((bits, groups, n), np.uint8)
    for p in range(bits):
        out[p] = np.packbits(((wide >> min(p, 63)) & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T
    return out


class AnchorTables:
    """The subset sums of a block of anchors (rows of whole numbers)."""

    def __init__(self, x: np.ndarray):
        n, dim = x.shape
        self.n, self.groups = n, -(-dim // 8)
        wide = np.zeros((n, 8 * self.groups), np.int64)
        wide[:, :dim] = x
        self.reach = dim * int(np.abs(wide.astype(np.float64)).max(initial=0))
        self.tables = np.zeros((self.groups, 256, n), np.int64)
        for j in range(8):
            self.tables[:, 1 << j : 2 << j] = self.tables[:, : 1 << j] + wide[:, j::8].T[:, None, :]
        self.short = self.tables.astype(np.int32) if self.reach < 1 << 29 else None

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """(rows, anchors) exact inner products with the rows whose bit planes these are."""
        bits, _, n = planes.shape
        tables = self.short if self.short is not None and self.reach << bits < 1 << 30 else self.tables
        total = np.zeros((n, self.n), tables.dtype)
        part, looked = np.empty_like(total), np.empty_like(total)
        for p in range(bits - 1, -1, -1):
            part[:] = 0
            for g in range(self.groups):
                np.take(tables[g], planes[p, g], axis=0, out=looked, mode="clip")
                part += looked
            np.left_shift(total, 1, out=total)
            if p == bits - 1:
                total -= part
            else:
                total += part
        return total


def pack(rows: DataFrame) -> DataFrame:
    """The rows in blocks of bit planes, in ascending order of id inside a block; grp is the task that packed it."""

    def run(batches):
        grp = TaskContext.get().partitionId()
        for held in _blocks(batches, BLOCK_ROWS):
            for dim, ids, labels, x in held:
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "grp": pa.array([grp], pa.int32()), "vec_ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "planes": [bit_planes(x[order]).tobytes()]})

    return common.stored(rows.select("vec_id", "label", "v").mapInArrow(run, BLOCKS), "packed")


def _blocks(batches, most: int):
    """For each few batches, (dim, ids, labels, whole numbers) of at most so many rows of one length."""
    held: dict[int, list] = {}
    for b in batches:
        lists = b.column(2)
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            x = whole_numbers(flat[starts[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0)))
            held.setdefault(dim, []).append((ids[at], labels[at], x))
            while sum(len(h[0]) for h in held[dim]) >= most:
                i, y, z = (np.concatenate(c) for c in zip(*held[dim], strict=True))
                yield [(dim, i[:most], y[:most], z[:most])]
                held[dim] = [(i[most:], y[most:], z[most:])]
    yield [(dim, *(np.concatenate(c) for c in zip(*parts, strict=True))) for dim, parts in held.items() if sum(len(h[0]) for h in parts)]


def anchor_blocks(rows: DataFrame) -> DataFrame:
    """The anchors' whole numbers in blocks, each with a number of its own."""
    spark = rows.sparkSession
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("vec_id", "label", "v")
    parts = max(1, min(common.shuffle_parts(spark), math.ceil(anchors.count() / BLOCK_ANCHORS)))

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for held in _blocks(batches, BLOCK_ANCHORS):
            for dim, ids, labels, x in held:
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [number], "vec_ids": [ids.tobytes()], "labels": [labels.tobytes()], "whole": [x.tobytes()]})
                number += 1

    return common.stored(anchors.repartition(parts).mapInArrow(run, ANCHORS), "anchors")


class _Best:
    """The first few (score, id) of each anchor and slot, while rows of one block of anchors come one after another."""

    def __init__(self, most: int):
        self.most, self.found = most, {}

    def push(self, anchor: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        new = list(zip((-scores).tolist(), ids.tolist(), strict=True))
        have = self.found.get((anchor, slot))
        self.found[anchor, slot] = sorted(have + new)[: self.most] if have else new[: self.most]

    def rows(self, block: int) -> pa.RecordBatch:
        flat = [(block, a, slot, -s, i) for (a, slot), best in self.found.items() for s, i in best]
        names = (("block", pa.int64()), ("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], kind) for k, (_, kind) in enumerate(names)], names=[n for n, _ in names])


def _first(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the most highest scores, highest first, ties in order of place."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:most]


def scored(packed: DataFrame, anchors: DataFrame, most: int, choose) -> DataFrame:
    """block, anchor (its place), slot, score, vec_id: of each group of candidates the first few that choose() pushes."""
    groups = packed.groupBy("dim").agg(F.collect_set("grp").alias("grps"))  # a number for each task that packed
    copies = anchors.join(groups, "dim").withColumn("grp", F.explode("grps")).drop("grps")
    sides = copies.withColumnsRenamed({"vec_ids": "a_ids", "labels": "a_labels"}).join(packed, ["dim", "grp"])
    columns = ["grp", "block", "dim", "a_ids", "a_labels", "whole", "vec_ids", "labels", "planes", *(["wanted"] if "wanted" in anchors.columns else [])]

    def run(batches):
        rows = (dict(zip(columns, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, block), mine in groupby(rows, key=lambda r: (r["grp"], r["block"])):
            best, tables = _Best(most), None
            for r in mine:
                if tables is None:
                    a_ids, a_labels = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                    tables = AnchorTables(np.frombuffer(r["whole"], np.int64).reshape(len(a_ids), r["dim"]))
                ids, labels = np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                planes = np.frombuffer(r["planes"], np.uint8)
                groups = -(-r["dim"] // 8)
                planes = planes.reshape(-1, groups, len(ids)) if groups else np.zeros((1, 0, len(ids)), np.uint8)
                choose(best, r, a_ids, a_labels, ids, labels, np.ascontiguousarray(tables.scores(planes).T).astype(np.int64))
            yield best.rows(block)

    spark = packed.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_PAIRS))
    try:
        return common.stored(sides.select(columns).mapInArrow(run, "block long, anchor int, slot int, score long, vec_id long"), "scored")
    finally:
        spark.conf.set(name, before)


def _take_positives(best: _Best, row: dict, a_ids, a_labels, ids, labels, scores) -> None:
    for a in range(len(a_ids)):
        at = np.flatnonzero((labels == a_labels[a]) & (ids != a_ids[a]))
        if len(at):
            at = at[_first(scores[a, at], POSITIVES)]
            best.push(a, 0, scores[a, at], ids[at])


def _take_negatives(best: _Best, row: dict, a_ids, a_labels, ids, labels, scores) -> None:
    for a, wanted in groupby(row["wanted"], key=lambda w: w["anchor"]):
        other = np.flatnonzero((labels != a_labels[a]) & (ids != a_ids[a]))
        mine = scores[a, other]
        for w in wanted:
            score = w["score"]
            at = np.flatnonzero((mine <= score) & (mine >= -(-LEAST_PERCENT * score // 100)))
            if len(at):
                at = at[_first(mine[at], NEGATIVES)]
                best.push(a, w["rank"], mine[at], ids[other[at]])


def _ranked(lists: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("block", "anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, v)."""
    rows = common.stored(rows, "vectors")
    packed, anchors = pack(rows), anchor_blocks(rows)
    positives = _ranked(scored(packed, anchors, POSITIVES, _take_positives), POSITIVES)
    positives = common.stored(positives.select("block", "anchor", "rank", "score", "vec_id"), "positives")
    wanted = positives.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("anchor", "rank", "score"))).alias("wanted"))  # BLOCK_ANCHORS * POSITIVES at most
    negatives = _ranked(scored(packed, anchors.join(wanted, "block"), NEGATIVES, _take_negatives), NEGATIVES)
    found = positives.select("block", "anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = _anchor_names(anchors)
    pairs = negatives.select("block", "anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["block", "anchor", "slot"]).join(names, ["block", "anchor"])
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _anchor_names(anchors: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(ids), pa.int64()), "anchor": pa.array(range(len(ids)), pa.int32()), "anchor_id": pa.array(ids, pa.int64())})

    return anchors.select("block", "vec_ids").mapInArrow(run, "block long, anchor int, anchor_id long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(usable(common.read_table(spark, sf_dir, "embeddings"))))
