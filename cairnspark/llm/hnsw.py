"""Approximate nearest neighbours by a navigable small-world graph per shard.

Equal vectors are one node with their k + 1 smallest ids, which is all that a
list of k neighbours with ties to smaller ids can hold of them. The different
vectors are dealt into shards by hash. Each shard's
graph is built in one task and stored as flat arrays: the neighbours of node i
in layer 0 are row i of one array, those in upper layers rows of smaller ones.
Queries go to every shard in blocks; the shards' lists are merged by score and
id. Scores are cosines in double precision on the original vectors.

Defined results: vectors that are null, zero, empty, or hold nulls or
non-finite components take no part, nor do rows with a null id; vectors of
different lengths are no neighbours; rows with equal ids and vectors count
once; rows with equal ids and different vectors are neighbours of their own,
never of each other, and as queries give one list of the k nearest of all of
them; an empty table, of rows or of queries, gives no row; other columns are
left out.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Shards grow from SHARD_ROWS vectors, when there are as many as tasks, to SHARD_NUMBERS numbers.
SHARD_ROWS, SHARD_NUMBERS, BLOCK_QUERIES = 4096, 8 << 20, 16_384
LINKS, EF_BUILD, EF_SEARCH = 12, 48, 96


class FlatHnsw:
    """layers: for each layer its nodes' row numbers (-1: none) and their neighbours (-1: none)."""

    def __init__(self, unit: np.ndarray, entry: int, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.entry, self.layers = unit, entry, layers

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 5) -> FlatHnsw:
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        levels = (-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int)
        layers = []
        for level in range(int(levels.max()) + 1):
            nodes = np.flatnonzero(levels >= level)
            row = np.full(n, -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            layers.append((row, np.full((len(nodes), links * (2 if level == 0 else 1)), -1, np.int32)))
        self = cls(unit, 0, layers)
        top = int(levels[0])
        for i in range(1, n):
            at = [(float(unit[self.entry] @ unit[i]), self.entry)]
            for level in range(top, int(levels[i]), -1):
                at = self._search(unit[i], at[:1], 1, level)
            for level in range(min(top, int(levels[i])), -1, -1):
                at = self._search(unit[i], at, ef, level)
                row, table = layers[level]
                chosen = self._spread([x for _, x in at], [s for s, _ in at], links)
                table[row[i], : len(chosen)] = chosen
                for c in chosen:
                    mine = table[row[c]]
                    used = int((mine >= 0).sum())
                    if used < len(mine):
                        mine[used] = i
                    else:
                        every = np.append(mine, i)
                        sims = unit[every] @ unit[c]
                        order = np.argsort(-sims, kind="stable")
                        new = self._spread(every[order].tolist(), sims[order].tolist(), len(mine))
                        mine[:] = -1
                        mine[: len(new)] = new
            if levels[i] > top:
                top, self.entry = int(levels[i]), i
        return self

    def _spread(self, nodes: list[int], sims: list[float], most: int) -> list[int]:
        """The nearest nodes that are nearer to the centre than to each other, filled up with the rest."""
        if len(nodes) <= most:
            return nodes
        between = self.unit[nodes] @ self.unit[nodes].T
        kept, rest = [], []
        for k in range(len(nodes)):
            if len(kept) == most:
                break
            (kept if not kept or sims[k] > between[k, kept].max() else rest).append(k)
        return [nodes[k] for k in (kept + rest)[:most]]

    def _search(self, q: np.ndarray, at: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef best (similarity, node) reached in a layer, best first."""
        row, table = self.layers[level]
        unit, seen = self.unit, {x for _, x in at}
        todo = [(-s, x) for s, x in at]
        heapq.heapify(todo)
        best = list(at)
        heapq.heapify(best)
        while todo:
            s, x = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [y for y in table[row[x]].tolist() if y >= 0 and y not in seen]
            if not new:
                continue
            seen.update(new)
            for sim, y in zip((unit[new] @ q).tolist(), new, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (sim, y))
                    heapq.heappush(todo, (-sim, y))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, y))
                    heapq.heappush(todo, (-sim, y))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(len(self.layers) - 1, 0, -1):
            at = self._search(q, at[:1], 1, level)
        return [x for _, x in self._search(q, at, ef, 0)]


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which is exact but for components far below it."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def unit_of(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = scaled(a), scaled(b)
    return float(np.dot(a, b)) / (float(np.linalg.norm(a)) * float(np.linalg.norm(b)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build_index(table: DataFrame, k: int) -> DataFrame:
    """One row for each shard: its vectors, ids and graph as flat arrays."""
    spark = table.sparkSession
    order = Window.partitionBy("v").orderBy("vec_id")
    small = table.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k + 1)
    nodes = common.stored(small.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "nodes")
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, math.ceil(n * (dim or 1) / SHARD_NUMBERS), min(common.shuffle_parts(spark), math.ceil(n / SHARD_ROWS)))
    dealt = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(shard: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        v = _matrix(rows.column("v").chunk(0))
        order = np.lexsort(v.T[::-1])
        v, ids = v[order], [rows.column("ids")[int(i)].as_py() for i in order]
        unit = unit_of(v).astype(np.float32)
        graph = FlatHnsw.build(unit)
        table = np.full((len(ids), k + 1), -1, np.int64)
        for i, x in enumerate(ids):
            table[i, : len(x)] = x
        return pa.table({"shard": [shard[1].as_py()], "dim": [v.shape[1]], "v": [v.tobytes()], "ids": [table.tobytes()], "entry": [graph.entry], "rows": [[r.tobytes() for r, _ in graph.layers]], "links": [[t.tobytes() for _, t in graph.layers]]}, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("v", pa.binary()), ("ids", pa.binary()), ("entry", pa.int64()), ("rows", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    common.tune(spark)
    return common.stored(dealt.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "shard int, dim int, v binary, ids binary, entry long, rows array<binary>, links array<binary>"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (vec_id, v)."""
    n = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    blocked = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.select("*", every.alias("block"))
    names = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))  # a number for each shard
    asked = blocked.withColumn("dim", F.size("v")).join(names, "dim").select("vec_id", "v", "block", "dim", F.explode("shards").alias("shard"))

    def run(_, graph: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(graph) and len(asked):
            g = graph.to_pylist()[0]
            dim = g["dim"]
            v, ids = np.frombuffer(g["v"], np.float64).reshape(-1, dim), np.frombuffer(g["ids"], np.int64)
            ids = ids.reshape(len(v), -1)
            unit = unit_of(v)
            layers = []
            for r, t in zip(g["rows"], g["links"], strict=True):
                row = np.frombuffer(r, np.int32)
                layers.append((row, np.frombuffer(t, np.int32).reshape(int((row >= 0).sum()), -1)))
            net = FlatHnsw(unit.astype(np.float32), g["entry"], layers)
            for q, x in zip(asked.column("vec_id").to_pylist(), asked.column("v").to_pylist(), strict=True):
                x = np.array(x)
                near = np.array(net.search(unit_of(x[None])[0].astype(np.float32), max(ef, k)))
                scores = [cosine(v[i], x) for i in near]
                found = [(-s, int(i)) for s, node in zip(scores, near, strict=True) for i in ids[node] if i >= 0 and i != q]
                for s, i in sorted(found)[:k]:
                    out[0].append(q)
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    lists = graphs.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = usable(common.read_table(spark, sf_dir, "embeddings"))
    return search(build_index(table, 5), table.where(F.col("vec_id") % 50 == 0), 5)
