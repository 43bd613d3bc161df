"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where a larger cosine is a smaller distance. A tree node
holds a vantage point and the median distance to it; a query goes down the side it lies in
and into the other only if the triangle inequality leaves room for a nearer vector:
|d - median| <= factor * (distance of the k-th best so far). Factor one is exact; smaller
factors prune more. All queries of a block go down a tree together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a shard and queries of a block, on average; leaves of a tree.
SHARD, QUERIES, LEAF = 8192, 1024, 64
#: Queries that a task holds, and groups of shards that all queries go to at least, if there are as many shards.
HELD, GROUPS = 1 << 18, 48
#: Distances are doubles; a side is left out only if it is farther by more than their rounding.
ROUNDING = 1e-9


def usable(v: Column) -> Column:
    """Vectors that have a direction: not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed from left to right, so that equal vectors get equal results."""

    q, v = np.asarray(q, np.float64), np.asarray(v, np.float64)

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for i in range(a.shape[1]):
            out += a[:, i] * b[:, i]
        return out

    return dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """order: rows of the shard; a node covers order[lo:hi], its vantage point first, then the inner half, then the outer."""

    order: np.ndarray
    nodes: dict[tuple[int, int], tuple[int, float]]  # (lo, hi) -> (start of the outer half, median)

    @staticmethod
    def grow(points: np.ndarray, seed: int = 1) -> Tree:
        order = np.arange(len(points))
        rnd = np.random.default_rng(seed)
        nodes: dict[tuple[int, int], tuple[int, float]] = {}
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                continue
            pick = int(rnd.integers(lo, hi))
            order[lo], order[pick] = order[pick], order[lo]
            rest = order[lo + 1 : hi]
            d = np.sqrt(np.maximum(0, 2 - 2 * (points[rest] @ points[order[lo]])))
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi] = rest[by]
            half = lo + 1 + (hi - lo - 1) // 2
            nodes[lo, hi] = half, float(d[by[half - lo - 1]])
            if d[by[0]] == d[by[-1]]:
                continue  # all at one distance, as copies are: read as a leaf
            todo += [(lo + 1, half), (half, hi)]
        return Tree(order, nodes)


class Best:
    """The k best of each query: larger cosine first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        worst = self.score[rows, -1]
        return np.where(np.isneginf(worst), np.inf, np.sqrt(np.maximum(0, 2 - 2 * worst)))

    def offer(self, rows: np.ndarray, vectors: np.ndarray, units: np.ndarray, ids: np.ndarray, unit_queries: np.ndarray) -> None:
        """Candidates ids for the queries rows: a product in blocks finds those near enough, which are measured exactly."""
        for a in range(0, len(ids), 4096):
            near = unit_queries[rows] @ units[a : a + 4096].T
            near[self.ids[rows][:, None] == ids[a : a + 4096][None, :]] = -np.inf
            k = min(self.k, near.shape[1])
            floor = np.maximum(self.score[rows, -1], np.partition(near, -k, axis=1)[:, -k]) - ROUNDING
            i, j = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
            if len(i):
                self._merge(rows[i], ids[a + j], cosine(self.queries[rows[i]], vectors[a + j]))

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(row)
        row = np.concatenate([row, np.repeat(own, self.k)])
        ids = np.concatenate([ids, self.found[own].ravel()])
        score = np.concatenate([score, self.score[own].ravel()])
        by = np.lexsort((ids, -score, row))
        row, ids, score = row[by], ids[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.score[row[keep], rank[keep]] = score[keep]
        self.found[row[keep], rank[keep]] = ids[keep]


def search(tree: Tree, vectors: np.ndarray, units: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
    """All queries of best against one shard."""
    unit_queries = unit(best.queries)

    def visit(lo: int, hi: int, rows: np.ndarray) -> None:
        node = tree.nodes.get((lo, hi))
        if node is None or (lo + 1, node[0]) not in tree.nodes and (node[0], hi) not in tree.nodes:
            at = tree.order[lo:hi]
            best.offer(rows, vectors[at], units[at], ids[at], unit_queries)
            return
        half, median = node
        at = tree.order[lo : lo + 1]
        best.offer(rows, vectors[at], units[at], ids[at], unit_queries)
        d = np.sqrt(np.maximum(0, 2 - 2 * (unit_queries[rows] @ units[at[0]])))
        inside = d < median
        sides = (((lo + 1, half), inside, d - median), ((half, hi), ~inside, median - d))
        for (a, b), near, _ in sides:
            if near.any():
                visit(a, b, rows[near])
        for (a, b), near, apart in sides:
            open_ = ~near & (apart <= factor * best.reach(rows) + ROUNDING)
            if open_.any():
                visit(a, b, rows[open_])

    if len(ids):
        visit(0, len(ids), np.arange(len(best.queries)))


def distinct(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id; those that repeat an id stand once, with the smallest vector."""
    by = np.lexsort((*points.T[::-1], ids))
    ids, points = ids[by], points[by]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], points[first]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, int], np.ndarray, np.ndarray]]:
    """(key, ids, vectors) of rows (task, asked, dim, shard, id, v) that are sorted by the first four, in runs of one key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        ids, v = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield tuple(keys[:, a].tolist()), ids[a:b], v[a:b].flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)


def _searched(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the k best of a task's queries, which come first, among its vectors, which come by shard.

    A shard's tree is built, searched by all blocks of queries and dropped; what they have found so far narrows the next.
    """
    asked: dict[int, list[Best]] = {}  # by dim
    task = key = None
    ids: list[np.ndarray] = []
    points: list[np.ndarray] = []

    def close() -> None:
        """The run of key ends."""
        if not ids:
            return
        own, rows = np.concatenate(ids), np.concatenate(points)
        ids.clear()
        points.clear()
        if key[1] == 0:
            asked.setdefault(key[2], []).append(Best(rows, own, k))
        elif key[2] in asked:
            own, rows = distinct(own, rows.astype(np.float64))
            units = unit(rows)
            tree = Tree.grow(units)
            for best in asked[key[2]]:
                search(tree, rows, units, own, best, factor)

    def found() -> Iterator[pa.RecordBatch]:
        for best in (x for of in asked.values() for x in of):
            q, j = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, j]), pa.array(best.score[q, j])], names=["query_id", "vec_id", "score"])

    for now, own, rows in _runs(batches):
        if now != key:
            close()
            key = now
        if now[0] != task:
            yield from found()
            asked.clear()
            task = now[0]
        ids.append(own)
        points.append(rows)
        if now[1] and sum(map(len, ids)) > 8 * SHARD:  # rows that repeat an id
            own, rows = distinct(np.concatenate(ids), np.concatenate(points))
            ids[:], points[:] = [own], [rows]
    close()
    yield from found()


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows, by cosine, of the rows for which is_query holds.

    Rows whose vector is null, empty or zero or holds a null or non-finite component take no part, nor do rows without
    an id. A query's own id is no candidate. Vectors of another length are no candidates. Rows that repeat an id count
    once, with the smallest of their vectors. With fewer candidates than k all are returned; an empty table gives none.
    Tasks are a grid: each has one group of shards and at most HELD queries on average. A query is sent to every group, a
    vector to every HELD queries; there are as many groups as there are vectors to a query, so that queries weigh no more
    than vectors, and GROUPS at least. Nothing goes through the driver but two counts.
    """
    kind = vectors.schema[vector].dataType
    own = F.col(vector) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>")
    count = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n, q = count["n"], count["q"]
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // QUERIES))
    groups, parts = min(shards, max(GROUPS, n // max(q, 1))), max(1, -(-q // HELD))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    usable_ = usable(F.col(vector)) & F.col(id).isNotNull()
    rows = vectors.where(usable_).select(F.col(id).cast("long").alias("id"), own.alias("v")).withColumn("shard", place(shards))
    rows = rows.select(numbers(parts).alias("part"), F.lit(1).alias("asked"), "shard", "id", "v").withColumn("task", F.col("shard") % groups * parts + F.col("part"))
    asked = vectors.where(is_query & usable_).select(F.col(id).cast("long").alias("id"), own.alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("shard", place(blocks))
    asked = asked.select(numbers(groups).alias("group"), F.lit(0).alias("asked"), "shard", "id", "v").withColumn("task", F.col("group") * parts + F.col("shard") % parts)
    columns = ["task", "asked", F.size("v").alias("dim"), "shard", "id", "v"]
    both = asked.select(*columns).unionByName(rows.select(*columns))
    both = both.repartitionById(groups * parts, F.col("task")).sortWithinPartitions("task", "asked", "dim", "shard")
    found = both.mapInArrow(lambda batches: _searched(batches, k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: Brute force for the same queries; sums run from left to right, as the operator's do.
OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, x -> x * x), (a, b) -> a + b)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  list_reduce(list_transform(list_zip(q.e, c.e), p -> p[1] * p[2]), (a, b) -> a + b) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND q.l > 0 AND c.l > 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
