"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

The trees are fitted on a bounded sample; every row is then dropped into one leaf of each tree. A query walks all trees at
once: the queue holds nodes of every tree by the smallest margin on the way, so the most promising leaf of any tree comes
next. It stops when the leaves it has visited hold a share of rows that was calibrated: on sample queries with known
neighbours, the smallest share that finds the wanted part of them. Rows in the visited leaves are reranked by exact distance.

In Spark, rows and queries are packed into blocks. Each block of rows meets each block of queries once (a stated query set
against all rows); a task searches one pair of blocks in numpy and returns the best of it, so no candidate pair is ever a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import written

SAMPLE = 8192
TREES = 16
LEAF = 24
WANTED = 0.97
PROBES = 96
ROWS, QUERIES = 2048, 256


@dataclass
class Forest:
    """Complete description of all trees: node k of the forest splits by ``normal[k] . x > offset[k]`` into children
    ``kids[k]``; a leaf is -1 - its number. ``share`` is the part of the sample in each leaf, ``tree`` the tree of a leaf."""

    normal: np.ndarray
    offset: np.ndarray
    kids: np.ndarray
    roots: list[int]
    share: np.ndarray
    tree: np.ndarray
    effort: float = 1.0

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        normals, offsets, kids, roots, shares, owner = [], [], [], [], [], []

        def split(rows: np.ndarray, t: int) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    n = a - b
                    size = np.linalg.norm(n)
                    if size == 0:
                        continue
                    side = x[rows] @ (n / size)
                    low = np.partition(side, (len(side) - 1) // 2)[(len(side) - 1) // 2]
                    up = side > low + 1e-9
                    if 0 < up.sum() < len(rows):
                        cut = (side[~up].max() + side[up].min()) / 2  # between two rows, clear of rounding
                        k = len(normals)
                        normals.append(n / size)
                        offsets.append(cut)
                        kids.append((0, 0))
                        kids[k] = (split(rows[~up], t), split(rows[up], t))
                        return k
            shares.append(len(rows) / max(len(x), 1))
            owner.append(t)
            return -len(shares)

        for t in range(trees):
            roots.append(split(np.arange(len(x)), t))
        d = x.shape[1] if x.ndim == 2 else 1
        return cls(np.array(normals).reshape(-1, d), np.array(offsets), np.array(kids, dtype=np.int64).reshape(-1, 2), roots, np.array(shares), np.array(owner))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, rows x trees; a few rows at a time, since each meets every node."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for i in range(0, len(x), 128):
            side = x[i : i + 128] @ self.normal.T > self.offset
            for t, root in enumerate(self.roots):
                at = np.full(len(side), root)
                while (inner := np.flatnonzero(at >= 0)).size:
                    at[inner] = self.kids[at[inner], side[inner, at[inner]].astype(int)]
                out[i : i + 128, t] = -1 - at
        return out

    def walk(self, margins: np.ndarray, effort: float) -> list[tuple[float, int]]:
        """(share visited so far, leaf) in the order of the shared queue, until the share reaches ``effort``."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        seen, out, kids, share = 0.0, [], self.kids, self.share
        while queue and seen < effort:
            worst, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near, far = (kids[node][1], kids[node][0]) if m > 0 else (kids[node][0], kids[node][1])
                heapq.heappush(queue, (max(worst, abs(m)), int(far)))
                node = near
            leaf = -1 - int(node)
            seen += share[leaf]
            out.append((seen, leaf))
        return out

    def calibrate(self, x: np.ndarray, k: int, wanted: float, probes: int, seed: int = 4) -> None:
        """Sets ``effort`` to what finds ``wanted`` of the true neighbours of sample queries."""
        if len(x) < 2:
            return
        rng = np.random.default_rng(seed)
        at, need = self.leaves(x), []
        for q in rng.choice(len(x), min(probes, len(x)), replace=False):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            true = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            reached = np.full(len(self.share), np.inf)
            for seen, leaf in self.walk(x[q] @ self.normal.T - self.offset, np.inf):
                reached[leaf] = seen
            need += list(reached[at[true]].min(axis=1))
        self.effort = float(np.quantile(need, wanted, method="higher")) * 1.0000001


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: with an id, not null, not zero, all components present and finite, and of the length that most
    of these vectors have (of two such lengths the smaller)."""
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return df.where(~bad & F.exists("vector", lambda v: v != 0))


def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of at most ``rows`` vectors: block, ids and the matrix as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                x = np.array(part.column(1).flatten(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(part.column(0), dtype=np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "matrix"])

    return written(df.mapInArrow(run, "ids binary, matrix binary").select(F.monotonically_increasing_id().alias("block"), "*"), name)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", query=None, k: int = 10, wanted: float = WANTED, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) of the ``k`` nearest rows found for
    every row that ``query`` (a condition on id) selects; ties go to the smaller id.

    Rows that ``usable`` leaves out take no part. Rows that share an id are separate candidates; a query leaves out all
    rows of its own id and is asked once, with the least of its vectors. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = written(usable(df, key, vector), "ann-rows")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = size.d
    rows = rows.where(F.size("vector") == dim)
    query = F.col("id") % 100 == 0 if query is None else query
    # by the least hashes; those far above the wanted share stay where they are
    n = rows.count()
    few = rows if n <= 2 * sample else rows.where(F.xxhash64("id") < F.lit(int(-(2**63) + 1.5 * sample / n * 2**64)))
    x = np.array([r.vector for r in few.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).collect()])
    forest = Forest.grow(x)
    forest.calibrate(x, k, wanted, PROBES)
    shared = spark.sparkContext.broadcast(forest)
    blocks = packed(rows, ROWS, "ann-blocks")
    asked = packed(rows.where(query).groupBy("id").agg(F.min("vector").alias("vector")), QUERIES, "ann-queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, last = shared.value, None
        for batch in batches:
            for ids, matrix, q_ids, q_matrix, block in zip(*(batch.column(i) for i in range(5))):
                if block != last:  # a block meets its blocks of queries one after the other, and is dropped into leaves once
                    v = np.frombuffer(matrix.as_py(), np.float64).reshape(-1, dim)
                    names, at, last = np.frombuffer(ids.as_py(), np.int64), f.leaves(v), block
                q = np.frombuffer(q_matrix.as_py(), np.float64).reshape(-1, dim)
                margins = q @ f.normal.T - f.offset
                out = [[], [], []]
                for i, name in enumerate(np.frombuffer(q_ids.as_py(), np.int64)):
                    open_ = np.zeros(len(f.share), bool)
                    open_[[leaf for _, leaf in f.walk(margins[i], f.effort)]] = True
                    found = np.flatnonzero(open_[at].any(axis=1) & (names != name))
                    d = np.sqrt(((v[found] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((names[found], d))[:k]
                    out[0].append(np.full(len(best), name))
                    out[1].append(names[found][best])
                    out[2].append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    # each block of rows meets each block of queries: the queries, one row in a hundred, are what is repeated
    keys = max(1, blocks.count())
    sent = asked.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("place"))
    placed = blocks.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(keys)).cast("int"))
    met = placed.join(sent.hint("merge"), "place").select("ids", "matrix", "q_ids", "q_matrix", "block").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
