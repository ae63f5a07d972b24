"""Ranked lexical search over a document FP-tree.

A document becomes the vector of those of its terms that items ask for, with their frequencies. Tasks read the vectors in blocks of
``BLOCK`` documents and build an FP-tree of each: terms in order of document frequency, the most frequent first, so that vectors share
paths from the root; single-child paths are one edge, and a node of at most ``LEAF`` documents is not split. Every node knows the largest
frequency of each term and the least m below it. As a score rises with frequencies and falls with m, both bound what any document
below can score. Each item is searched depth first, the best bound first, and a branch goes whose bound is under the tenth score that
the task has found so far. Tasks hand on ten documents for each item at most; the ten best of these are the result.

Items go in lots of ``ITEMS``; only a lot's terms and their counts reach the driver.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import scratch, written

BLOCK = 8192
LEAF = 64
ITEMS = 500
TOP = 10
#: Bytes that stand in no term become spaces, A-Z small letters; bytes from 0x80 on belong to terms.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(FOLD).split()


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Of documents' vectors: CSR arrays of term ranks (ascending in each row) and frequencies, with m and doc_id of each row."""

    def __init__(self, offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, docs: list, n_terms: int):
        rows = [ranks[i:j].tolist() for i, j in itertools.pairwise(offsets)]
        order = sorted(range(len(rows)), key=lambda i: (rows[i], m[i]))
        self.n_terms = n_terms
        self.kids: list[tuple[int, int]] = []  # of each node: its children are nodes kids[0] to kids[1], none for a leaf
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]] = {}
        spans, maxima, least = [(0, len(order), 0)], [], []
        done = 0
        while done < len(spans):  # breadth first, so that a node's children stand side by side
            lo, hi, depth = spans[done]
            mine = order[lo:hi]
            if hi - lo <= LEAF:
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in mine])
                own, local = np.unique(ranks[at], return_inverse=True)
                dense = np.zeros((hi - lo, len(own)), np.int64)
                dense[np.repeat(np.arange(hi - lo), [offsets[i + 1] - offsets[i] for i in mine]), local] = tfs[at]
                self.leaves[done] = own, dense, m[mine], [docs[i] for i in mine]
                self.kids.append((0, 0))
            else:
                first, last = rows[order[lo]], rows[order[hi - 1]]
                while depth < min(len(first), len(last)) and first[depth] == last[depth]:
                    depth += 1
                begin = len(spans)
                if depth == len(last):  # one and the same vector: leaves side by side
                    spans += [(i, min(i + LEAF, hi), depth) for i in range(lo, hi, LEAF)]
                else:
                    i = lo
                    for _, same in itertools.groupby(mine, key=lambda i: rows[i][depth] if depth < len(rows[i]) else -1):
                        j = i + sum(1 for _ in same)
                        spans.append((i, j, depth))
                        i = j
                self.kids.append((begin, len(spans)))
            done += 1
        self.maxima, self.least = np.zeros((len(spans), n_terms), np.int32), np.full(len(spans), np.iinfo(np.int64).max)
        for node in range(len(spans) - 1, -1, -1):
            if node in self.leaves:
                own, dense, ms, _ = self.leaves[node]
                self.maxima[node, own] = dense.max(0)
                self.least[node] = ms.min()
            else:
                i, j = self.kids[node]
                self.maxima[node] = self.maxima[i:j].max(0)
                self.least[node] = self.least[i:j].min()

    def search(self, query: np.ndarray, weights: np.ndarray, best: list[tuple[int, bool, int]]) -> None:
        """Puts the documents that belong among the ``TOP`` best into ``best``, a heap of (score, has an id, minus the id)."""
        stack = [(int(part(self.maxima[0, query].astype(np.int64), self.least[0]) @ weights), 0)]
        while stack:
            bound, node = stack.pop()
            if not bound or len(best) == TOP and bound < best[0][0]:
                continue
            if node in self.leaves:
                own, dense, m, docs = self.leaves[node]
                at = np.minimum(np.searchsorted(own, query), len(own) - 1)
                tf = np.where(own[at] == query, dense[:, at], 0)
                scores = part(tf, m[:, None]) @ weights
                for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == TOP else 1)).tolist():
                    found = int(scores[i]), docs[i] is not None, -(docs[i] or 0)
                    if len(best) < TOP:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
            else:
                i, j = self.kids[node]
                bounds = part(self.maxima[i:j, query].astype(np.int64), self.least[i:j, None]) @ weights
                stack += [(int(bounds[k]), i + int(k)) for k in np.argsort(bounds)]


def vectors(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs (of those that are asked for) of each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = ids.get
        for batch in batches:
            keep, sizes, own, tfs, offsets = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if words:
                    counts = Counter(map(get, words))
                    counts.pop(None, None)
                    keep.append(i)
                    sizes.append(len(words))
                    own += counts.keys()
                    tfs += counts.values()
                    offsets.append(len(own))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(own, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids array<int>, tfs array<long>")


def search_lot(docs: DataFrame, lot: list[tuple], first: int) -> DataFrame:
    """item (its number), rank, doc_id, score for one lot of (item_id, text)."""
    asked = [Counter(terms(text)) for _, text in lot]
    ids = {t: i for i, t in enumerate(dict.fromkeys(itertools.chain.from_iterable(asked)))}
    rows = written(vectors(docs, ids), "fp-vectors")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["id"]: r["count"] for r in rows.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator()}
    by_count = sorted(df, key=lambda i: (-df[i], i))
    rank = np.full(len(ids) + 1, -1)
    rank[by_count] = np.arange(len(by_count))
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i in df}
    queries = []
    for counts in asked:
        known = sorted((int(rank[ids[t]]), k * weight[ids[t]]) for t, k in counts.items() if ids[t] in df)
        queries.append((np.array([r for r, _ in known], np.int64), np.array([w for _, w in known], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]

        def block(rows: pa.Table) -> None:
            rows = rows.combine_chunks()
            sizes = np.diff(np.concatenate([[0], np.cumsum([len(x) for x in rows.column("ids")])]))
            own, tfs = (np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks]) for name in ("ids", "tfs"))
            m = 25 + 75 * rows.column("n").to_numpy() * n_docs // n_terms
            row, r = np.repeat(np.arange(len(sizes)), sizes), rank[own]
            order = np.lexsort((r, row))
            tree = Tree(np.concatenate([[0], np.cumsum(sizes)]), r[order], tfs[order], m, rows.column("doc_id").to_pylist(), len(by_count))
            for (query, weights), heap in zip(queries, best, strict=True):
                if len(query):
                    tree.search(query, weights, heap)

        waiting, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                waiting.append(batch.slice(i, BLOCK))
                size += waiting[-1].num_rows
                if size >= BLOCK:
                    block(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if size:
            block(pa.Table.from_batches(waiting))
        out = [(first + i, -d if has else None, s) for i, heap in enumerate(best) for s, has, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["item", "doc_id", "score"])

    found = rows.where(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs").mapInArrow(run, "item long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    return written(ranked.where(F.col("rank") <= TOP).select("item", "rank", "doc_id", "score"), "fp-found", keep=True)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ten best documents with a score above 0, ties by doc_id, null last.

    Rows of ``items`` that repeat are items of their own; null, empty or termless texts find nothing. Documents that repeat are
    ranked each; null and empty texts count nowhere; an empty table finds nothing; texts are read whole."""
    spark = docs.sparkSession
    out, number = None, 0
    schema = f"item long, item_id {items.schema['item_id'].dataType.simpleString()}"
    rows = iter(items.select("item_id", "text").toLocalIterator())
    with scratch(spark):
        while lot := [(r["item_id"], r["text"]) for r in itertools.islice(rows, ITEMS)]:
            found = search_lot(docs, lot, number)
            names = spark.createDataFrame([(number + i, item) for i, (item, _) in enumerate(lot)], schema)
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # ITEMS rows at most
            out, number = found if out is None else out.unionByName(found), number + len(lot)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
