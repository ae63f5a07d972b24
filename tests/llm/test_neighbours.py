"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import neighbours, queries


def brute(rows, queries_, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist()))
    return out


@pytest.mark.parametrize("table", ["given", "clustered"])
def test_recall(spark, table, tmp_path):
    path = "/root/testdata/sf0.01"
    if table == "clustered":
        path, rng = str(tmp_path), np.random.default_rng(7)
        centres = rng.normal(size=(40, 64))
        vectors = [(i, (centres[i % 40] + rng.normal(size=64) * (0.05 if i % 3 else 0.5)).tolist()) for i in range(5000)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = queries.op6_nearest(spark, path).collect()
    vectors = dict(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert r.score == pytest.approx(np.sqrt(((np.array(vectors[r.query_id]) - np.array(vectors[r.vec_id])) ** 2).sum()), abs=1e-12)
    assert set(found) == set(want)
    hits = total = 0
    for q, best in want.items():
        mine = [found[q][k] for k in sorted(found[q])]
        assert sorted(found[q]) == list(range(1, len(best) + 1)) and mine == sorted(mine, key=lambda x: (x[1], x[0]))
        hits, total = hits + len({i for i, _ in mine} & {i for i, _ in best}), total + len(best)
    print("recall", hits / total)
    assert hits / total >= 0.9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [3.0, 0.0]), (100, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (100, [1.0, 1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (0, 4, 100, 1.0), (0, 5, 8, 2.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0), (100, 4, 8, pytest.approx(5**0.5))]
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_shared_queue_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 8))
    f = neighbours.Forest.grow(x, trees=5, leaf=10)
    walk = f.walk(x[0] @ f.normal.T - f.offset, np.inf)
    assert sorted(leaf for _, leaf in walk) == list(range(len(f.share))) and walk[-1][0] == pytest.approx(5)
    at = f.leaves(x)
    assert all(f.tree[at[:, t]].tolist() == [t] * 500 for t in range(5)) and np.bincount(at.ravel(), minlength=len(f.share)) == pytest.approx(f.share * 500)
