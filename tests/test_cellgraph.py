"""Components by cells against a plain union of all pairs."""

import random

import pytest

from pointloom.operators import cellgraph
from pointloom.operators.cellgraph import cluster_components

SCHEMA = "scene_id int, segment int, point_id long, x double, y double, z double, label string"


def brute(rows, r, least):
    root = {p[2]: p[2] for p in rows if p[1] >= 0}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    live = [p for p in rows if p[1] >= 0]
    for k, a in enumerate(live):
        for b in live[:k]:
            if a[:2] == b[:2] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 < r * r:
                i, j = sorted((find(a[2]), find(b[2])))
                root[j] = i
    size = {}
    for i in root:
        size[find(i)] = size.get(find(i), 0) + 1
    return {i: find(i) if size[find(i)] >= least else None for i in root}


def clouds():
    rng = random.Random(2)
    rows = [(0, 1, rng.gauss(0, 0.3), rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for _ in range(300)]  # dense: many points of few cells
    rows += [(0, 1, 1.9 + rng.gauss(0, 0.25), rng.gauss(0, 0.25), 0.0) for _ in range(200)]  # and its neighbour, near the limit
    rows += [(0, 2, float(i), float(j), 0.0) for i in range(-8, 8) for j in range(8)]  # steps of just the reach
    rows += [(1, 0, i * 0.999, 0.0, -i * 1e-4) for i in range(-20, 20)]  # a chain just under it
    rows += [(1, 0, 100.0, 0.0, 0.0)] * 30 + [(1, 0, 101.0, 0.0, 0.0)] * 30 + [(1, -1, 100.5, 0.0, 0.0)]  # places that repeat
    rows += [(s, 3, *(rng.uniform(-6, 6) for _ in range(3))) for s in (0, 1) for _ in range(250)]
    rng.shuffle(rows)
    return [(s, seg, i, x, y, z) for i, (s, seg, x, y, z) in enumerate(rows)]


@pytest.mark.parametrize("r,least,few", [(1.0, 1, 1024), (1.6, 4, 60)])
def test_components(spark, r, least, few, monkeypatch):
    monkeypatch.setattr(cellgraph, "FEW", few)
    rows = clouds()
    df = spark.createDataFrame([(*p, "clash") for p in rows], SCHEMA)
    got = cluster_components(df, r, least).collect()
    want = brute(rows, r, least)
    assert len(got) == len(want) and {p.point_id: p.component for p in got} == want


def test_nothing(spark):
    df = spark.createDataFrame([(*p, "clash") for p in clouds()], SCHEMA)
    assert cluster_components(df.limit(0), 1.0).collect() == []
    assert cluster_components(df.where("segment < 0"), 1.0).collect() == []
    assert [tuple(p) for p in cluster_components(df.where("point_id = 5").withColumn("segment", df.segment * 0), 1.0).collect()] == [(5, 5)]


def test_a_place_is_one_row(spark, monkeypatch):
    """Heaps of points in one place cost as much as one point, and still count in full for the size of their component."""
    seen = {}
    keep = cellgraph.saved
    monkeypatch.setattr(cellgraph, "saved", lambda df, name: seen.setdefault(name, keep(df, name)))
    rows = [(0, 1, i, float(i % 2) * 5, 0.0, 0.0, "clash") for i in range(60)] + [(0, 1, 90, 20.0, 0.0, 0.0, "clash")]
    got = {p.point_id: p.component for p in cluster_components(spark.createDataFrame(rows, SCHEMA), 1.0, 3).collect()}
    assert got == {i: i % 2 for i in range(60)} | {90: None}
    assert seen["cell-points"].count() == 3
