"""Hulls and smallest oriented boxes against brute force and known boxes."""

from itertools import combinations

import numpy as np
import pytest

from pointloom.operators import boxes

SCHEMA = "scene_id int, x double, y double, z double"


def turn(rng) -> np.ndarray:
    return np.linalg.qr(rng.normal(size=(3, 3)))[0]


def brute(p: np.ndarray) -> float:
    """Every plane through three points with all others on one side, and every direction of two points in it."""
    out = np.inf
    for a, b, c in combinations(p, 3):
        w = np.cross(b - a, c - a)
        w = w / np.linalg.norm(w)
        side = (p - a) @ w
        if side.min() < -1e-9 and side.max() > 1e-9:
            continue
        for d, e in combinations(p, 2):
            x = (e - d) - ((e - d) @ w) * w
            if np.linalg.norm(x) > 1e-9:
                x = x / np.linalg.norm(x)
                out = min(out, float(np.ptp(side) * np.ptp(p @ x) * np.ptp(p @ np.cross(w, x))))
    return out


def box(spark, rows, parts=4):
    return {r["scene_id"]: r for r in boxes.scene_boxes(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}


def test_hull_holds_all_points():
    rng = np.random.default_rng(2)
    for p in (rng.normal(size=(3000, 3)), np.round(rng.uniform(0, 6, (3000, 3))), rng.uniform(0, 1, (500, 3)).repeat(2, 0) @ turn(rng)):
        p = np.unique(p, axis=0)
        faces = boxes.hull3(p, 1e-9)
        n = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        assert ((p @ n.T) - (p[faces[:, 0]] * n).sum(1)).max() < 1e-8
        corners, _ = boxes.hull(p)
        assert (corners.max(0) == p.max(0)).all() and (corners.min(0) == p.min(0)).all()


def test_smallest_box_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    clouds = {s: rng.normal(size=(9, 3)) * [1, 2, 4] for s in range(4)}
    monkeypatch.setattr(boxes, "FAN", 2)  # a tree of several steps
    got = box(spark, [(s, *map(float, q)) for s, p in clouds.items() for q in p], parts=7)
    for s, p in clouds.items():
        assert np.prod(np.subtract(got[s]["hi"], got[s]["lo"])) == pytest.approx(brute(p), rel=1e-9)


def test_turned_boxes_are_found(spark):
    rng = np.random.default_rng(7)
    edges, rows = {0: (3, 5, 9), 1: (2, 2, 2), 2: (10, 0.5, 4)}, []
    for s, e in edges.items():
        corners = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)]) * e
        p = np.vstack([corners, rng.uniform(0, 1, (400, 3)) * e]) @ turn(rng) + 50
        rows += [(s, *map(float, q)) for q in p]
    got = box(spark, rows)
    for s, e in edges.items():
        assert sorted(np.subtract(got[s]["hi"], got[s]["lo"])) == pytest.approx(sorted(e), rel=1e-9)


def test_flat_sets_and_holes(spark):
    rng = np.random.default_rng(9)
    flat = np.column_stack([np.array([[0, 0], [4, 0], [0, 3], [4, 3], [1, 1]], dtype=float), np.zeros(5)]) @ turn(rng)
    line = np.outer([0.0, 2.0, 5.0, 5.0], [0.6, 0.0, 0.8])
    rows = [(1, *map(float, q)) for q in flat] + [(2, *map(float, q)) for q in line] + [(3, 7.0, 8.0, 9.0)] * 3
    rows += [(1, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0), (2, float("inf"), 1.0, 1.0), (4, None, None, None), (None, 1.0, 1.0, 1.0)]
    got = box(spark, rows)
    assert set(got) == {1, 2, 3}
    for s, e in ((1, [0, 3, 4]), (2, [0, 0, 5]), (3, [0, 0, 0])):
        assert sorted(np.subtract(got[s]["hi"], got[s]["lo"])) == pytest.approx(e, abs=1e-9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert boxes.crop_obb(df, df).count() == 5 + 4 + 3
    assert boxes.crop_obb(df, df.limit(0)).count() == 0


def test_round_hulls_are_thinned_and_hold_all(spark, monkeypatch):
    monkeypatch.setattr(boxes, "CORNERS", 200)
    p = np.random.default_rng(3).normal(size=(3000, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    rows = [(0, *map(float, q)) for q in p]
    r = box(spark, rows)[0]
    places = p @ np.array(r["axes"]).reshape(3, 3).T
    assert (places >= np.array(r["lo"]) - 1e-12).all() and (places <= np.array(r["hi"]) + 1e-12).all()
    assert np.prod(np.subtract(r["hi"], r["lo"])) < 8.001
