"""Comparisons of all pairs against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import linalg, pairs


@pytest.mark.parametrize("rows", [1, 3, 64])
def test_subspaces(spark, monkeypatch, rows):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(rows)
    bases = {k: (np.linalg.qr(rng.normal(size=(12, 3)))[0], np.sort(rng.random(3))[::-1] + 0.1) for k in range(9)}
    df = spark.createDataFrame([(k, v.ravel().tolist(), s.tolist()) for k, (v, s) in bases.items()] + [(None, [0.0] * 36, [1.0] * 3)], "scene_id int, basis array<double>, s array<double>")
    got = {(r.a, r.b): r for r in linalg.compare_subspaces(df, 3).collect()}
    assert sorted(got) == [(a, b) for a in range(9) for b in range(a + 1, 9)]
    for (a, b), r in got.items():
        (va, sa), (vb, sb) = bases[a], bases[b]
        c = np.linalg.svd(va.T @ vb, compute_uv=False).clip(0, 1)
        p, q = sa / sa.sum(), sb / sb.sum()
        want = [np.arccos(c).mean(), np.linalg.norm(np.arccos(c)), (c * c).mean(), (p * np.log(p / q)).sum(), np.abs(np.cumsum(p) - np.cumsum(q)).sum(), np.abs((va * vb).sum(0)).mean(), np.corrcoef(p, q)[0, 1]]
        assert np.allclose([r.mean_angle, r.grassmann, r.similarity, r.kl, r.emd, r.stability, r.correlation], want, atol=1e-7)


@pytest.mark.parametrize("rows", [1, 64])
def test_gaussian_classes(spark, monkeypatch, rows):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(0)
    label = rng.integers(-1, 5, 400)
    label[:3] = 7  # too few rows
    x = rng.normal(size=(400, 4)) * (1 + label % 3)[:, None] + label[:, None] * 0.3 + 1000
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x)] + [(1, None)], "segment int, feat array<double>")
    form = {k: (x[label == k].mean(0), np.cov(x[label == k], rowvar=False)) for k in range(5)}
    got = {(r.a, r.b): r.jm for r in linalg.jm_gaussian(df).collect()}
    assert sorted(got) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    for (a, b), jm in got.items():
        (m, c), (n, d) = form[a], form[b]
        e = (c + d) / 2
        dist = (m - n) @ np.linalg.inv(e) @ (m - n) / 8 + 0.5 * np.log(np.linalg.det(e) / np.sqrt(np.linalg.det(c) * np.linalg.det(d)))
        assert jm == pytest.approx(np.sqrt(2 * (1 - np.exp(-dist))), abs=1e-6)
    assert linalg.jm_gaussian(df.where(F.col("segment") == 7)).count() == 0
