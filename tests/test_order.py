"""Exact quantiles, places and singular values against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import linalg, order, windows

NAN = float("nan")


def values():
    rng = random.Random(6)
    out = {
        "spread": [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(4000)], "ties": [float(rng.randint(0, 3)) for _ in range(3000)], "same": [7.0] * 1500, "one": [1.5], "two": [1.0, 2.0],
        "holes": [rng.choice([None, rng.random()]) for _ in range(500)], "infinite": [math.inf, -math.inf, *(rng.random() for _ in range(99))], "empty": [None] * 5,
    }
    return [(k, v) for k, vs in out.items() for v in vs]


@pytest.mark.parametrize("enough,sent", [(100_000, 100_000), (10, 100_000), (10, 0)])
def test_quantiles(spark, enough, sent, monkeypatch):
    monkeypatch.setattr(order, "ENOUGH", enough)
    monkeypatch.setattr(order, "SENT", sent)
    rows = values()
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in rows], "k string, v double, t int, h string").repartition(5)
    shares = {"q0": 0.0, "q1": 0.001, "q50": 0.5, "q90": 0.9, "q99": 0.999, "q100": 1.0}
    got = {r["k"]: r for r in order.quantiles(df, ["k"], {n: ("v", p) for n, p in shares.items()}).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        mine = np.array(sorted(v for g, v in rows if g == k and v is not None))
        for n, p in shares.items():
            at = (len(mine) - 1) * p
            lo, hi = (mine[math.floor(at)], mine[math.ceil(at)]) if len(mine) else (None, None)
            want = lo if lo == hi else (1 - at + math.floor(at)) * lo + (at - math.floor(at)) * hi
            assert r[n] is None if want is None else r[n] == pytest.approx(want, rel=1e-12)


def test_quantiles_of_all(spark):
    df = spark.range(10_000).select((F.col("id") * 37 % 10_000).cast("double").alias("a"), F.when(F.col("id") < 9_990, 1.0).otherwise(NAN).alias("b"))
    r = order.quantiles(df, [], {"m": ("a", 0.5), "b": ("b", 0.5), "top": ("b", 1.0)}).collect()
    assert len(r) == 1 and r[0]["m"] == 4999.5 and r[0]["b"] == 1.0 and math.isnan(r[0]["top"])
    none = order.quantiles(df.limit(0), [], {"m": ("a", 0.5)}).collect()
    assert len(none) == 1 and none[0]["m"] is None
    assert order.quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], {"m": ("a", 0.5)}).collect() == []


@pytest.mark.parametrize("sent", [100_000, 0])
def test_places(spark, sent, monkeypatch):
    monkeypatch.setattr(order, "SENT", sent)
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b"]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    got = order.placed(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], ["v", "i"], "place").collect()
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {(*r, n) for n, r in enumerate(mine)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert order.placed(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "place").collect() == []


def test_one_scene_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select(F.lit(0).alias("scene_id"), F.col("id").alias("point_id"), *((F.rand(i) * 100).alias(c) for i, c in enumerate("xyz")))
    ranked = windows.serialize(df, 1.0).select("rank", "code", "point_id", F.col("point_id").alias("at"))
    rows = ranked.orderBy("rank").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in rows] == list(range(20_000)) and all((a["code"], a["point_id"]) < (b["code"], b["point_id"]) for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("low", [1e-9, 1e-12])
def test_small_singular_values_keep_digits(spark, low):
    rng = np.random.default_rng(0)
    want = np.geomspace(1, low, 8)
    u, v = np.linalg.qr(rng.normal(size=(3000, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    df = spark.createDataFrame([(r.tolist(), 1) for r in (u * want) @ v.T], "feat array<double>, k int").repartition(40)
    s, right = linalg.singular(df)
    assert s == pytest.approx(want, rel=1e-6 if low > 1e-10 else 2e-3)
    assert np.abs(right.T @ v) == pytest.approx(np.eye(8), abs=1e-5)
    assert linalg.svd_spectrum(df, 8).count() == 8 and linalg.singular(df.limit(0))[0].size == 0
    few, basis = linalg.singular(df.limit(3))
    assert few[3:] == pytest.approx(np.zeros(5)) and basis.T @ basis == pytest.approx(np.eye(8))


def test_weights_count_as_roots(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    df = spark.createDataFrame([(r.tolist(), float(i % 3)) for i, r in enumerate(x)], "feat array<double>, n double").repartition(20)
    r = linalg.triangle(df, weight="n", fan=2)
    assert r.T @ r == pytest.approx(x.T @ (x * (np.arange(50) % 3)[:, None])) and np.allclose(r, np.triu(r))


def test_fallback_only_where_too_few_stay(spark):
    """One scene keeps its box, the other falls back to its nearest points: the rule that the SQL states too."""
    from pointloom.operators.filters import filter_outliers

    df = spark.range(150).select("id", F.when(F.col("id") < 100, 0).otherwise(1).alias("scene_id"), F.col("id").alias("point_id"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    n = filter_outliers(df, 0.05, 0.95, 60).groupBy("scene_id").agg(F.count_if("kept").alias("n")).collect()
    assert {r.scene_id: r.n for r in n} == {0: 90, 1: 50}
    from pointloom.plans import catalog

    assert "< 50000" in catalog.ORACLES["c2_filter_outliers_fallback"] and "inside" in catalog.ORACLES["c2_filter_outliers_fallback"]
