"""Instances matched in rounds against the plain loop over predictions."""

import random

from pyspark.sql import functions as F

from pointloom.operators import evaluate

PAIR = "scene_id int, class int, threshold double, pred_id long, instance long, score double, iou double"


def loop(rows):
    out = set()
    for key in {r[:3] for r in rows}:
        mine, taken = [r for r in rows if r[:3] == key], set()
        for score, pid in sorted({(-r[5], r[3]) for r in mine}):
            free = sorted((-r[6], r[4]) for r in mine if r[3] == pid and r[4] not in taken)
            if free:
                taken.add(free[0][1])
                out.add((*key, pid, free[0][1]))
    return out


def test_rounds_equal_the_loop(spark):
    rng, rows = random.Random(4), []
    for scene in range(4):
        for pid in range(40):
            score = rng.randint(0, 6) / 6  # many ties
            rows += [(scene, pid % 2, 0.25, pid, i, score, rng.randint(3, 9) / 10) for i in rng.sample(range(25), rng.randint(0, 6))]
    # a chain: every prediction wants what the one before it takes
    rows += [(9, 0, 0.5, p, p + k, 1.0, 0.9 - k / 10) for p in range(8) for k in (-1, 0) if p + k >= 0]
    got = evaluate.assign_instances(spark.createDataFrame(rows, PAIR).repartition(5)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {(r["scene_id"], r["class"], r["threshold"], r["pred_id"], r["instance"]) for r in got} == loop(rows)


def test_no_pairs(spark):
    assert evaluate.assign_instances(spark.createDataFrame([], PAIR)).collect() == []


def test_unmatched_predictions(spark):
    """A second prediction of one instance is false, one that is mostly void or too small doesn't count."""
    gt = spark.createDataFrame([(0, 1, 2, 10)], "scene_id int, instance long, class int, n long")
    pred = spark.createDataFrame([(0, 1, 2, 0.9, 10, 0.0), (0, 2, 2, 0.8, 9, 0.0), (0, 3, 2, 0.7, 9, 0.9), (0, 4, 2, 0.95, 1, 0.0)], "scene_id int, pred_id long, class int, score double, n long, void_share double")
    match = spark.createDataFrame([(0, 1, 1, 2, 0.6), (0, 2, 1, 2, 0.9)], "scene_id int, pred_id long, instance long, class int, iou double")
    ap = lambda m, **more: {r["threshold"]: r["ap"] for r in evaluate.instance_ap(m, pred, gt, (0.5, 0.8), **more).collect()}
    # at 0.5 the better score takes the instance, though the other overlaps more; at 0.8 only the second reaches it
    assert ap(match, min_region=2) == {0.5: 1.0, 0.8: 0.5}
    assert ap(match) == {0.5: 0.5, 0.8: 1 / 3}
    assert ap(match.withColumn("iou", F.lit(0.5))) == {0.5: 0.0, 0.8: 0.0}
