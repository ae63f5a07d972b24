"""Covers by crops, in lots, against the crops taken one after the other."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from pointloom.operators import covers, sampling


def one_by_one(ids: list, place: np.ndarray, n: int) -> list:
    """Crops (sets of ids) in order."""
    o = [hashlib.md5(f"0|{i}".encode()).hexdigest() for i in ids]
    order = sorted(range(len(ids)), key=lambda k: o[k])
    held, out = set(), []
    for k in order:
        if ids[k] not in held:
            d2 = ((place - place[k]) ** 2).sum(1)
            crop = sorted(range(len(ids)), key=lambda j: (d2[j], o[j] < o[k], o[j]))[:n]
            out.append({ids[j] for j in crop})
            held |= out[-1]
    return out


@pytest.mark.parametrize("lot", [256, 6])
def test_lots_equal_one_by_one(spark, lot):
    rng = np.random.default_rng(8)
    scenes = {
        0: rng.integers(0, 12, (500, 3)).astype(float),  # many ties
        1: np.vstack([np.zeros((150, 3)), rng.normal(size=(100, 3)) * 30]),  # a heap in one place
        2: rng.uniform(0, 5, (20, 3)),  # fewer than a crop
        3: np.column_stack([rng.uniform(0, 100, 300), np.zeros(300), np.zeros(300)]),
    }
    rows = [(s, s * 1000 + k, *map(float, q)) for s, p in scenes.items() for k, q in enumerate(p)]
    df = spark.createDataFrame(rows, "scene_id int, point_id long, x double, y double, z double").repartition(4)
    df = df.unionByName(spark.createDataFrame([(0, 77, None, 1.0, 1.0), (3, 78, float("nan"), 0.0, 0.0), (5, 79, 0.0, float("inf"), 0.0)], df.schema))
    got: dict = {}
    for r in sampling.sphere_cover(df, 40, lot).collect():
        got.setdefault((r["scene_id"], r["crop"]), []).append(r["point_id"])
    want = {(s, k): c for s, p in scenes.items() for k, c in enumerate(one_by_one([s * 1000 + k for k in range(len(p))], p, 40))}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_points(spark):
    assert sampling.sphere_cover(spark.createDataFrame([], "scene_id int, point_id long, x double, y double, z double"), 5).collect() == []


def test_rounds_do_not_grow_with_the_number_of_crops(spark, monkeypatch):
    place = np.random.default_rng(3).uniform(0, 1, (1200, 3)) * [9, 9, 0.1]
    df = spark.createDataFrame([(0, k, *map(float, q)) for k, q in enumerate(place)], "scene_id int, point_id long, x double, y double, z double")
    rounds, saved = [], covers.saved
    monkeypatch.setattr(covers, "saved", lambda d, name: (rounds.append(name), saved(d, name))[1])
    got: dict = {}
    for r in sampling.sphere_cover(df, 4, 16).collect():
        got.setdefault(r["crop"], set()).add(r["point_id"])
    want = one_by_one(list(range(1200)), place, 4)
    assert [got[k] for k in sorted(got)] == want
    assert len(want) > 400 and rounds.count("left") <= 15  # 25 and more by lots of 16 in a scene


def test_what_may_be_held_waits():
    def given(rows):
        return pa.table({"scene_id": [0] * len(rows), "o": [r[0] for r in rows], "late": [r[1] for r in rows], "holds": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    assert covers.accepted(given([(1, False, [2, 5]), (2, False, [3]), (3, False, [])]))["o"].to_pylist() == [1, 3]
    # 2 is late, so 3 may be held by it, and 4 by 3
    assert covers.accepted(given([(4, False, []), (2, True, [3]), (1, False, [9]), (3, False, [4])]))["o"].to_pylist() == [1]


def test_later_centres_do_not_free_from_turns():
    points = pa.table({"o": [1, 5, 6], "x": [0.0, 0.1, 0.2], "y": [0.0] * 3, "z": [0.0] * 3})
    centres = pa.table({"o": [5], "x": [0.1], "y": [0.0], "z": [0.0], "far": [1.0], "last": [9], "width": [1.0]})
    assert covers.free(["o"])(centres, points)["o"].to_pylist() == [1]
