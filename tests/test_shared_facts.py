"""Facts of scenes, classes and segments that go to the rows instead of the rows to them, and views' vectors in blocks."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions import columns
from pointloom.operators import aggregate, relate, sampling, sets, spatial


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_bring_three_groups(spark):
    p = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(0, 1)], "point_id long, segment_id int")
    g = spark.createDataFrame([(o, 100 + o, (o * 7) % 11, [0, 1] if o % 3 else [1]) for o in range(1, 40)], "group_order int, label int, size int, segments array<int>")
    d = relate.multi_label(p, g)
    lists = {0: [o for o in range(1, 40) if o % 3], 1: list(range(1, 40))}

    def want(segments):
        first = sorted(o for s in segments for o in lists[s][:3])[:3]
        least = min(range(3), key=lambda i: ((first[i] * 7) % 11, i))
        first[0], first[least] = first[least], first[0]
        return sorted(100 + o for o in first), 100 + first[0]

    for r in d.collect():
        assert (sorted(r.labels), r.labels[0]) == want([r.point_id % 2] + ([1] if r.point_id == 0 else []))
    assert plan(d).count("WindowGroupLimit") == 2 or plan(d).count("Window ") == 2


def test_classes_are_joined_once_each(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "segment int")
    b = spark.createDataFrame([(1,), (None,), (3,)], "segment int")
    assert sorted(map(str, (r[0] for r in sets.common_classes(a, b).collect()))) == ["1", "None"]
    assert [r[0] for r in sets.missing_classes(a, b).collect()] == [2]
    for d in (sets.common_classes(a, b), sets.missing_classes(a, b)):
        text = plan(d)
        assert text.count("Aggregate") >= 2 and "Aggregate" in text[text.index("Join") :]


def test_scene_facts_without_a_window(spark):
    rows = [(i, None if i % 4 == 3 else i % 4, i * 0.7 - 5, -i * 0.3, float(i % 5), float(i), 2.0 * i, 30.0) for i in range(40)]
    df = spark.createDataFrame(rows, "point_id long, scene_id int, x double, y double, z double, r double, g double, b double")
    for mode in ("lattice", "origin"):
        d = columns.voxel_coord(df, 2.0, mode)
        assert "Window" not in plan(d) and d.columns == [*df.columns, "cx", "cy", "cz"]
        got = {r.point_id: (r.cx, r.cy, r.cz) for r in d.collect()}
        for p in rows:
            own = [q for q in rows if q[1] == p[1]]
            low = [min(q[k] for q in own) for k in (2, 3, 4)]
            want = [np.floor(v / 2) - np.floor(m / 2) if mode == "lattice" else np.floor((v - m) / 2) for v, m in zip(p[2:5], low)]
            assert list(got[p[0]]) == want
    d = columns.color_adjust(df, contrast=0.5)
    assert "Window" not in plan(d)
    luma = lambda p: 0.2989 * p[5] + 0.587 * p[6] + 0.114 * p[7]
    for r in d.collect():
        assert abs(r.b - (15 + np.mean([luma(q) for q in rows if q[1] == r.scene_id]) / 2)) < 1e-6


def test_chunk_pairs_by_windows_alone(spark):
    rng = np.random.default_rng(4)
    xy = lambda n: [(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 30, (n, 2)))]
    p, q = spark.createDataFrame(xy(400), "point_id long, scene_id int, x double, y double"), spark.createDataFrame(xy(80), "ref_id long, scene_id int, x double, y double")
    whole = sampling.chunk_pair(sampling.chunk(p, 12.0, 6.0, 20, 5), p, q, 12.0, 6.0)
    d = sampling.chunk_pair(sampling.full_windows(p, 12.0, 6.0, 20, 5), p, q, 12.0, 6.0)
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, whole.collect())) != []
    assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_views_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 7)
    monkeypatch.setattr(spatial, "LAID", 5)
    rng = np.random.default_rng(5)
    f = {v: rng.normal(size=3) for v in range(6)}
    seen = [(int(a), int(b), int(a) % 3, float(w)) for a, b, w in zip(rng.integers(0, 30, 200), rng.integers(0, 8, 200), rng.uniform(0, 1, 200))]
    seen += [(99, 7, 0, 1.0), (98, 1, 0, 0.0), (97, None, 0, 1.0)]
    obs = spark.createDataFrame(seen, "point long, view int, class int, weight double")
    feats = spark.createDataFrame([(v, x.tolist()) for v, x in f.items()], "view int, feat array<double>")
    total = {}
    for p, v, _, w in seen:
        if v in f:
            total[p] = total.get(p, 0) + w * f[v]
    lifted = aggregate.lift_features(obs, feats)
    got = {(r.point, r.pos): r.v for r in lifted.collect()}
    unit = {p: s / np.sqrt(s @ s) if s.any() else s for p, s in total.items()}
    assert got.keys() == {(p, k) for p in unit for k in range(3)} and all(abs(v - unit[p][k]) < 1e-9 for (p, k), v in got.items())
    assert "Exchange" not in lifted._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    texts = {k: rng.normal(size=3) for k in (4, 2, 9)}
    share = lambda a, b: max(1 / (1 + np.exp(-(a @ b) / np.sqrt((a @ a) * (b @ b)))) - 0.5, 0.0)
    votes = {}
    for p, v, _, w in seen:
        if v in f:
            for k, t in texts.items():
                votes[p, k] = votes.get((p, k), 0) + w * share(f[v], t)
    d = aggregate.vote_labels_similarity(obs, feats, spark.createDataFrame([(k, t.tolist()) for k, t in texts.items()], "label int, feat array<double>"))
    best = {p: max((votes[p, k], -k) for k in texts) for p in total}
    got = {r.point: (r.label, r.votes) for r in d.collect()}
    assert got.keys() == best.keys() and all(k == -best[p][1] and abs(w - best[p][0]) < 1e-9 for p, (k, w) in got.items())


def test_interpolation_by_code(spark):
    src = [(i, 0, float(i), 0.0, 0.0, i % 3) for i in range(9)]
    s = spark.createDataFrame(src, "ref_id long, scene_id int, x double, y double, z double, fid long")
    q = spark.createDataFrame([(1, 0, 0.2, 0.0, 0.0), (2, 0, 4.0, 0.0, 0.0), (3, 5, 0.0, 0.0, 0.0)], "point_id long, scene_id int, x double, y double, z double")
    f = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, 8.0])], "fid long, feat array<double>")
    d = spatial.interpolate(s, q, f, 2)
    w = 1 / (np.array([0.2, 0.8]) + 1e-8)
    got = {(r.qid, r.pos): round(r.v, 6) for r in d.collect()}
    v = w @ np.array([[1, 2], [4, 8]]) / w.sum()
    assert got == {(1, 0): round(v[0], 6), (1, 1): round(v[1], 6), (2, 0): round(4.0, 6), (2, 1): round(8.0, 6)}
    assert "Aggregate" not in plan(d).split("FlatMapCoGroupsInArrow")[0]
