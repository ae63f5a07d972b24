"""What SQL can't express: round trips, invariants, ingest, edge cases."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators.cellgraph import cluster_components
from pointloom.functions import curves
from pointloom.operators import aggregate, evaluate, linalg, sampling, spatial
from pointloom.plans.fixtures import Tables
from pointloom.plans.q_linalg import pairs
from pointloom.sources import readers
from pointloom.streaming import running

POINT = "scene_id int, point_id long, x double, y double, z double, segment int, valid boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, POINT)


def test_hilbert_round_trip_and_steps():
    g = np.arange(16)
    x, y, z = (a.ravel() for a in np.meshgrid(g, g, g, indexing="ij"))
    code = curves.encode(x, y, z, 4)
    assert sorted(code) == list(range(4096)) and all((a == b).all() for a, b in zip(curves.decode(code, 4), (x, y, z)))
    at = np.argsort(code)
    steps = abs(np.diff(x[at])) + abs(np.diff(y[at])) + abs(np.diff(z[at]))
    assert (steps == 1).all()  # neighbours on the curve are neighbours in space


def test_edge_tables(spark):
    one = frame(spark, [(0, 1, 1.0, 1.0, 1.0, -1, False)])
    empty = one.limit(0)
    for df, n in ((empty, 0), (one, 1)):
        assert sampling.voxel_sample(df, 1.0, "valid").count() == n
        assert sampling.sample_cells(df, 1.0, 1.0, 1.0).count() == n
        assert sampling.voxel_fragments(df, 1.0).count() == n
        assert spatial.knn(df, df, 3, "point_id", "point_id").count() == n
        assert spatial.radius_pairs(df, 1.0).count() == 0
        assert aggregate.majority_label(df, ["scene_id"]).count() == n
        assert aggregate.grid_stats(df, 1.0).count() == n
        assert sampling.chunk(df, 1.0, 0.5, 1, 5).count() >= 0
    assert aggregate.majority_label(one, ["scene_id"]).first().label == -1
    assert evaluate.seg_metrics(evaluate.confusion(one.withColumn("pred", F.lit(0)))).count() == 0


def test_knn_is_exact_on_uneven_clouds(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 0.01, (200, 3)), rng.uniform(-50, 50, (60, 3)), np.zeros((5, 3))])
    df = frame(spark, [(i % 2, i, *map(float, v), 0, True) for i, v in enumerate(p)])
    got = {}
    for r in spatial.knn(df, df, 4, "point_id", "point_id", not_self=True).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.rid
    for i in range(len(p)):
        others = [j for j in range(len(p)) if j != i and j % 2 == i % 2]
        d = ((p[others, 0] - p[i, 0]) ** 2 + (p[others, 1] - p[i, 1]) ** 2) + (p[others, 2] - p[i, 2]) ** 2
        want = [others[k] for k in np.lexsort((others, d))[:4]]
        mine = [got[i][k] for k in range(1, 5)]
        assert np.allclose([((p[a] - p[i]) ** 2).sum() for a in mine], [((p[a] - p[i]) ** 2).sum() for a in want])


def test_components_are_constant_on_edges(spark):
    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    p = t.points.dropDuplicates(["point_id"])
    comp = {r.point_id: r.component for r in cluster_components(p, 2.0, 1).collect()}
    lab = {r.point_id: r.segment for r in p.collect()}
    edges = [(r.a, r.b) for r in spatial.radius_pairs(p, 2.0).collect() if lab[r.a] == lab[r.b] >= 0]
    assert edges and all(comp[a] == comp[b] for a, b in edges)
    parent = {i: i for i in comp}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert comp == {i: top(i) for i in comp}


def test_farthest_sample(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 1, (60, 3))
    df = frame(spark, [(0, i, *map(float, v), 0, True) for i, v in enumerate(p)])
    got = [r.point_id for r in sampling.farthest_sample(df, 6).orderBy("step").collect()]
    want, d = [0], ((p - p[0]) ** 2).sum(1)
    while len(want) < 6:
        want.append(int(d.argmax()))
        d = np.minimum(d, ((p - p[want[-1]]) ** 2).sum(1))
    assert got == want


@pytest.mark.parametrize("keep", [1, 40, 4096])
def test_many_farthest_points(spark, keep):
    rng = np.random.default_rng(3)
    p = np.vstack([np.round(rng.uniform(0, 9, (700, 3))), rng.normal(50, 0.1, (300, 3))])
    df = frame(spark, [(0, 10_000 - i, *map(float, v), 0, True) for i, v in enumerate(p)] + [(1, i, float(i), 0.0, 0.0, 0, True) for i in range(3)])
    m = {1: 4, 40: 30, 4096: 400}[keep]
    got = sampling.farthest_sample(df, m, keep).orderBy("scene_id", "step").collect()
    ids, want, d = 10_000 - np.arange(1000), [999], None
    while len(want) < m:
        gap = p - p[want[-1]]
        gap = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
        d = gap if d is None else np.minimum(d, gap)
        equal = np.flatnonzero(d == d.max())
        want.append(int(equal[ids[equal].argmin()]))
    assert [r.point_id for r in got if r.scene_id == 0] == ids[want].tolist()
    assert [r.point_id for r in got if r.scene_id == 1] == [0, 2, 1, *[0] * (m - 3)]
    assert sampling.farthest_sample(df.limit(0), 5).collect() == []


def test_sphere_cover_and_fragments_hold_every_point(spark):
    p = Tables(spark, "/root/testdata/sf0.001").points.dropDuplicates(["point_id"])
    assert sampling.sphere_cover(p, 200).select("point_id").distinct().count() == p.count()
    assert sampling.voxel_fragments(p, 4.0).select("point_id").distinct().count() == p.count()
    drawn = sampling.sample_weighted(p, "x", 500).agg(F.sum("times")).first()[0]
    assert 495 <= drawn <= 500


def matrices(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 12))
    return x, spark.createDataFrame([(i, i % 5, [float(a) for a in v]) for i, v in enumerate(x)], "point_id long, segment int, feat array<double>")


def test_procrustes_recovers_a_rotation(spark):
    x, df = matrices(spark)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(12, 12)))
    q[:, 0] *= np.sign(np.linalg.det(q))
    df = df.withColumn("segment", F.col("point_id").cast("int"))
    turned = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x @ q)], "label int, feat array<double>")
    r = linalg.procrustes(df, turned)
    assert np.allclose(r, q, atol=1e-8) and np.isclose(np.linalg.det(r), 1)


def test_svd_projection_and_subspaces(spark):
    x, df = matrices(spark)
    scores, v, errors = linalg.grid_svd(df.withColumn("n", F.lit(1)), (2, 6, 12))
    e = [r.error for r in errors.orderBy("rank").collect()]
    assert e[0] > e[1] > e[2] and e[2] < 1e-6 and np.allclose(v.T @ v, np.eye(12)) and scores.count() == 300
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([r.s for r in linalg.svd_spectrum(df, 12).orderBy("k").collect()], s)
    w = np.random.default_rng(3).normal(size=(12, 3))
    both = spark.createDataFrame([([float(a) for a in p], [float(a) for a in p @ w + 1]) for p in x], "x array<double>, y array<double>")
    m, b = linalg.fit_projection_ridge(both, 1e-9)
    assert np.allclose(m, w, atol=1e-6) and np.allclose(b, 1, atol=1e-6)
    same = linalg.compare_subspaces(linalg.scene_bases(df.withColumn("scene_id", F.lit(0)).unionByName(df.withColumn("scene_id", F.lit(1))), 3), 3).first()
    assert same.mean_angle < 1e-6 and same.similarity == pytest.approx(1)


def test_robust_pca_splits(spark):
    rng = np.random.default_rng(42)
    low = rng.normal(size=(100, 5)) @ rng.normal(size=(5, 50))
    sparse = np.where(rng.uniform(size=(100, 50)) < 0.05, rng.uniform(-5, 5, (100, 50)), 0)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(low + sparse)], "point_id long, feat array<double>")
    got = linalg.robust_pca(df, 40, 1e-7).orderBy("point_id").collect()
    assert np.abs(np.array([r.low for r in got]) - low).max() < 0.2 * np.abs(low).max()
    assert np.allclose(np.array([r.low for r in got]) + np.array([r.sparse for r in got]), low + sparse, atol=1e-3)


def test_codebook_error_falls(spark):
    _, df = matrices(spark)
    err = [linalg.encode_codebook(df, linalg.codebook(df, 6, n)).agg(F.avg("error")).first()[0] for n in (0, 4)]
    assert err[1] < err[0]
    assert linalg.codebook(df, 3, 2, "l1").count() == 3 and linalg.codebook_two_level(df, 3, 2, 2).count() == 300


def test_nearest_codes(spark):
    x = np.random.default_rng(3).integers(0, 3, (500, 4)) / 2.0
    df = spark.createDataFrame([*((i, v.tolist(), 7) for i, v in enumerate(x)), (-1, None, 7)], "point_id long, feat array<double>, code int")
    centres = spark.createDataFrame([(9 - k, x[k].tolist()) for k in range(6)], "code int, feat array<double>")
    order = x[5::-1]  # by code, so that the first of equals has the lowest
    for metric, far in (("l2", lambda g: (g * g).sum(2)), ("l1", lambda g: np.abs(g).sum(2))):
        d = far(x[:, None] - order)
        want = {i: (int(4 + k), e) for i, (k, e) in enumerate(zip(d.argmin(1), d.min(1)))} | {-1: (None, None)}
        assert {r.point_id: (r.code, r.error) for r in linalg.encode_codebook(df, centres, metric).collect()} == want
    assert {r.code for r in linalg.encode_codebook(df, centres.limit(0)).collect()} == {None}


def test_perfect_instances_have_full_precision(spark):
    gt = spark.createDataFrame([(0, 1, 2, 10), (0, 2, 2, 5), (0, 3, 4, 7)], "scene_id int, instance long, class int, n long")
    pr = spark.createDataFrame([(0, 11, 2, 0.9, 10, 0.0), (0, 12, 2, 0.8, 5, 0.0), (0, 13, 4, 0.7, 7, 0.0)], "scene_id int, pred_id long, class int, score double, n long, void_share double")
    m = spark.createDataFrame([(0, 11, 1, 2, 1.0), (0, 12, 2, 2, 1.0), (0, 13, 3, 4, 1.0)], "scene_id int, pred_id long, instance long, class int, iou double")
    assert all(r.ap == pytest.approx(1) for r in evaluate.instance_ap(m, pr, gt).collect())
    assert {r.ap for r in evaluate.instance_ap(m.limit(0), pr, gt).collect()} == {0.0}


def test_ingest(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(4, 3)
    for s in ("s1", "s2"):
        (tmp_path / "arr" / s).mkdir(parents=True)
        np.save(tmp_path / "arr" / s / "coord.npy", a)
        np.save(tmp_path / "arr" / s / "segment.npy", np.array([1, 2, 3, 4]))
    rows = readers.ingest_arrays(spark, str(tmp_path / "arr"), ["coord", "segment"]).orderBy("scene", "row").collect()
    assert len(rows) == 8 and rows[5].coord == [3.0, 4.0, 5.0] and rows[5].segment == [2.0]
    (tmp_path / "ply").mkdir()
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "ply" / "a.ply").write_bytes(head.encode() + struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    (tmp_path / "ply" / "b.ply").write_text(head.replace("binary_little_endian", "ascii").replace("vertex 2", "vertex 1") + "7 8 9\n")
    got = {(r.file, r.row): (r.x, r.y, r.z) for r in readers.ingest_ply(spark, str(tmp_path / "ply")).collect()}
    assert got == {("a.ply", 0): (1, 2, 3), ("a.ply", 1): (4, 5, 6), ("b.ply", 0): (7, 8, 9)}
    cam = tmp_path / "cam"
    cam.mkdir()
    (cam / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 500 320 240\n")
    (cam / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 0 1 a.png\n1.0 2.0 7\n")
    (cam / "points3D.txt").write_text("7 1 2 3 9 9 9 0.1 1 0 2 5\n")
    c, i, o = readers.ingest_camera_text(spark, str(cam))
    assert c.first().params == [500, 500, 320, 240] and i.first().name == "a.png" and sorted((r.image, r.point) for r in o.collect()) == [(1, 0), (2, 5)]
    (tmp_path / "f.json").write_text(json.dumps({"fl_x": 5.0, "frames": [{"file_path": "a", "transform_matrix": [[1, 0], [0, 1]]}, {"file_path": "b", "fl_x": 6.0, "transform_matrix": [[2, 0], [0, 2]]}]}))
    assert sorted((r.file_path, r.focal, r.matrix[0]) for r in readers.ingest_frames_json(spark, str(tmp_path / "f.json")).collect()) == [("a", 5.0, 1.0), ("b", 6.0, 2.0)]
    (tmp_path / "t.traj").write_text("0.5 0 0 1.5707963267948966 1 2 3\n")
    r = readers.ingest_trajectory(spark, str(tmp_path / "t.traj")).first()
    assert np.allclose(np.array(r.rotation).reshape(3, 3), [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], atol=1e-9) and np.allclose([r.px, r.py, r.pz], [-2, 1, -3])
    (tmp_path / "ann" / "room").mkdir(parents=True)
    (tmp_path / "ann" / "room" / "chair_1.txt").write_text("1 2 3 4 5 6\n")
    (tmp_path / "ann" / "room" / "odd_1.txt").write_text("1 2 3 4 5 6\n1 2 3 4 5 6\n")
    got = sorted((r.segment, r.instance) for r in readers.ingest_annotations(spark, str(tmp_path / "ann"), {"chair": 8}).collect())
    assert got == [(-1, 1), (-1, 1), (8, 0)]
    inv = {(r.split, r.attr, r["rank"]): r.files for r in readers.asset_inventory(spark, str(tmp_path / "arr")).collect()}
    assert inv[(None, None, None)] == 4 and inv[("arr", "coord", None)] == 2


def test_sinks(spark, tmp_path):
    p = Tables(spark, "/root/testdata/sf0.001").points.dropDuplicates(["point_id"])
    c = sampling.chunk(p, 20.0, 10.0, 10, 4)
    out = readers.write_chunks(c, str(tmp_path), 20.0, 10.0, 2.0, "train")
    assert out.endswith("train_grid2.0_chunk20.0x20.0_stride10.0x10.0") and spark.read.parquet(out).count() == c.count()
    classes = spark.createDataFrame([(k, k * 10) for k in range(5)], "class int, id int")
    readers.write_predictions(p.select("scene_id", "point_id", "pred", F.array("pred").alias("topk")), classes, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("pred > 40 or pred < -1").count() == 0


def test_gram_state_counts_no_batch_twice(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    d = pairs(t)
    add = running.stream_gram(str(tmp_path / "g"))
    add(d.where("point_id % 2 = 0"), 0)
    add(d.where("point_id % 2 = 0"), 0)
    add(d.where("point_id % 2 = 1"), 1)
    xx, xy, n = running.gram_state(spark, str(tmp_path / "g"))
    assert n == d.count() and np.allclose(xx, linalg.cross_sums(d, "x")[0]) and xy.shape == (64, 8)
