"""Array and vertex files read by many tasks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import readers


@pytest.mark.parametrize("task_bytes", [64, 1000, 1 << 20])
def test_arrays_by_ranges(spark, tmp_path, task_bytes):
    rng = np.random.default_rng(task_bytes)
    want = {}
    for scene, n in (("one", 700), ("two", 1), ("none", 0)):
        (tmp_path / "train" / scene).mkdir(parents=True)
        coord, turned = rng.normal(size=(n, 3)), np.asfortranarray(rng.normal(size=(n, 2, 3)).astype("f4"))
        label = rng.integers(0, 9, max(0, n - 5)).astype("i2")  # shorter than the first
        np.save(tmp_path / "train" / scene / "coord.npy", coord)
        np.save(tmp_path / "train" / scene / "turned.npy", turned)
        (tmp_path / "train" / scene / "broken.npy").write_bytes(b"never opened")
        if scene != "two":
            np.save(tmp_path / "train" / scene / "label.npy", label)
        for i in range(n):
            want[scene, i] = (coord[i].tolist(), turned[i].ravel().tolist(), [float(label[i])] if scene != "two" and i < len(label) else None)
    d = readers.ingest_arrays(spark, str(tmp_path), ["coord", "turned", "label"], task_bytes)
    got = d.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.scene, r.row): (r.coord, r.turned, r.label) for r in got} == want and len(got) == len(want)
    assert task_bytes > 1000 or len({r.task for r in got}) > 5


@pytest.mark.parametrize("task_bytes", [50, 997, 1 << 20])
def test_vertices_by_ranges(spark, tmp_path, task_bytes):
    rng = np.random.default_rng(task_bytes)
    want = {}
    for name, kind, sign, n in (("a.ply", "binary_little_endian", "<", 400), ("b.ply", "binary_big_endian", ">", 33), ("c.ply", "ascii", "", 20), ("d.ply", "binary_little_endian", "<", 0)):
        v = [(int(k), *map(float, x)) for k, x in zip(rng.integers(0, 200, n), rng.normal(size=(n, 2)))]
        head = f"ply\nformat {kind} 1.0\nelement camera 2\nproperty uchar f\nelement vertex {n}\nproperty uint8 k\nproperty double x\nproperty double y\nelement face 1\nproperty list uchar int i\nend_header\n"
        if sign:
            body = b"\n\n" + b"".join(struct.pack(f"{sign}Bdd", *r) for r in v) + b"\x01\0\0\0\0"
        else:
            body = "".join(" ".join(map(repr, r)) + "\n" for r in [(1,), (2,), *v, (1, 0)]).encode()
        (tmp_path / name).write_bytes(head.encode() + body)
        want |= {(name, i): (float(k), y, None) for i, (k, _, y) in enumerate(v)}
    d = readers.ingest_ply(spark, str(tmp_path), ["k", "y", "z"], task_bytes)
    got = d.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.file, r.row): (r.k, r.y, r.z) for r in got} == want and len(got) == len(want)
    assert task_bytes > 1000 or len({r.task for r in got}) > 5


def test_short_files_are_errors(spark, tmp_path):
    (tmp_path / "s").mkdir()
    np.save(tmp_path / "s" / "coord.npy", np.zeros((100, 3)))
    whole = (tmp_path / "s" / "coord.npy").read_bytes()
    (tmp_path / "s" / "coord.npy").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends before its last row"):
        readers.ingest_arrays(spark, str(tmp_path), ["coord"], 300).collect()
