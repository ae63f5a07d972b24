"""Smallest oriented boxes: the convex hull by a tree of hulls, then every face tried as a side of the box."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ
from pointloom.functions.shared import saved

#: Corners that a hull may keep. Rounder hulls keep the farthest corners in so many directions.
CORNERS = 4096
#: Hulls that one task of the tree joins.
FAN = 16


def frame_of(p: np.ndarray, tol: float) -> tuple[np.ndarray, int]:
    """Axes of the points' spread, as rows, and how many of them they fill."""
    _, s, v = np.linalg.svd(p - p.mean(0), full_matrices=True) if len(p) < 3 else np.linalg.svd(np.linalg.qr(p - p.mean(0), mode="r"), full_matrices=True)
    return v, int((s > tol).sum())


def hull2(p: np.ndarray) -> np.ndarray:
    """Rows of the corners of a flat set, in order round it."""
    order = np.lexsort((p[:, 1], p[:, 0]))

    def chain(rows) -> list[int]:
        out: list[int] = []
        for k in rows:
            while len(out) > 1 and (p[out[-1], 0] - p[out[-2], 0]) * (p[k, 1] - p[out[-2], 1]) <= (p[out[-1], 1] - p[out[-2], 1]) * (p[k, 0] - p[out[-2], 0]):
                out.pop()
            out.append(k)
        return out[:-1]

    return np.array(chain(order) + chain(order[::-1]) or order[:1])


def hull3(p: np.ndarray, tol: float) -> np.ndarray:
    """Faces (rows of three points each, outward) of a solid set: the farthest point beyond a face joins the hull, the faces that
    it sees go, and new ones lead from their rim to it."""
    a = p[:, 0].argmin()
    b = ((p - p[a]) ** 2).sum(1).argmax()
    u = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
    c = (((p - p[a]) - np.outer((p - p[a]) @ u, u)) ** 2).sum(1).argmax()
    n = np.cross(p[b] - p[a], p[c] - p[a])
    d = np.abs((p - p[a]) @ n).argmax()
    middle = p[[a, b, c, d]].mean(0)

    def plane(face: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.cross(p[face[:, 1]] - p[face[:, 0]], p[face[:, 2]] - p[face[:, 0]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return m, (m * p[face[:, 0]]).sum(1)

    faces = np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]])
    m, at = plane(faces)
    inward = m @ middle > at
    faces[inward] = faces[inward][:, [0, 2, 1]]
    m, at = plane(faces)
    alive, out = np.ones(4, bool), np.arange(len(p))
    beyond = p @ m.T - at
    own, gap = beyond.argmax(1), beyond.max(1)
    while True:
        out, own, gap = out[gap > tol], own[gap > tol], gap[gap > tol]
        if not len(out):
            return faces[alive]
        top = out[gap.argmax()]
        seen = alive & (m @ p[top] - at > tol)
        edges = [e for f in faces[seen].tolist() for e in zip(f, f[1:] + f[:1])]
        both = set(edges)
        new = np.array([(x, y, top) for x, y in edges if (y, x) not in both])
        if not len(new):  # beyond by rounding only
            gap[out == top] = 0
            continue
        nm, nat = plane(new)
        # who waited for a face that goes lies beyond one of the new faces, or inside
        wait, first = seen[own], len(faces)
        faces, m, at, alive = np.vstack([faces, new]), np.vstack([m, nm]), np.append(at, nat), np.append(alive & ~seen, np.ones(len(new), bool))
        beyond = p[out[wait]] @ nm.T - nat
        own[wait], gap[wait] = first + beyond.argmax(1), beyond.max(1)


def directions(n: int) -> np.ndarray:
    """Unit vectors spread evenly over the sphere."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    return np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])


def hull(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, normals of the faces) of any set, solid or not."""
    p = np.unique(p, axis=0)
    tol = 1e-9 * max(float(np.ptp(p, axis=0).max()), 1e-300)
    axes, rank = frame_of(p, tol)
    if rank == 3:
        faces = hull3(p, tol)
        corners = p[np.unique(faces)]
        n = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
        n = n[(n**2).sum(1) > 0]
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        n = np.round(n * np.where(n[:, [2]] != 0, np.sign(n[:, [2]]), 1), 12)
    else:
        corners = p[hull2((p - p.mean(0)) @ axes[:2].T)] if rank == 2 else p[[((p - p[0]) @ axes[0]).argmin(), ((p - p[0]) @ axes[0]).argmax()]] if rank else p
        n = axes[[2]]
    if len(corners) > CORNERS:
        corners = corners[np.unique((corners @ directions(CORNERS).T).argmax(0))]
    return corners, np.unique(n, axis=0)


def box_on(normal: np.ndarray, p: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(volume, sum of edges, axes as rows) of the smallest box with a side of that normal: its base is the smallest rectangle
    round the shadow, which has an edge of the shadow's hull on one side."""
    w = normal / np.linalg.norm(normal)
    u = np.cross(w, np.eye(3)[np.abs(w).argmin()])
    u /= np.linalg.norm(u)
    v = np.cross(w, u)
    flat = p @ np.column_stack([u, v])
    rim = flat[hull2(flat)]
    edge = np.roll(rim, -1, axis=0) - rim
    edge = edge[(edge**2).sum(1) > 0] if len(rim) > 1 else np.eye(2)[:1]
    edge = edge / np.linalg.norm(edge, axis=1, keepdims=True)
    a, b = np.ptp(rim @ edge.T, axis=0), np.ptp(rim @ np.column_stack([-edge[:, 1], edge[:, 0]]).T, axis=0)
    high = float(np.ptp(p @ w))
    k = int(np.lexsort((a + b, a * b))[0])
    x = edge[k, 0] * u + edge[k, 1] * v
    return float(a[k] * b[k] * high), float(a[k] + b[k] + high), np.vstack([x, np.cross(w, x), w])


def scene_boxes(df: DataFrame) -> DataFrame:
    """(scene_id, axes, lo, hi): the smallest oriented box of each scene that has a face of the points' hull on one side and an
    edge of its shadow on another; axes holds three unit vectors, lo and hi the ends along them.

    Each task reduces its points to the corners of their hull, and so does each step of a tree over tasks. Faces are tried in
    lots by all tasks. The ends are measured over all points, so every point is inside even where a round hull was thinned to
    ``CORNERS``. Points with a null or a coordinate that isn't finite are left out, and scenes without others have no box.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in XYZ]
    d = df.select("scene_id", *(F.col(c).cast("double").alias(c) for c in XYZ)).where(finite[0] & finite[1] & finite[2])
    scene = d.schema["scene_id"].dataType.simpleString()

    def table(found: dict, part: int) -> pd.DataFrame:
        return pd.concat([pd.DataFrame(c, columns=list(XYZ)).assign(scene_id=s, part=part) for s, c in found.items()])[["scene_id", "part", *XYZ]]

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, part = {}, 0
        for t in batches:
            part = int(t["part"].iloc[0]) // FAN if len(t) else part
            for s, g in t.groupby("scene_id", sort=False):
                p = g[list(XYZ)].to_numpy()
                found[s] = hull(np.vstack([found[s], p]) if s in found else p)[0]
            if sum(map(len, found.values())) > 1_000_000:
                yield table(found, part)
                found = {}
        if found:
            yield table(found, part)

    def join_hulls(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return table({key[0]: hull(t[list(XYZ)].to_numpy())[0]}, int(key[1]) // FAN)

    def lots(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        corners, normals = hull(t[list(XYZ)].to_numpy())
        cut = [normals[k : k + 64].ravel() for k in range(0, len(normals), 64)]
        return pd.DataFrame({"scene_id": key[0], "normals": cut, "corners": [corners.ravel()] * len(cut)})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [(s, *min((box_on(w, c.reshape(-1, 3)) for w in n.reshape(-1, 3)), key=lambda b: b[:2])) for s, n, c in zip(t["scene_id"], t["normals"], t["corners"])]
            yield pd.DataFrame([(s, v, e, a.ravel()) for s, v, e, a in rows], columns=["scene_id", "volume", "edges", "axes"])

    rows = f"scene_id {scene}, part int, x double, y double, z double"
    at = saved(d.withColumn("part", F.spark_partition_id()).mapInPandas(reduce_task, rows), "hulls")
    while (at.agg(F.max("part")).first()[0] or 0) > 0:
        at = saved(at.groupBy("scene_id", "part").applyInPandas(join_hulls, rows), "hulls")
    tried = saved(at.groupBy("scene_id").applyInPandas(lots, f"scene_id {scene}, normals array<double>, corners array<double>"), "faces")
    boxes = tried.repartition(F.xxhash64("scene_id", "normals")).mapInPandas(best, f"scene_id {scene}, volume double, edges double, axes array<double>")
    axes = saved(boxes.groupBy("scene_id").agg(F.min_by("axes", F.struct("volume", "edges", "axes")).alias("axes")), "axes")
    ends = d.join(axes.hint("merge"), "scene_id").groupBy("scene_id", "axes")
    places = [along(k) for k in range(3)]
    return saved(ends.agg(F.array(*map(F.min, places)).alias("lo"), F.array(*map(F.max, places)).alias("hi")), "boxes")


def along(k: int, axes: str = "axes") -> Column:
    """A point's place on the k-th axis of its scene's box."""
    return sum((F.col(c) * F.col(axes)[3 * k + i] for i, c in enumerate(XYZ)), F.lit(0.0))


def crop_obb(df: DataFrame, ref: DataFrame, margin: float = 0.0) -> DataFrame:
    """Points inside the smallest oriented box of their scene's reference points (``scene_boxes``), widened by ``margin`` on every
    side. Points of scenes without reference points, and points without a place, are left out."""
    boxes = scene_boxes(ref).select("scene_id", F.struct("axes", "lo", "hi").alias("_box"))
    out = df.join(boxes.hint("merge"), "scene_id")
    for k in range(3):
        out = out.where(along(k, "_box.axes").between(F.col("_box.lo")[k] - margin, F.col("_box.hi")[k] + margin))
    return out.select(df.columns)
