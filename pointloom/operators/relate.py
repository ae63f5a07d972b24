"""Joins by key, time, view and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ, project


def expand_grid(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Features of cells given back to their points: an equi-join on (scene_id, grid_id)."""
    return points.join(grid, ["scene_id", "grid_id"])


def asof_nearest(frames: DataFrame, poses: DataFrame, limit: float, key: str = "device", frame: str = "frame_id", pose: str = "pose_id") -> DataFrame:
    """(frame, pose, gap): the pose nearest in time for each frame, the later one on a tie, if closer than ``limit`` seconds,
    else null. Both streams are merged and each frame looks at the last pose before and the first after; no range join."""
    t = lambda d: F.unix_micros(d["ts"].cast("timestamp"))
    u = frames.select(key, F.col(frame).alias("frame"), F.lit(None).cast("long").alias("pose"), t(frames).alias("t")).unionByName(poses.select(key, F.lit(None).cast("long").alias("frame"), F.col(pose).alias("pose"), t(poses).alias("t")))
    mark = F.when(F.col("pose").isNotNull(), F.struct("t", "pose"))
    back = Window.partitionBy(key).orderBy("t", F.col("pose").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("t", F.col("pose").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    d = u.withColumns({"_p": F.last(mark, ignorenulls=True).over(back), "_n": F.first(mark, ignorenulls=True).over(ahead)}).where("frame is not null")
    gap_p, gap_n = F.col("t") - F.col("_p.t"), F.col("_n.t") - F.col("t")
    later = F.coalesce(gap_n <= gap_p, F.col("_n").isNotNull())
    d = d.select("frame", F.when(later, F.col("_n.pose")).otherwise(F.col("_p.pose")).alias("pose"), (F.when(later, gap_n).otherwise(gap_p) / 1e6).alias("gap"))
    ok = F.col("gap") < limit
    return d.select("frame", F.when(ok, F.col("pose")).alias("pose"), F.when(ok, F.col("gap")).alias("gap"))


def visible(points: DataFrame, frames: DataFrame, on: Column, near: float = 0.01, far: float = 1e10) -> DataFrame:
    """(point_id, frame, depth, u, v) of the points that frames see. ``on`` ties frames to scenes by equality."""
    return project(points.join(frames, on), near=near, far=far).where("seen").select("point_id", "frame", "depth", "u", "v")


def observations(images: DataFrame, points: DataFrame) -> DataFrame:
    """Image keypoints with their 3-D point: images (image, track, u, v), points (track, x, y, z)."""
    return images.where("track >= 0").join(points, "track")


def label_segments(points: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(segment_id, group_order, label): class of each segment by the last group that lists it. groups: group_order, class,
    segments (array); classes: class, label."""
    g = groups.select("group_order", "class", F.explode("segments").alias("segment_id"))
    last = g.groupBy("segment_id").agg(F.max("group_order").alias("group_order"), F.max_by("class", "group_order").alias("class"))
    return points.join(last.hint("merge"), "segment_id", "left").join(classes, "class", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def multi_label(points: DataFrame, groups: DataFrame) -> DataFrame:
    """(point_id, labels): up to three groups of a point in order of the groups, that of the smallest group first, filled up
    with -1. groups: group_order, label, size, segments. A segment brings its first three groups, as no point takes more."""
    g = groups.select("group_order", "label", "size", F.explode("segments").alias("segment_id"))
    g = g.withColumn("_at", F.row_number().over(Window.partitionBy("segment_id").orderBy("group_order"))).where("_at <= 3").drop("_at")
    j = points.join(g.hint("merge"), "segment_id").withColumn("at", F.row_number().over(Window.partitionBy("point_id").orderBy("group_order"))).where("at <= 3")
    d = j.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("at", "label", "size"))).alias("l"), F.min(F.struct("size", "at")).alias("m"))
    swap = F.transform("l", lambda x: F.when(x["at"] == 1, F.col("l")[F.col("m.at") - 1]["label"]).when(x["at"] == F.col("m.at"), F.col("l")[0]["label"]).otherwise(x["label"]))
    return d.select("point_id", F.slice(F.concat(swap, F.array_repeat(F.lit(-1), 3)), 1, 3).alias("labels"))


def remap_labels(df: DataFrame, mapping: DataFrame, col: str = "segment") -> DataFrame:
    """``col`` through a table (old, new); what the table lacks becomes -1."""
    return df.join(mapping.withColumnRenamed("old", col), col, "left").withColumn(col, F.coalesce("new", F.lit(-1))).drop("new")


def merge_label_maps(maps: DataFrame) -> DataFrame:
    """Per-scene (scene_id, id, name) maps in one id space over sorted names: adds new_id."""
    names = maps.select("name").distinct().withColumn("new_id", F.row_number().over(Window.orderBy("name")) - 1)
    return maps.join(names, "name")


def filter_class_map(mapping: DataFrame, thresh: int, kind: str = "target") -> DataFrame:
    """(name, target) with enough instances; an empty target means the class itself, 'None' drops it."""
    d = mapping.where(F.col("count") >= thresh).withColumn("target", F.when(F.col("target").isNull() | (F.col("target") == ""), F.col("name")).otherwise(F.col("target")) if kind == "target" else F.col("name"))
    return d.where("target <> 'None'").select("name", "target")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normals of vertices: the sum of the cross products of their faces, which weighs them by area."""
    d = faces
    for k in ("a", "b", "c"):
        d = d.join(vertices.select(F.col("vertex_id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in XYZ)), k)
    e = lambda k, c: F.col(f"{k}{c}") - F.col(f"a{c}")
    cross = {c: e("b", p) * e("c", q) - e("b", q) * e("c", p) for c, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    d = d.select(F.explode(F.array("a", "b", "c")).alias("vertex_id"), *(v.alias(f"n{c}") for c, v in cross.items()))
    s = d.groupBy("vertex_id").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in XYZ))
    size = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-12))
    return s.withColumns({f"n{c}": F.col(f"n{c}") / size for c in XYZ})


def previous_frames(frames: DataFrame, n: int, key: str = "device", frame: str = "frame_id") -> DataFrame:
    """(frame, step, prev, lag): the ``n`` - 1 frames before each one; a short chain repeats its earliest."""
    w = Window.partitionBy(key).orderBy("ts", frame)
    first = Window.partitionBy(key).orderBy("ts", frame).rowsBetween(Window.unboundedPreceding, 0)
    d = frames.withColumns({f"_{k}": F.coalesce(F.lag(F.struct(F.col(frame).alias("f"), F.col("ts").alias("t")), k).over(w), F.first(F.struct(F.col(frame).alias("f"), F.col("ts").alias("t"))).over(first)) for k in range(1, n)})
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"_{k}").alias("p")) for k in range(1, n))))
    return d.select(F.col(frame).alias("frame"), "ts", steps.alias("s")).select("frame", "s.step", F.col("s.p.f").alias("prev"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("s.p.t").cast("timestamp"))) / 1e6).alias("lag"))


def match_instances(pred: DataFrame, gt: DataFrame, void: int = -1) -> DataFrame:
    """(pred_id, instance, overlap, n_pred, n_gt, n_void): how predicted and true instances of one class meet. pred: point_id,
    pred_id, class; gt: point_id, instance, segment."""
    j = pred.join(gt, "point_id")
    n_pred = j.groupBy("pred_id").agg(F.count("*").alias("n_pred"), F.count_if(F.col("segment") == void).alias("n_void"))
    n_gt = gt.where(F.col("segment") != void).groupBy("instance", "segment").agg(F.count("*").alias("n_gt"))
    both = j.where((F.col("class") == F.col("segment")) & (F.col("segment") != void)).groupBy("pred_id", "instance", "segment").agg(F.count("*").alias("overlap"))
    return both.join(n_pred, "pred_id").join(n_gt, ["instance", "segment"])


def associate(clusters: DataFrame, masks: DataFrame, cluster_feats: DataFrame, mask_feats: DataFrame, accept: float = 0.2) -> DataFrame:
    """(cluster, view, mask, score): best mask per cluster and view by IoU times (1 - L1 feature distance), above ``accept``.
    clusters: cluster, point; masks: view, mask, point; feats: id, feat."""
    nc = clusters.groupBy("cluster").agg(F.count("*").alias("nc"))
    nm = masks.groupBy("view", "mask").agg(F.count("*").alias("nm"))
    both = clusters.join(masks, "point").groupBy("cluster", "view", "mask").agg(F.count("*").alias("k"))
    d = both.join(nc, "cluster").join(nm, ["view", "mask"]).withColumn("iou", F.col("k") / (F.col("nc") + F.col("nm") - F.col("k")))
    d = d.join(cluster_feats.select(F.col("id").alias("cluster"), F.col("feat").alias("fc")), "cluster").join(mask_feats.select(F.col("id").alias("mask"), F.col("feat").alias("fm")), "mask")
    l1 = F.aggregate(F.zip_with("fc", "fm", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("fc")
    d = d.withColumn("score", F.col("iou") * (1 - l1))
    best = d.groupBy("cluster", "view").agg(F.max(F.struct("score", -F.col("mask"))).alias("b"))
    return best.where(F.col("b.score") > accept).select("cluster", "view", (-F.col("b.col2")).alias("mask"), F.col("b.score").alias("score"))
