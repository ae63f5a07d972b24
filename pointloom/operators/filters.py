"""Filters on points, scenes, masks and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ, norm
from pointloom.functions.shared import saved
from pointloom.operators.order import quantiles


def filter_valid(df: DataFrame, flag: str = "valid", strict: bool = False) -> DataFrame:
    """Rows with a valid feature; cell ids stay as they are. ``strict`` raises if none remain (one job of one row)."""
    out = df.where(F.col(flag))
    if strict and out.limit(1).isEmpty():
        raise ValueError("no valid rows remain")
    return out


def filter_outliers(df: DataFrame, lo: float = 0.01, hi: float = 0.99, min_points: int = 100) -> DataFrame:
    """Adds ``kept``: whether a point is inside the box of exact percentiles of its scene. Where fewer than ``min_points``
    would stay, the nearest ones to the scene's median are kept instead."""
    ends = quantiles(df, ["scene_id"], {f"_{c}{n}": (c, p) for c in XYZ for n, p in (("l", lo), ("h", hi), ("m", 0.5))})
    d = df.join(ends, "scene_id")
    inside = d.withColumn("_in", sum((F.col(c).between(F.col(f"_{c}l"), F.col(f"_{c}h")).cast("int") for c in XYZ)) == 3)
    few = inside.groupBy("scene_id").agg((F.count_if("_in") < min_points).alias("_few"))
    d2 = sum((F.col(c) - F.col(f"_{c}m")) * (F.col(c) - F.col(f"_{c}m")) for c in XYZ)
    d = inside.join(few, "scene_id").withColumn("_d2", F.when(F.col("_few"), d2))
    # only the scenes that fall back are sorted
    sparse = d.where("_few").withColumn("_n", F.row_number().over(Window.partitionBy("scene_id").orderBy("_d2", "point_id")))
    out = sparse.withColumn("kept", F.col("_n") <= min_points).drop("_n").unionByName(d.where("not _few").withColumn("kept", F.col("_in")))
    return out.select(*df.columns, "kept")


def crop_aabb(df: DataFrame, ref: DataFrame, margin: float = 0.0) -> DataFrame:
    """Points inside the bounds of the reference points of their scene, widened by ``margin``."""
    box = ref.groupBy("scene_id").agg(*(f(c).alias(f"_{c}{n}") for c in XYZ for n, f in (("l", F.min), ("h", F.max))))
    d = df.join(box, "scene_id")
    for c in XYZ:
        d = d.where(F.col(c).between(F.col(f"_{c}l") - margin, F.col(f"_{c}h") + margin))
    return d.select(*df.columns)


def prune(df: DataFrame, opacity: float = 0.05, scale_max: float = 0.2) -> DataFrame:
    """Points that are neither too faint nor too large."""
    return df.where((F.col("opacity") >= opacity) & (F.greatest("s0", "s1", "s2") <= scale_max))


def drop_classes(df: DataFrame, ids) -> DataFrame:
    return df.where(~F.col("segment").isin(*ids))


def common_nonzero(a: DataFrame, b: DataFrame, thr: float = 0.0) -> DataFrame:
    """Rows whose feature is longer than ``thr`` in both sets: point_id, feat_a, feat_b."""
    both = a.select("point_id", F.col("feat").alias("feat_a")).join(b.select("point_id", F.col("feat").alias("feat_b")), "point_id")
    return both.where((norm(F.col("feat_a")) > thr) & (norm(F.col("feat_b")) > thr))


def nonzero_counts(a: DataFrame, b: DataFrame, thr: float = 0.0) -> DataFrame:
    """How many rows are non-zero in either and in both."""
    both = a.select("point_id", F.col("feat").alias("feat_a")).join(b.select("point_id", F.col("feat").alias("feat_b")), "point_id")
    p, q = norm(F.col("feat_a")) > thr, norm(F.col("feat_b")) > thr
    return both.agg(F.count("*").alias("n"), F.count_if(p).alias("n_a"), F.count_if(q).alias("n_b"), F.count_if(p & q).alias("n_both"))


def filter_pixels(df: DataFrame, grazing: float = 0.15, far: float = 65535) -> DataFrame:
    """Depth pixels seen steeply enough, in range and labelled: columns dot, length, depth, segment."""
    return df.where((F.abs("dot") / F.col("length") > grazing) & (F.col("depth") < far) & (F.col("segment") > 0))


def filter_scenes_valid(df: DataFrame, share: float = 0.5, flag: str = "valid") -> DataFrame:
    """All points of the scenes whose valid share is at least ``share``."""
    good = df.groupBy("scene_id").agg(F.avg(F.col(flag).cast("double")).alias("_share")).where(F.col("_share") >= share).select("scene_id")
    return df.join(good, "scene_id", "left_semi")


def filter_boxes(df: DataFrame, counts=("lidar", "radar")) -> DataFrame:
    """Boxes that some sensor hit."""
    return df.where(sum((F.col(c) for c in counts[1:]), F.col(counts[0])) > 0)


def embedding_outliers(a: DataFrame, b: DataFrame, percent: float = 0.95, method: str = "percentile") -> DataFrame:
    """point_id and whether the row is far from the centroid (beyond a percentile, or the upper quartile fence) in either of
    two representations."""
    from pointloom.operators.aggregate import centroid_distance

    d = saved(centroid_distance(a).withColumnRenamed("distance", "da").join(centroid_distance(b).withColumnRenamed("distance", "db"), "point_id"), "distances")
    if method == "percentile":
        cut = quantiles(d, [], {f"_{c}": (c, percent) for c in ("da", "db")})
    else:
        q = quantiles(d, [], {f"{c}{p}": (c, p / 100) for c in ("da", "db") for p in (25, 75)})
        cut = q.select(*((F.col(f"{c}75") + 1.5 * (F.col(f"{c}75") - F.col(f"{c}25"))).alias(f"_{c}") for c in ("da", "db")))
    return d.join(F.broadcast(cut)).select("point_id", ((F.col("da") > F.col("_da")) | (F.col("db") > F.col("_db"))).alias("outlier"))


def check_alignment(points: DataFrame, cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per rule and its number of violations: cell ids of points that the cell table lacks, cells without points,
    labels outside the list, missing coordinates, and cells whose points have different labels (-1 is none); then one row per
    attribute with the number of its values."""
    rules = [
        ("unknown_cell", points.join(cells, ["scene_id", "grid_id"], "left_anti")), ("empty_cell", cells.join(points, ["scene_id", "grid_id"], "left_anti")),
        ("unknown_label", points.join(labels, "segment", "left_anti")), ("missing_xyz", points.where("x is null or y is null or z is null")),
    ]
    mixed = points.groupBy("scene_id", "grid_id").agg(F.min(F.when(F.col("segment") >= 0, F.col("segment"))).alias("lo"), F.max("segment").alias("hi"))
    rules.append(("mixed_cell", mixed.where("lo is not null and lo < hi")))
    rules += [(f"count_{c}", points.where(F.col(c).isNotNull())) for c in ("x", "segment", "instance")]
    out = None
    for name, bad in rules:
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def protect_classes(df: DataFrame, ids) -> DataFrame:
    """Flags rows of rare classes, so that sampling keeps them."""
    return df.withColumn("protected", F.col("segment").isin(*ids))


def filter_masks(stats: DataFrame, variance: float, share: float = 0.8) -> DataFrame:
    """Masks with little variance; very large ones (above a share of the largest of the view) always stay."""
    top = F.max("n").over(Window.partitionBy("view"))
    return stats.withColumn("_top", top).where((F.col("variance") <= variance) | (F.col("n") > share * F.col("_top"))).drop("_top")
