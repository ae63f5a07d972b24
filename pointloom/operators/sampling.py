"""Sampling by cells, chunks, spheres and classes. Draws come from md5, so they are the same in any engine and any run."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ, cell, drawn
from pointloom.functions.shared import saved
from pointloom.operators import covers
from pointloom.operators.order import placed

CELL = ("cx", "cy", "cz")


def draw(seed, key: Column | str = "point_id") -> Column:
    """The md5 of a seed and an id, for orders."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")))


def by_cell(*order) -> Column:
    return Window.partitionBy("scene_id", *CELL).orderBy(*order)


def voxel_sample(df: DataFrame, size: float, policy: str = "first", seed: int = 0) -> DataFrame:
    """One point per cell: the first id, a random one, or a random valid one where there is any. The least of a struct is
    taken per cell, with partial results before the shuffle; no cell is sorted."""
    key = {"first": [F.col("point_id")], "random": [draw(seed)], "valid": [~F.col("valid"), draw(seed)]}[policy]
    rest = F.struct(*(c for c in df.columns if c != "scene_id"))
    return cell(df, size).groupBy("scene_id", *CELL).agg(F.min_by(rest, F.struct(*key, F.col("point_id"))).alias("row")).select("scene_id", "row.*", *CELL)


def voxel_sample_importance(df: DataFrame, size: float, score: Column) -> DataFrame:
    """The point of highest score per cell; ties go to the smallest id."""
    return cell(df, size).groupBy("scene_id", *CELL).agg(F.max(F.struct(score.alias("score"), -F.col("point_id"))).alias("b")).select("scene_id", *CELL, (-F.col("b.col2")).alias("point_id"), F.col("b.score").alias("score"))


def voxel_fragments(df: DataFrame, size: float) -> DataFrame:
    """(scene_id, fragment, point_id): fragment i holds of every cell the point at i modulo its count; there are as many
    fragments as points in the fullest cell of the scene, and together they hold every point."""
    d = cell(df, size).select("scene_id", "point_id", *CELL)
    d = d.withColumns({"_at": F.row_number().over(by_cell("point_id")) - 1, "_n": F.count("*").over(Window.partitionBy("scene_id", *CELL))})
    top = d.groupBy("scene_id").agg(F.max("_n").alias("_top"))
    d = d.join(top, "scene_id")
    return d.select("scene_id", F.explode(F.sequence(F.col("_at"), F.col("_top") - 1, F.col("_n"))).alias("fragment"), "point_id")


def voxel_inverse(df: DataFrame, sampled: DataFrame, size: float) -> DataFrame:
    """point_id and the id of the sampled point of its cell."""
    return cell(df, size).select("scene_id", "point_id", *CELL).join(sampled.select("scene_id", *CELL, F.col("point_id").alias("sample_id")), ["scene_id", *CELL]).select("point_id", "sample_id")


def voxel_sample_labeled(df: DataFrame, size: float, key: str = "ref_id") -> DataFrame:
    """One reference point per cell, labelled ones first, then the smallest id."""
    return cell(df, size).groupBy("scene_id", *CELL).agg(F.min(F.struct((F.col("segment") == -1).alias("u"), F.col(key), F.col("segment"))).alias("b")).select("scene_id", *CELL, f"b.{key}", "b.segment")


def sample_cells(df: DataFrame, size: float, lo: float = 0.2, hi: float = 0.8, seed: int = 0, mode: str = "ratio") -> DataFrame:
    """A share of each cell's points, drawn per cell between ``lo`` and ``hi``, at least one point; ``single`` takes one drawn
    point per cell, ``dense`` all. With lo = hi = 0.5 the ratio mode gives the sparse half of a pair whose other half is dense."""
    d = cell(df, size)
    if mode == "dense":
        return d
    if mode == "single":
        rest = F.struct(*(c for c in df.columns if c != "scene_id"))
        return d.groupBy("scene_id", *CELL).agg(F.min_by(rest, F.struct(draw(seed), "point_id")).alias("row")).select("scene_id", "row.*", *CELL)
    ratio = lo + (hi - lo) * drawn(seed, F.col("scene_id"), F.col("cx"), F.col("cy"), F.col("cz"))
    w = Window.partitionBy("scene_id", *CELL)
    d = d.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(by_cell(draw(seed), "point_id"))})
    return d.where(F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_n", "_at")


def dropout(df: DataFrame, ratio: float, seed: int = 0, protected: Column | None = None) -> DataFrame:
    """Drops about a share of points by their own draw (no sort, no shuffle); protected ones stay."""
    keep = drawn(seed, F.col("point_id")) >= ratio
    return df.where(keep if protected is None else keep | protected)


def distance2(center) -> Column:
    return sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(XYZ[1:], center[1:])), (F.col("x") - center[0]) * (F.col("x") - center[0]))


def sphere_crop(df: DataFrame, n: int, center) -> DataFrame:
    """The ``n`` points of each scene that are nearest to a centre; ties by id."""
    d = df.withColumn("_d2", distance2(center))
    for keys in (["scene_id", F.pmod(F.xxhash64("point_id"), F.lit(64))], ["scene_id"]):  # of each bucket first, so no task ranks a scene
        d = d.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_d2", "point_id"))).where(F.col("_at") <= n)
    return d.drop("_d2", "_at")


def lattice_crops(df: DataFrame, radius: float, step: float, max_crops: int, min_points: int) -> DataFrame:
    """(scene_id, kx, ky, kz, point_id): spheres round the nodes of a lattice. Each point works out the nodes in reach by
    arithmetic, so nothing is joined by distance; nodes with too few points go and at most ``max_crops`` fullest stay."""
    reach = int(radius // step) + 1
    near = lambda c: F.sequence(F.floor(F.col(c) / step) - reach, F.floor(F.col(c) / step) + reach + 1)
    d = df.select("scene_id", "point_id", *XYZ)
    for c in XYZ:
        d = d.withColumn(f"k{c}", F.explode(near(c))).where(F.abs(F.col(f"k{c}") * step - F.col(c)) <= radius)
    d = d.where(sum((F.col(f"k{c}") * step - F.col(c)) ** 2 for c in XYZ) <= radius * radius)
    full = d.groupBy("scene_id", "kx", "ky", "kz").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points)
    top = full.withColumn("_at", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("_n"), "kx", "ky", "kz"))).where(F.col("_at") <= max_crops)
    return d.join(top.drop("_n", "_at").hint("merge"), ["scene_id", "kx", "ky", "kz"], "left_semi").select("scene_id", "kx", "ky", "kz", "point_id")


def plane_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("scene_id").agg(*(f(c).alias(f"_{c}{n}") for c in "xy" for n, f in (("l", F.min), ("h", F.max))))


def windows_of(df: DataFrame, size: float, stride: float) -> DataFrame:
    """Each point with every window (wx, wy) of the plane that holds it, by arithmetic; windows start at multiples of the
    stride below extent + stride - size, after moving the scene's minimum to 0."""
    d = df.join(F.broadcast(plane_bounds(df)), "scene_id")  # so that no task sorts a scene
    for c in "xy":
        at, extent = F.col(c) - F.col(f"_{c}l"), F.col(f"_{c}h") - F.col(f"_{c}l")
        first, last = F.greatest(F.floor((at - size) / stride) + 1, F.lit(0)), F.floor(at / stride)
        d = d.where(last >= first).withColumn(f"w{c}", F.explode(F.sequence(first, last))).where(F.col(f"w{c}") * stride < extent + stride - size)
    return d.drop("_xl", "_xh", "_yl", "_yh")


def chunk(df: DataFrame, size: float, stride: float, min_size: int, max_chunks: int) -> DataFrame:
    """(scene_id, chunk_id, wx, wy, point_id): overlapping windows with enough points, the fullest of a scene first."""
    d = windows_of(df, size, stride).select("scene_id", "wx", "wy", "point_id")
    n = full_windows(df, size, stride, min_size, max_chunks)
    return d.join(n.hint("merge"), ["scene_id", "wx", "wy"]).select("scene_id", "chunk_id", "wx", "wy", "point_id")


def full_windows(df: DataFrame, size: float, stride: float, min_size: int, max_chunks: int) -> DataFrame:
    """(scene_id, chunk_id, wx, wy): the windows of ``chunk`` without their points."""
    n = windows_of(df.select("scene_id", "x", "y"), size, stride).groupBy("scene_id", "wx", "wy").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size)
    n = n.withColumn("chunk_id", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("_n"), "wx", "wy")) - 1).where(F.col("chunk_id") < max_chunks)
    return n.select("scene_id", "chunk_id", "wx", "wy")


def chunk_pair(chunks: DataFrame, df: DataFrame, ref: DataFrame, size: float, stride: float, key: str = "ref_id") -> DataFrame:
    """Reference points by the same windows as the chunks that survive; windows are placed by the bounds of ``df``. chunks: those of
    ``chunk``, or just ``full_windows``. The few that survive go to the reference points, so none of these is sorted by window."""
    keep = F.broadcast(chunks.select("scene_id", "chunk_id", "wx", "wy").distinct())
    d = ref.join(F.broadcast(plane_bounds(df)), "scene_id")
    for c in "xy":  # the windows that hold a point follow from its place
        at = F.col(c) - F.col(f"_{c}l")
        first, last = F.greatest(F.floor((at - size) / stride) + 1, F.lit(0)), F.floor(at / stride)
        d = d.where(last >= first).withColumn(f"w{c}", F.explode(F.sequence(first, last)))
    return d.join(keep, ["scene_id", "wx", "wy"]).select("scene_id", "chunk_id", key)


def sample_per_class(df: DataFrame, per_class: int, total: int, seed: int = 0) -> DataFrame:
    """At most ``per_class`` rows of a class and ``total`` of all, by draws."""
    d = df.withColumn("_d", draw(seed)).withColumn("_at", F.row_number().over(Window.partitionBy("segment").orderBy("_d", "point_id"))).where(F.col("_at") <= per_class)
    return d.orderBy("_d", "point_id").limit(total).drop("_d", "_at")


def sample_weighted(df: DataFrame, weight: str, n: int, seed: int = 0, buckets: int = 256) -> DataFrame:
    """``n`` draws with replacement: point_id and how often it was drawn. Weights are summed by hash buckets, then inside
    each, so no task sees all rows; draws meet rows by bucket and interval."""
    d = df.select("point_id", F.col(weight).alias("_w"), F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int").alias("_b")).where("_w > 0")
    sums = d.groupBy("_b").agg(F.sum("_w").alias("_s"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumns({"_end": F.sum("_s").over(up), "_all": F.sum("_s").over(Window.partitionBy())}).withColumn("_from", F.col("_end") - F.col("_s"))
    inner = Window.partitionBy("_b").orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_hi", F.sum("_w").over(inner)).withColumn("_lo", F.col("_hi") - F.col("_w"))
    spark = df.sparkSession
    draws = spark.range(n).select("id", (drawn(seed, F.col("id")) * 1.0).alias("_u")).join(F.broadcast(ends)).where((F.col("_u") * F.col("_all") >= F.col("_from")) & (F.col("_u") * F.col("_all") < F.col("_end")))
    draws = draws.select("_b", (F.col("_u") * F.col("_all") - F.col("_from")).alias("_x"))
    met = d.join(draws.hint("shuffle_hash"), "_b").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
    return met.groupBy("point_id").agg(F.count("*").alias("times"))


def farthest_sample(df: DataFrame, m: int, keep: int = 4096) -> DataFrame:
    """(scene_id, step, point_id): farthest-point sampling, exactly; each scene starts at its smallest id and ties go to the smaller
    id. Scenes with fewer than ``m`` points pick some again.

    Points of one place are one row. A round is one pass: distances to the last round's picks, then the ``keep`` farthest points of each scene. As distances only
    fall, the next picks are among these for as long as the farthest of them, measured anew after each pick, stays beyond the
    nearest that was kept. So a round makes many picks, at least one, and all scenes go on at once."""
    square = lambda x, y, z: x * x + y * y + z * z

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_at")
        ids, place, d, step = t["point_id"].to_numpy(), t[list(XYZ)].to_numpy(), t["_d"].to_numpy().copy(), int(t["_next"].iloc[0])
        limit, chosen = d[-1] if len(d) == keep else -1.0, []
        while step + len(chosen) < m:
            far = d.max()
            if chosen and far <= limit:
                break
            equal = np.flatnonzero(d == far)
            chosen.append(equal[ids[equal].argmin()])
            d = np.minimum(d, square(*(place - place[chosen[-1]]).T))
        return pd.DataFrame({"scene_id": t["scene_id"].iloc[0], "step": np.arange(step, step + len(chosen), dtype=np.int32), "point_id": ids[chosen], **{c: place[chosen, k] for k, c in enumerate(XYZ)}})

    # a place is its least point: the others of it are as near to all picks, and never before it
    d = df.select("scene_id", *(F.col(c).cast("double").alias(c) for c in XYZ), "point_id").groupBy("scene_id", *XYZ).agg(F.min("point_id").alias("point_id"))
    d = saved(d.select("scene_id", "point_id", *XYZ, F.lit(float("inf")).alias("_d")), "distances")
    first = d.groupBy("scene_id").agg(F.min_by(F.struct("point_id", *XYZ), "point_id").alias("p"))
    picks = saved(first.select("scene_id", F.lit(0).alias("step"), "p.*"), "picks")
    types = ", ".join(f"{c} {t}" for c, t in picks.dtypes)
    out = [picks]
    while True:
        open_ = saved(picks.groupBy("scene_id").agg((F.max("step") + 1).alias("_next"), F.collect_list(F.struct(*XYZ)).alias("_p")).where(F.col("_next") < m), "open")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, out).select("scene_id", "step", "point_id")
        nearer = F.aggregate("_p", F.col("_d"), lambda least, p: F.least(least, square(*(F.col(c) - p[c] for c in XYZ))))
        d = saved(d.drop("_next").join(open_, "scene_id").select("scene_id", "point_id", *XYZ, nearer.alias("_d"), "_next"), "distances")
        far = d.withColumn("_at", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("_d"), "point_id"))).where(F.col("_at") <= keep)
        picks = saved(far.groupBy("scene_id").applyInPandas(pick, types), "picks")
        out.append(picks)


def topk_labels(votes: DataFrame, k: int) -> DataFrame:
    """(point, rank, label) of the ``k`` labels with most votes per point; points with fewer repeat their best.
    votes: point, label, n."""
    top = votes.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("n"), "label"))).where(F.col("rank") <= k)
    d = top.groupBy("point").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("l"))
    full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(F.col("l"), i), F.col("l")[0]))
    return d.select("point", F.posexplode(full).alias("rank", "label")).withColumn("rank", F.col("rank") + 1)


def make_views(df: DataFrame, specs) -> DataFrame:
    """Several versions of the same points, one per (name, function), tagged by view."""
    return reduce(DataFrame.unionByName, [f(df).withColumn("view", F.lit(name)) for name, f in specs])


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``place``, from 1: a random order inside each scene."""
    d = placed(df.withColumn("_draw", draw(seed)), ["scene_id"], ["_draw", "point_id"], "place")
    return d.withColumn("place", F.col("place") + 1).drop("_draw")


def sphere_cover(df: DataFrame, n: int, lot: int = 256, seed: int = 0) -> DataFrame:
    """(scene_id, crop, point_id): crops of the ``n`` points nearest to the first point, in the order of draws, that no crop holds
    yet, until all are held; a scene with fewer points is one crop. One row a point is expected; points without a finite place
    are in no crop. Ties of distance go to the centre's own draw, to those after it and to those before it.

    Exactly so, but in rounds: the first points of each tile that no crop holds are looked at together, ``lot`` a tile at most, and
    those are centres that no earlier point can hold, be it looked at or not. Rounds carry only points that are not held yet."""
    return covers.sphere_cover(df, n, lot, draw(seed))
