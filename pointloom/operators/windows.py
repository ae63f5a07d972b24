"""Orders, running values and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cell, morton
from pointloom.operators.order import placed


def serialize(df: DataFrame, size: float, depth: int = 16, swapped: bool = False) -> DataFrame:
    """Adds ``code`` (z-order of the cell) and ``rank``, the place along the curve in the scene, from 0. Scenes are range-partitioned,
    so a large one is sorted by many tasks."""
    d = cell(df, size).withColumn("code", morton(F.col("cx"), F.col("cy"), F.col("cz"), depth, swapped))
    return placed(d, ["scene_id"], ["code", "point_id"], "rank")


def curve_layout(df: DataFrame, size: float, partitions: int) -> DataFrame:
    """The same rows range-partitioned and sorted by scene and code, so that files hold narrow stretches of the curve."""
    d = cell(df, size).withColumn("code", morton(F.col("cx"), F.col("cy"), F.col("cz")))
    return d.repartitionByRange(partitions, "scene_id", "code").sortWithinPartitions("scene_id", "code", "point_id")


def patches(ranked: DataFrame, size: int) -> DataFrame:
    """(scene_id, patch, slot, point_id): patches of ``size`` along the curve; the last one is filled up from the points just
    before it, unless the scene has no more than one patch."""
    n = ranked.groupBy("scene_id").agg(F.count("*").alias("_n"))
    d = ranked.join(n, "scene_id").withColumns({"patch": F.floor(F.col("rank") / size), "slot": F.col("rank") % size})
    # the points that the last patch of a scene borrows
    lack = (size - F.col("_n") % size) % size
    last = F.floor((F.col("_n") - 1) / size)
    start = last * size
    borrowed = d.where((F.col("_n") > size) & (F.col("rank") >= start - lack) & (F.col("rank") < start))
    borrowed = borrowed.withColumns({"patch": last, "slot": F.col("_n") % size + F.col("rank") - (start - lack)})
    return d.unionByName(borrowed).select("scene_id", "patch", F.col("slot").cast("long").alias("slot"), "point_id")


def offsets(df: DataFrame) -> DataFrame:
    """Rows per scene and the cumulative end, as a batch of clouds stores them. One row a scene enters the window."""
    n = df.groupBy("scene_id").agg(F.count("*").alias("n"))
    return n.withColumn("offset", F.sum("n").over(Window.orderBy("scene_id").rowsBetween(Window.unboundedPreceding, 0)))


def smooth_metrics(df: DataFrame, n: int) -> DataFrame:
    """name, iteration, value, mean and median of the last ``n`` values."""
    w = Window.partitionBy("name").orderBy("iteration").rowsBetween(-(n - 1), 0)
    return df.withColumns({"mean": F.avg("value").over(w), "median": F.percentile("value", F.lit(0.5)).over(w)})


def latest_metrics(df: DataFrame) -> DataFrame:
    """Per name: the global mean and the latest value."""
    return df.groupBy("name").agg(F.avg("value").alias("mean"), F.max_by("value", "iteration").alias("latest"))


def trivial_status(df: DataFrame, low: float, high: float, n: int = 10) -> DataFrame:
    """Status by the mean of the last ``n`` values of two series a and b."""
    w = Window.partitionBy("name").orderBy("iteration").rowsBetween(-(n - 1), 0)
    d = df.withColumns({"ma": F.avg("a").over(w), "mb": F.avg("b").over(w)})
    return d.withColumn("status", F.when((F.col("ma") < low) & (F.col("mb") < low), "trivial").when((F.col("ma") > high) | (F.col("mb") > high), "learning").otherwise("unclear"))


def rank_for_energy(df: DataFrame, levels=(0.9, 0.95, 0.99)) -> DataFrame:
    """(k, s) singular values, largest first, to the first rank that reaches each share of the energy."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("energy", F.sum(F.col("s") * F.col("s")).over(w) / F.sum(F.col("s") * F.col("s")).over(Window.partitionBy()))
    return e.agg(*(F.min(F.when(F.col("energy") >= t - 1e-12, F.col("k"))).alias(f"rank_{round(t * 100)}") for t in levels))


def median5(c: str, w) -> Column:
    """Median of five neighbours in order, with zeros beyond the ends."""
    near = F.array(*(F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for k in (2, 1)), F.col(c), *(F.coalesce(F.lead(c, k).over(w), F.lit(0.0)) for k in (1, 2)))
    return F.sort_array(near)[2]


def threshold_sweep(scores: DataFrame, steps: int = 100) -> DataFrame:
    """(key, t, area): how many scores of a map reach each threshold 0, 1/steps, ... A histogram per key is summed from above,
    so no score meets every threshold."""
    b = scores.select("key", F.least(F.greatest(F.floor(F.col("score") * steps + 1e-9), F.lit(0)), F.lit(steps)).cast("int").alias("t"))
    counts = b.groupBy("key", "t").agg(F.count("*").alias("n"))
    grid = scores.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("t"))
    full = grid.join(counts.hint("merge"), ["key", "t"], "left")
    up = Window.partitionBy("key").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select("key", "t", F.sum(F.coalesce("n", F.lit(0))).over(up).cast("double").alias("area"))


def stable_threshold(scores: DataFrame, steps: int = 100, sensitivities=(0.01, 0.02, 0.05, 0.1, 1.0), min_length: int = 5) -> DataFrame:
    """Per map the threshold at which its area hardly changes: the change between thresholds, relative to the largest area,
    is smoothed by a median of five; of the stretches of at least ``min_length`` steps below the lowest sensitivity that has
    one, the last gives its middle. Maps without any get null."""
    w = Window.partitionBy("key").orderBy("t")
    d = threshold_sweep(scores, steps)
    d = d.withColumn("slope", F.abs(F.coalesce(F.lead("area").over(w), F.col("area")) - F.col("area")) / F.greatest(F.max("area").over(Window.partitionBy("key")), F.lit(1.0)))
    d = d.withColumn("calm", median5("slope", w))
    d = d.select("key", "t", "calm", F.explode(F.array(*map(F.lit, sensitivities))).alias("level")).where(F.col("calm") < F.col("level"))
    runs = d.withColumn("run", F.col("t") - F.row_number().over(Window.partitionBy("key", "level").orderBy("t")))
    runs = runs.groupBy("key", "level", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).where(F.col("n") >= min_length)
    best = runs.groupBy("key").agg(F.min(F.struct("level", -F.col("a"), "b")).alias("r"))
    return scores.select("key").distinct().join(best.select("key", F.col("r.level").alias("level"), ((-F.col("r.col2") + F.col("r.b")) / 2 / steps).alias("threshold")), "key", "left")
