"""Unions, intersections and differences of clouds, cells, scenes and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.aggregate import vector_mean, voxel_mean


def fuse_frames(dfs, size: float, avg_cols=("x", "y", "z"), first_cols=()) -> DataFrame:
    """Several clouds as one, then one mean point per cell."""
    return voxel_mean(reduce(DataFrame.unionByName, dfs), size, avg_cols, first_cols)


def common_cells(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Cells that both samples have, with both mean features in long form (keys, pos, a, b)."""
    m = lambda d, n: vector_mean(d, keys).select(*keys, "pos", F.col("v").alias(n))
    return m(a, "a").join(m(b, "b").hint("merge"), [*keys, "pos"])


def distinct_rows(df: DataFrame, feat: str = "feat") -> DataFrame:
    """Rows, distinct feature rows and their ratio."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(F.col(feat).cast("string")).alias("distinct_n")).withColumn("ratio", F.col("distinct_n") / F.col("n"))


def incomplete(meta: DataFrame, required: DataFrame) -> DataFrame:
    """Required (scene, attribute) pairs that the metadata lacks."""
    return required.exceptAll(meta.select(*required.columns).distinct())


def classes(df: DataFrame) -> DataFrame:
    """The distinct classes; each task tells its own, so only these are joined and not all rows of a class in one task."""
    return df.select("segment").distinct()


def common_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    return classes(a).intersect(classes(b))


def missing_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    return classes(a).subtract(classes(b))
