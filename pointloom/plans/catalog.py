"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.plans import q_aggregate, q_columns, q_linalg, q_relate, q_sampling, q_sources  # noqa: F401
from pointloom.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot class metrics: class vectors from the even rows, cosine classes for the odd ones, IoU by class."""
    return QUERIES["k9_seg_metrics"](spark, sf_dir)
