"""Tables written to the folder that driver and executors share, and read back: how iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without one takes a temporary folder, a cluster the warehouse."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("pointloom.shared.dir", None)
    if not found:
        local = conf.get("spark.master", "").startswith("local") and not conf.get("spark.master", "").startswith("local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pointloom"
        spark.conf.set("pointloom.shared.dir", found)
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a written table: a lost executor costs no recomputation beyond it, and sizes are known."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
