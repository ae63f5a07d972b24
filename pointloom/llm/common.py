"""What the text operators share: the word rule, the shared folder, tables written and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session
    takes a temporary folder and a cluster the warehouse, and the session keeps the choice."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("pointloom.shared.dir", None)
    if not found:
        if conf.get("spark.master", "").startswith("local[") or conf.get("spark.master", "") == "local":
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pointloom"
        spark.conf.set("pointloom.shared.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The scopes of ``scratch`` that are open, and the tables written in each.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed when it ends; what has to outlive it is written with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of ``df``, written to the shared folder as Parquet and read back. This cuts the lineage, survives lost
    executors and gives the planner true sizes. Inside ``scratch`` the table goes with the scope, unless it is to be kept."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """row (a number that no other row has) and doc (all columns of ``docs``, whatever their names), written, so that the
    numbers hold for whoever reads them again."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
