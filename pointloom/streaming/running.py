"""Running statistics over streams. All but the last two are plain streaming aggregates: the same plan serves a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.linalg import cross_sums


def stream_confusion(sdf: DataFrame) -> DataFrame:
    """(gt, pred, n) so far."""
    return sdf.where("segment <> -1").groupBy(F.col("segment").alias("gt"), "pred").agg(F.count("*").alias("n"))


def stream_meter(sdf: DataFrame) -> DataFrame:
    """Weighted mean per name: value counts ``n`` times."""
    return sdf.groupBy("name").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def stream_dim_corr(sdf: DataFrame) -> DataFrame:
    """Per dimension the correlation of a and b, from running sums."""
    a, b = F.col("a"), F.col("b")
    s = sdf.groupBy("pos").agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    n = F.col("n")
    top = n * F.col("sab") - F.col("sa") * F.col("sb")
    return s.select("pos", "n", (top / F.sqrt((n * F.col("saa") - F.col("sa") ** 2) * (n * F.col("sbb") - F.col("sb") ** 2))).alias("corr"))


def stream_votes(sdf: DataFrame) -> DataFrame:
    """(point, class, w): weight of votes so far."""
    return sdf.groupBy("point", "class").agg(F.sum("weight").alias("w"))


def stream_gram(state_path: str, left: str = "x", right: str = "y"):
    """A foreachBatch function that writes the sums of each batch under its id; running it again overwrites the same file, so
    a restart counts no batch twice. ``gram_state`` adds them up."""

    def add(df: DataFrame, batch_id: int) -> None:
        xx, _, _, n = cross_sums(df, left)
        xy, _, _, _ = cross_sums(df, left, right)
        if n:
            rows = [(i, [float(v) for v in np.concatenate([xx[i], xy[i]])], float(n)) for i in range(len(xx))]
            df.sparkSession.createDataFrame(rows, "i int, v array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return add


def gram_state(spark, state_path: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'X, X'Y, rows) of all batches in a state folder."""
    d = spark.read.parquet(state_path)
    long = d.select("i", "n", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    i, j, v = (np.array(long.column(c)) for c in ("i", "j", "v"))
    m = np.zeros((i.max() + 1, j.max() + 1))
    m[i, j] = v
    return m[:, : len(m)], m[:, len(m) :], float(long.column("n")[0].as_py())


def stream_history(sdf: DataFrame, n: int) -> DataFrame:
    """Per name, after each batch: latest iteration, mean and median of the last ``n`` values, and how many values were seen so
    far, which tells the newest row; with state of at most ``n`` values."""

    def update(key: tuple, batches, state: GroupState):
        *kept, seen = state.get if state.exists else ([], [], 0)
        kept = list(zip(*kept))
        for d in batches:
            seen += len(d)
            kept = sorted([*kept, *zip(d["iteration"].tolist(), d["value"].tolist())])[-n:]
        state.update((*map(list, zip(*kept)), seen))
        v = np.array([x for _, x in kept])
        yield pd.DataFrame({"name": [key[0]], "iteration": [kept[-1][0]], "mean": [v.mean()], "median": [np.median(v)], "seen": [seen]})

    schema = "name string, iteration long, mean double, median double, seen long"
    return sdf.groupBy("name").applyInPandasWithState(update, schema, "iterations array<long>, vals array<double>, seen long", "update", GroupStateTimeout.NoTimeout)


def replay(df: DataFrame, path: str, parts: int, by: str) -> DataFrame:
    """A table written in ``parts`` goes by all tasks and read back as a stream in as many batches: for tests and backfills."""
    for k in range(parts):
        df.where(F.coalesce(F.pmod(F.col(by), F.lit(parts)), F.lit(0)) == k).write.mode("append").parquet(path)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // parts)).parquet(path)


def drained(sdf: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns what it put out, written by the tasks under ``path``: in complete mode what
    holds after the last batch, else the rows of all batches. A batch that runs again overwrites its own files."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else batch_id}")

    empty = sdf.sparkSession.createDataFrame([], sdf.schema)
    empty.write.mode("append").parquet(f"{path}/out/batch=-1")
    sdf.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/at").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(f"{path}/out").select(*sdf.columns)
