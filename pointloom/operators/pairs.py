"""All pairs of a few thousand wide rows, compared block against block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.shared import saved

#: Numbers that a block of rows holds at most, and its rows at most.
BLOCK_NUMBERS = 1 << 22
BLOCK_ROWS = 64


def block_pairs(rows: DataFrame, key: str, wide: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``compare`` gives for every pair of rows with different keys, the smaller key first. Rows without a key take no part.

    Rows are dealt into blocks by a hash of the key, as many rows a block as ``wide``, their largest array, allows. A task has one
    pair of blocks, so a row is sent once for each block and not once for each other row. ``compare`` gets one row as a frame
    and some rows of larger keys, and returns a frame with as many rows as the latter."""
    rows = saved(rows.where(F.col(key).isNotNull()), "pair-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size(wide))).first()
    blocks = max(1, -(-n // max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, width or 1)))))
    d = rows.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumns({"_lo": F.least("_own", "_other").cast("long"), "_hi": F.greatest("_own", "_other").cast("long")}).drop("_other")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(at: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(key, kind="stable").reset_index(drop=True)
        out = [pd.DataFrame(columns=names)]
        for i in range(len(d)):
            later = d[key].to_numpy() > d[key][i]
            if at[0] != at[1]:  # pairs inside a block have a task of their own
                later &= d["_own"].to_numpy() != d["_own"][i]
            if later.any():
                out.append(compare(d.iloc[i : i + 1], d[later]))
        return pd.concat(out[1:] or out, ignore_index=True)

    return d.groupBy("_lo", "_hi").applyInPandas(run, schema)


def stacked(column: pd.Series, *shape: int) -> np.ndarray:
    """Arrays of a column as one array with the rows in front."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]).reshape(len(column), *shape)
