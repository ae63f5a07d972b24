"""Hilbert codes, which built-in expressions can't loop over: pandas UDFs on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, depth: int) -> np.ndarray:
    """Skilling's transform: coordinates to the transposed Hilbert index, then its bits interleaved."""
    a = [x.astype(np.int64).copy(), y.astype(np.int64).copy(), z.astype(np.int64).copy()]
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for k in range(3):
            on = (a[k] & bit) != 0
            swap = np.where(on, 0, (a[0] ^ a[k]) & low)
            a[0] = np.where(on, a[0] ^ low, a[0] ^ swap)
            if k:
                a[k] ^= swap
        bit >>= 1
    a[1] ^= a[0]
    a[2] ^= a[1]
    t = np.zeros_like(a[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        t = np.where((a[2] & bit) != 0, t ^ (bit - 1), t)
        bit >>= 1
    code = np.zeros_like(t)
    for k in range(depth - 1, -1, -1):
        for v in a:
            code = (code << 1) | (((v ^ t) >> k) & 1)
    return code


def decode(code: np.ndarray, depth: int) -> list[np.ndarray]:
    """The cells of Hilbert codes."""
    a = [np.zeros_like(code) for _ in range(3)]
    for k in range(depth):
        for i in range(3):
            a[i] |= ((code >> (3 * k + 2 - i)) & 1) << k
    t = a[2] >> 1
    a[2] ^= a[1]
    a[1] ^= a[0]
    a[0] ^= t
    bit = 2
    while bit != 1 << depth:
        low = bit - 1
        for k in (2, 1, 0):
            on = (a[k] & bit) != 0
            swap = np.where(on, 0, (a[0] ^ a[k]) & low)
            a[0] = np.where(on, a[0] ^ low, a[0] ^ swap)
            if k:
                a[k] ^= swap
        bit <<= 1
    return a


def hilbert_encode(depth: int):
    @pandas_udf("long")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(encode(x.to_numpy(), y.to_numpy(), z.to_numpy(), depth))

    return run


def hilbert_decode(depth: int):
    @pandas_udf("x long, y long, z long")
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xyz", decode(code.to_numpy(), depth))))

    return run
