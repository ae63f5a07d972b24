"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, bool):
        return v
    return str(v) if v is not None and not isinstance(v, int) else v


def compare(spark, con, sf: str, name: str, queries, oracles) -> str:
    """Empty if both sides agree, else what differs."""
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(oracles[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if mine == want:
        return ""
    return f"{sum(mine.values())} and {sum(want.values())} rows; only Spark {list((mine - want).items())[:3]}; only SQL {list((want - mine).items())[:3]}"
