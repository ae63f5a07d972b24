"""Views of the given tables as points, features, cameras and so on. One text serves Spark and DuckDB alike.

``VIEWS`` maps a view to its SELECT; a view may use others. ``Tables`` builds them as DataFrames, ``oracle`` puts the ones a
query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "points": """select (((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey)*100 + cast(l_quantity as bigint) as point_id, l_orderkey*7 + l_linenumber as code, cast(l_suppkey % 8 as int) as scene_id,
        case when l_suppkey % 8 < 5 then 'train' when l_suppkey % 8 < 7 then 'val' else 'test' end as split,
        l_quantity as x, l_extendedprice/2000e0 as y, round(l_discount*100e0) as z,
        cast(l_partkey % 256 as int) as r, cast(l_suppkey % 256 as int) as g, cast(l_orderkey % 256 as int) as b, round(l_tax*100e0) - 4e0 as opacity_logit,
        -(l_partkey % 5) - 1e0 as s0, -(l_suppkey % 4) - 1e0 as s1, -l_linenumber * 1e0 as s2,
        (l_partkey % 7) - 3.5e0 as q0, l_linenumber * 1e0 as q1, round(l_discount*100e0)/10e0 as q2, 1e0 as q3,
        case when l_returnflag = 'N' then -1 else l_linenumber - 1 end as segment, cast(l_partkey % 50 as int) as instance, l_linestatus = 'F' as valid,
        cast(case when l_partkey % 11 = 0 then -1 when l_partkey % 3 = 0 then l_partkey % 7 else l_linenumber - 1 end as int) as pred from lineitem""",
    "ref_points": """select o_orderkey as ref_id, cast(o_custkey % 8 as int) as scene_id, o_orderkey % 50 + 1e0 as x, o_totalprice/10000e0 as y, cast(floor(o_custkey/8e0) as bigint) % 11 * 1e0 as z,
        cast(case when o_orderstatus = 'O' then -1 else o_orderkey % 7 end as int) as segment, cast(o_custkey % 50 as int) as instance from orders""",
    "features": "select vec_id as point_id, cast(vec_id % 5 as int) as scene_id, cast(embedding as {doubles}) as feat, label as segment from embeddings",
    "contrib": "select l_partkey as point, l_suppkey as view, l_linenumber - 1 as class, l_extendedprice/1e5 as weight from lineitem",
    "mask_members": "select distinct l_suppkey % 30 as mask, l_partkey as pixel from lineitem",
    "pixels": "select distinct l_suppkey % 25 as frame, l_partkey % 640 as u, l_orderkey % 480 as v, l_extendedprice/1000e0 as depth from lineitem",
    "frames": "select event_id as frame_id, user_id as device, ts from events where event_type = 'view'",
    "poses": "select event_id as pose_id, user_id as device, ts from events where event_type = 'click'",
    "metrics": "select event_type as name, event_id as iteration, value from events",
    "cameras": """select cast(n_nationkey as int) as frame, cos(n_nationkey*2e0*pi()/25e0) as c, sin(n_nationkey*2e0*pi()/25e0) as s,
        25e0 + 60e0*cos(n_nationkey*2e0*pi()/25e0) as px, 26e0 + 60e0*sin(n_nationkey*2e0*pi()/25e0) as py, 5e0 as pz, 500e0 as focal, 640 as width, 480 as height from nation""",
}
VIEWS["long_features"] = "select point_id, scene_id, segment, {explode} from features"
VIEWS["class_vectors"] = "select segment as label, pos, avg(v) as v from long_features where point_id % 2 = 0 group by segment, pos"
ENGINES = {
    "spark": {"doubles": "array<double>", "explode": "posexplode(feat) as (pos, v)"},
    "duckdb": {"doubles": "double[]", "explode": "unnest(range(len(feat))) as pos, unnest(feat) as v"},
}


def uses(sql: str) -> list[str]:
    """The views that a text needs, in an order that defines each before its use."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def oracle(sql: str) -> str:
    """A DuckDB query with the views it names."""
    views = ", ".join(f"{v} as ({VIEWS[v].format(**ENGINES['duckdb'])})" for v in uses(sql))
    sql = sql.strip()
    if not views:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"


class Tables:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the given tables and the views it names."""
        views = ", ".join(f"{v} as ({VIEWS[v].format(**ENGINES['spark'])})" for v in uses(text))
        frames = {t: getattr(self, t) for t in BASE if re.search(rf"\b{t}\b", f"{views} {text}")}
        text = text.format(**ENGINES["spark"])
        text = f"with {views} {text}" if views else text
        text = re.sub(r"\b(from|join) (" + "|".join(BASE) + r")\b", r"\1 {\2}", text)
        return self.spark.sql(text, **frames)

