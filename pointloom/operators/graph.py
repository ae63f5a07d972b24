"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b): the least node that edges lead to.

    Each round every root hooks on its least neighbour, hooks are followed twice, and only links between different roots go
    on, so the number of rounds grows with the logarithm of the longest chain. States are written out.
    """
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = saved(both(edges.select("a", "b")).distinct(), "links")
    state = None
    while True:
        hooks = saved(links.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "root"), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            hooks = saved(hooks.join(up.hint("merge"), "to").select("root", F.col("next").alias("to")), "hooks")
        state = hooks.select(F.col("root").alias("node"), F.col("to").alias("root")) if state is None else state.join(hooks.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        state = saved(state, "roots")
        end = lambda n: hooks.select(F.col("root").alias(n), F.col("to").alias(f"r{n}"))
        moved = links.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b").where("ra != rb")
        links = saved(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return state
