"""Order statistics and places in an order, without a task that holds a whole group.

Quantiles are exact. A mergeable sketch gives two values that surely stand round the wanted places; the rows between them, some
thousandths of all, are looked at in the same way until few are left, and those are counted by value. That the values do stand
round the places is counted, not trusted.

Places come from a range partitioning: rows of one group may fill many partitions, and a place is the row's place in its partition
plus what the group has in partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.shared import saved

#: Rows of a group that may meet in one task, accuracy of the sketches, and groups that are sent to every executor at most.
ENOUGH = 100_000
ACCURACY = 2000
SENT = 100_000


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Keys and one column for each of ``wanted`` (name: column and share): the exact percentile, between two values in proportion.

    Nulls don't count, nan is the largest value; groups without values give null. An empty table without keys gives one row of nulls."""
    names, keys = list(wanted), list(keys)
    value = {n: F.col(c).cast("double") for n, (c, _) in wanted.items()}
    off = 2.0 / ACCURACY
    aggs = []
    for n, (_, p) in wanted.items():
        ends = F.percentile_approx(value[n], F.array(F.lit(max(p - off, 0.0)), F.lit(min(p + off, 1.0))), F.lit(10 * ACCURACY))
        aggs += [F.count(value[n]).alias(f"_n_{n}"), F.min(value[n]).alias(f"_min_{n}"), F.max(value[n]).alias(f"_max_{n}"), ends.alias(f"_e_{n}")]
    base = saved(df.groupBy(*keys).agg(*aggs), "ends")
    low = {n: F.when(F.lit(p <= off), F.col(f"_min_{n}")).otherwise(F.col(f"_e_{n}")[0]) for n, (_, p) in wanted.items()}
    high = {n: F.when(F.lit(p >= 1 - off), F.col(f"_max_{n}")).otherwise(F.col(f"_e_{n}")[1]) for n, (_, p) in wanted.items()}
    spot = {n: (F.col(f"_n_{n}") - 1) * p for n, (_, p) in wanted.items()}
    group = [F.struct(*keys).alias("_k")] if keys else [F.lit(0).alias("_k")]
    # one row for each group and quantile: its ends, and the place that is looked for
    asked = saved(base.select(*group, F.explode(F.array(*(F.struct(F.lit(i).alias("t"), low[n].cast("double").alias("a"), high[n].cast("double").alias("b"), F.col(f"_min_{n}").alias("least"), F.col(f"_max_{n}").alias("most"), spot[n].alias("h")) for i, n in enumerate(names)))).alias("x")).select("_k", "x.*").where("h >= 0"), "asked")
    few = asked.count() <= SENT
    by_group = asked.groupBy("_k").agg(F.collect_list(F.struct("t", "a", "b")).alias("_asked"))

    def rows_of(ends: DataFrame) -> DataFrame:
        """(group, quantile, v, a, b): each row's value for each quantile, with that quantile's ends."""
        rows = df.select(*group, F.array(*(value[n] for n in names)).alias("_v"))
        met = rows.join(F.broadcast(ends) if few else ends.hint("merge"), "_k")
        return met.select("_k", F.explode(F.transform("_asked", lambda x: F.struct(x["t"].alias("t"), F.get(F.col("_v"), x["t"]).alias("v"), x["a"].alias("a"), x["b"].alias("b")))).alias("x")).select("_k", "x.*").where("v is not null")

    seen = rows_of(by_group).groupBy("_k", "t").agg(F.count_if(F.expr("v < a")).alias("below"), F.count_if(F.expr("v <= b")).alias("upto"))
    sure = (F.col("below") <= F.floor("h")) & (F.ceil("h") < F.col("upto"))
    asked = saved(asked.join(seen.hint("merge"), ["_k", "t"]).select("_k", "t", "h", F.when(sure, F.col("a")).otherwise(F.col("least")).alias("a"), F.when(sure, F.col("b")).otherwise(F.col("most")).alias("b"), F.when(sure, F.col("below")).otherwise(0).alias("below")), "asked")
    inside = saved(rows_of(asked.groupBy("_k").agg(F.collect_list(F.struct("t", "a", "b")).alias("_asked"))).where("v >= a and v <= b").select("_k", "t", "v"), "inside")
    while True:
        sizes = inside.groupBy("_k", "t").agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        large = saved(sizes.where((F.col("size") > ENOUGH) & (F.col("lo") < F.col("hi"))).select("_k", "t", "size"), "large")
        if large.isEmpty():
            break
        again = inside.join(F.broadcast(large) if few else large.hint("merge"), ["_k", "t"])
        at = asked.join(large.hint("merge"), ["_k", "t"]).select("_k", "t", "h", "below", ((F.floor("h") - F.col("below")) / F.col("size")).alias("at"))
        sketch = again.groupBy("_k", "t").agg(F.percentile_approx("v", F.array(*(F.lit(i / 500) for i in range(501))), F.lit(10 * ACCURACY)).alias("p"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        place = F.floor(F.col("at") * 500).cast("int")
        ends = at.join(sketch.hint("merge"), ["_k", "t"]).select("_k", "t", "h", F.when(place < 2, F.col("lo")).otherwise(F.get("p", place - 1)).alias("a"), F.when(place > 497, F.col("hi")).otherwise(F.get("p", place + 2)).alias("b"))
        ends = saved(ends, "ends")
        part = again.join(F.broadcast(ends) if few else ends.hint("merge"), ["_k", "t"])
        seen = part.groupBy("_k", "t", "h", "a", "b").agg(F.count_if(F.expr("v < a")).alias("less"), F.count_if(F.expr("v <= b")).alias("upto"))
        seen = saved(seen.join(asked.select("_k", "t", "below").hint("merge"), ["_k", "t"]).where((F.col("below") + F.col("less") <= F.floor("h")) & (F.ceil("h") < F.col("below") + F.col("upto")) & (F.col("upto") - F.col("less") <= 0.5 * F.col("upto") + ENOUGH / 2)), "seen")
        if seen.isEmpty():
            break
        new = seen.select("_k", "t", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("less").alias("_less"))
        inside = saved(inside.join(F.broadcast(new) if few else new.hint("merge"), ["_k", "t"], "left").where("_a is null or (v >= _a and v <= _b)").select("_k", "t", "v"), "inside")
        asked = saved(asked.join(new.hint("merge"), ["_k", "t"], "left").select("_k", "t", "h", "a", "b", (F.col("below") + F.coalesce("_less", F.lit(0))).alias("below")), "asked")
    counts = inside.groupBy("_k", "t", "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_k", "t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    placed = counts.join(asked.hint("merge"), ["_k", "t"])
    first = F.min(F.when(F.col("below") + F.col("upto") > F.floor("h"), F.col("v")))
    second = F.min(F.when(F.col("below") + F.col("upto") > F.ceil("h"), F.col("v")))
    share = F.col("h") - F.floor("h")
    found = placed.groupBy("_k", "t", "h").agg(first.alias("v"), second.alias("w")).withColumn("q", F.when(F.col("v") == F.col("w"), F.col("v")).otherwise((1 - share) * F.col("v") + share * F.col("w")))
    wide = found.groupBy("_k").agg(*(F.max(F.when(F.col("t") == i, F.col("q"))).alias(n) for i, n in enumerate(names)))
    out = base.select(*group).join(wide.hint("merge"), "_k", "left")
    return out.select(*(F.col(f"_k.{k}").alias(k) for k in keys), *names)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """All rows with ``name``, the place (from 0) among the rows of the same keys in the given order. The order has to tell rows
    apart; nulls come first. Rows are written once, so select the columns that are needed before."""
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    d = saved(d, "placed")
    part = F.shiftright("_at", 33)
    runs = d.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = saved(runs.select(*(F.col(k).alias(f"_{k}") for k in keys), "_part", (F.coalesce(ahead, F.lit(0)) - F.col("_first")).alias("_shift")), "runs")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), part == F.col("_part"))
    few = runs.count() <= SENT
    return d.join(F.broadcast(runs) if few else runs.hint("merge"), same).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
