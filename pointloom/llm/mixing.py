"""Mixing sources to target weights along a curriculum.

Each source has a weight and a schedule: how its rate changes over training, which runs from 0 to 1. The weights share
the tokens of the whole corpus; a source gives at most ``max_repeats`` times its own tokens and what is above is shared
again by weight. A source's schedule is integrated to its cumulative token demand; a document stands where that demand
reaches the tokens before it, so inverting the demand gives its training position. The result is range-sorted by position.

Inside a source, documents are dealt in the order of a hash, md5, which any engine has. Their running token sums are built
from sums over buckets of equal first digits, so one hot source is spread over as many tasks. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import let, numbered, scratch, word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3
#: (time, rate) knots by slot, joined by straight lines: the first slot fades out, the last fades in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def segments(knots) -> Column:
    """The integral of a piecewise linear schedule: one struct a segment, demand ``lo`` to ``hi`` scaled to end at 1."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, []
    for ((t0, r0), (t1, r1)), area in zip(zip(knots, knots[1:]), areas):
        lo, done = done / total, done + area
        out.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (("t0", t0), ("t1", t1), ("r0", r0 / total), ("r1", r1 / total), ("lo", lo), ("hi", done / total)))))
    return F.array(*out)


def invert_demand(segs: Column, share: Column) -> Column:
    """The time at which the integrated schedule reaches ``share`` (0 to 1) of its demand."""

    def solve(s: Column) -> Column:
        need, slope = share - s["lo"], (s["r1"] - s["r0"]) / (s["t1"] - s["t0"])
        root = F.sqrt(F.greatest(s["r0"] * s["r0"] + 2 * slope * need, F.lit(0.0)))
        return F.least(s["t0"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (s["r0"] + root)), s["t1"])

    return let(F.coalesce(F.filter(segs, lambda s: (share < s["hi"]))[0], F.element_at(segs, -1)), solve)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(skey, source_size, slot, target) from (skey, source, source_size). One row a source: it is as small as the list
    of sources, and sorted whole to find the level at which sources run full."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = sizes.withColumn("slot", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    w = w.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("slot") + 1))
    w = w.withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(by_fill), F.lit(0.0))
    w = w.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - before("cap")) / (F.sum("weight").over(everything) - before("weight")))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "skey", "level"))).over(everything)["level"])
    return w.select("skey", "source_size", "slot", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words that the mix takes, repeats
    counted; the pass that meets the target takes part of a document), and ``positions``, one training position per pass
    that takes at least half of the document; ``position`` is the first start, null if nothing is taken.

    Null text has no words and null sources are one source, last in order. Rows that repeat count as often as they occur;
    equal rows may exchange their places. An empty table gives an empty result. Very long texts are only counted. Columns
    besides doc_id, text and source are not used; those named in ``carry`` come along, under names that the result has not.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select("doc_id", *carry, "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, BUCKET_DIGITS), 16, 10).cast("int")),
        "mix-sizes",
    )
    buckets = written(sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = written(source_targets(buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats), "mix-sources")
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), zero).alias("ahead")).join(sources, "skey")
    d = sized.drop("source").join(starts, ["skey", "bucket"])
    d = d.withColumn("offset", F.col("ahead") + F.coalesce(F.sum("size").over(inside), zero)).withColumn("goal", F.round("target").cast("long"))
    parts = [F.greatest(zero, F.least(F.col("size"), F.col("goal") - k * F.col("source_size") - F.col("offset"))) for k in range(max_repeats)]
    segs = F.element_at(F.array(*map(segments, schedules)), F.col("slot") % len(schedules) + 1)
    when = lambda k: invert_demand(segs, (F.col("offset") + k * F.col("source_size")) / F.greatest(F.col("goal"), F.lit(1)))
    at = F.filter(F.array(*(F.when((2 * part >= F.col("size")) & (part > 0), when(k)) for k, part in enumerate(parts))), lambda x: x.isNotNull())
    out = d.select("doc_id", *carry, "size", "source_size", "target", sum(parts[1:], parts[0]).alias("taken"), F.when(parts[0] > 0, when(0)).alias("position"), at.alias("positions"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them, in training order: one row for each whole pass (a last pass counts if it takes
    at least half of the document). Rows are told apart by a number of their own, so those that repeat or share an id, and
    those without one, all take part. An empty table gives no rows."""
    whole = numbered(docs, "mix-documents")
    with scratch(docs.sparkSession):
        plan = mix(whole.select("row", "doc.doc_id", "doc.text", "doc.source"), carry=("row",), **how)
        plan = written(plan.select("row", F.explode("positions").alias("position")), "mix-plan", keep=True)
    return whole.join(plan.hint("merge"), "row").orderBy("position", "row").select("doc.*")
