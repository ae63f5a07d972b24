"""Components of point clouds by a graph of cells, so that dense places cost no pairs of points.

Cells are so small that any two points of one are within reach of each other: a cell is one node. Two cells, of which each has at most
124 near enough, are linked if their closest points are within reach. That is decided by the boxes round their points: boxes that
are near as a whole link, boxes that are far don't. What lies between is compared point by point where both have few points, and
else halved along each axis and looked at again. So a dense cell is met as sums by cell and part, never as pairs of all its points.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ
from pointloom.functions.shared import saved
from pointloom.operators.graph import components

#: Half of the offsets at which a cell may be within reach; the other half is seen from the other side.
FORWARD = [o for o in itertools.product(range(-2, 3), repeat=3) if o > (0, 0, 0)]
#: Pairs of points up to which two parts are compared point by point, not halved again.
FEW = 1024
#: The side of a cell, in reaches: its diagonal is a hair less than one.
SIDE = (1 - 1e-6) / math.sqrt(3)
GROUP = ("scene_id", "label")
AT = ("ix", "iy", "iz")


def boxes(points: DataFrame, *keys: str) -> DataFrame:
    """Of each key's points the number, the least id and the box."""
    held = [F.sum("points").alias("points")] if "points" in points.columns else []
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("point_id").alias("least"), *held, *(f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))))


def squares(parts: list[Column]) -> Column:
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def judged(pairs: DataFrame, r: float) -> DataFrame:
    """Pairs of boxes (alo.., ahi.., blo.., bhi..) that may be within ``r``; near: all their points are."""
    side = lambda k: {c: F.col(f"{k}{c}") for c in XYZ}
    alo, ahi, blo, bhi = side("alo"), side("ahi"), side("blo"), side("bhi")
    least = squares([F.greatest(alo[c] - bhi[c], blo[c] - ahi[c], F.lit(0.0)) for c in XYZ])
    most = squares([F.greatest(ahi[c] - blo[c], bhi[c] - alo[c]) for c in XYZ])
    return pairs.where(least < r * r).withColumn("near", most < r * r)


def sided(df: DataFrame, side: str, key: str, *more: str | Column) -> DataFrame:
    return df.select(*more, F.col(key).alias(side), F.col("n").alias(f"{side}n"), *(F.col(f"{e}{c}").alias(f"{side}{e}{c}") for c in XYZ for e in ("lo", "hi")))


def part(level: int) -> list[Column]:
    """The part of its cell that a point is in, the cell being halved ``level`` times."""
    return [F.floor(F.col(f"u{c}") * 2.0**level).cast("long").alias(i) for c, i in zip(XYZ, AT, strict=True)] if level else []


def met(few: DataFrame, points: DataFrame, level: int, r: float) -> DataFrame:
    """(a, b) of those pairs of parts, with few points each, that have two points nearer than ``r``."""
    keys = AT if level else ()
    for side in "ab":
        own = points.select(F.col("cell").alias(side), *(k.alias(f"{side}{i}") for k, i in zip(part(level), AT, strict=False)), *(F.col(c).alias(f"{side}{c}") for c in XYZ))
        few = few.join(own.hint("merge"), [side, *(f"{side}{i}" for i in keys)])
    return few.where(squares([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ]) < r * r).select("a", "b").distinct()


def cell_links(points: DataFrame, cells: DataFrame, r: float) -> DataFrame:
    """(a, b): cells, named by their least points, whose closest points are nearer than ``r``."""
    one = sided(cells, "a", "least", *GROUP, *AT).withColumn("o", F.explode(F.array(*(F.array(*map(F.lit, o)) for o in FORWARD))))
    for k, c in enumerate(AT):
        one = one.withColumn(c, F.col(c) + F.col("o")[k])
    pairs = one.drop("o").join(sided(cells, "b", "least", *GROUP, *AT).hint("merge"), [*GROUP, *AT]).drop(*GROUP, *AT)
    level, links = 0, None
    while True:
        pairs = saved(judged(pairs, r), "cell-pairs")
        names = [f"{s}{i}" for s in "ab" for i in AT] if level else []
        unsure = pairs.where("not near")
        few = met(unsure.where(F.col("an") * F.col("bn") <= FEW).select("a", "b", *names), points, level, r)
        found = saved(pairs.where("near").select("a", "b").unionByName(few).distinct(), "cell-links")
        links = found if links is None else links.unionByName(found)
        left = unsure.where(F.col("an") * F.col("bn") > FEW).select("a", "b", *names)
        left = saved(left.join(found.hint("merge"), ["a", "b"], "left_anti"), "cell-left")  # one hit decides a pair of cells
        if left.isEmpty():
            return links
        level += 1
        ends = left.select(F.col("a").alias("cell")).unionByName(left.select(F.col("b").alias("cell"))).distinct()
        inside = points.join(ends.hint("merge"), "cell", "left_semi")
        parts = saved(boxes(inside.select("cell", "point_id", *XYZ, *part(level)), "cell", *AT), "cell-parts")
        for side in "ab":
            child = sided(parts, side, "cell", *(F.col(i).alias(f"new{side}{i}") for i in AT), *(F.shiftright(i, 1).alias(f"{side}{i}") for i in AT if level > 1))
            left = left.join(child.hint("merge"), [side, *(f"{side}{i}" for i in AT if level > 1)])
        pairs = left.drop(*names).withColumnsRenamed({f"new{s}{i}": f"{s}{i}" for s in "ab" for i in AT})


def cluster_components(df: DataFrame, r: float, min_points: int = 1, label: str = "segment") -> DataFrame:
    """(point_id, component): points of one label that chains of steps shorter than ``r`` connect, in one scene; the component is
    its least point. Components with fewer points than ``min_points`` get null. Points with label -1 take no part. Points of one place
    are one row, which only meets them again with its component."""
    every = df.where(F.col(label) >= 0).select("scene_id", F.col(label).alias("label"), "point_id", *(F.col(c).cast("double").alias(c) for c in XYZ))
    spots = saved(every.groupBy(*GROUP, *XYZ).agg(F.min("point_id").alias("point_id"), F.count("*").alias("points")), "spots")
    d = spots.select("*", *((F.col(c) / (SIDE * r)).alias(f"u{c}") for c in XYZ))
    d = d.select("*", *(F.floor(f"u{c}").cast("long").alias(i) for c, i in zip(XYZ, AT, strict=True)))
    cells = saved(boxes(d, *GROUP, *AT), "cells")
    named = saved(d.join(cells.select(*GROUP, *AT, F.col("least").alias("cell")).hint("merge"), [*GROUP, *AT]).select(*GROUP, "point_id", "cell", *XYZ, *(f"u{c}" for c in XYZ)), "cell-points")
    roots = components(cell_links(named, cells, r)).select(F.col("node").alias("cell"), "root")
    rooted = cells.select(F.col("least").alias("cell"), "points").join(roots.hint("merge"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    big = rooted.groupBy("root").agg(F.sum("points").alias("size"))
    of = saved(rooted.select("cell", "root").join(big.hint("merge"), "root").select("cell", F.when(F.col("size") >= min_points, F.col("root")).alias("component")), "cell-roots")
    found = saved(named.select(*GROUP, *XYZ, "cell").join(of.hint("merge"), "cell").drop("cell"), "spot-components")
    return every.join(found.hint("merge"), [*GROUP, *XYZ]).select("point_id", "component")
