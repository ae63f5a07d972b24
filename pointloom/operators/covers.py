"""Covers by crops, in rounds that decide first points all over a scene at once. Crops are worked out in tiles inside tasks; of each,
only its limit and the later candidates that it holds leave the task, until the crops themselves are the result.

Space is cut into cells, each level's twice as wide as those of the level below. A point's level is the lowest at which its cell
and the 26 around it hold a crop's points, so its crop ends within a tile's width (four cells) and meets its tile and the 26 around
it only. A group is what is in a block of 4 x 4 x 4 tiles, with the tiles around it where crops are looked for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import XYZ
from pointloom.functions.shared import saved
from pointloom.operators.balls import laid_out
from pointloom.operators.order import placed

FINE, CELL, TILE, BLOCK = (tuple(f"{c}{i}" for i in range(3)) for c in "fcta")
#: The lowest level has at most so many cells with points for each crop of disjoint points.
CELLS = 64
#: Undecided points of a tile that are looked at in a round: so many, and four for each crop of disjoint points.
FEW = 12
#: Added to orders of points before the centre, so that they come after all others.
BEHIND = 1 << 62


def up(names, by: str, to) -> list:
    """Cells ``by`` levels higher."""
    return [F.expr(f"shiftright({a}, cast({by} as int))").alias(b) for a, b in zip(names, to)]


def around(names) -> list:
    """A struct for each of the 27 cells around and with a cell, as one array column's items."""
    return [F.struct(*((F.col(c) + s).alias(c) for c, s in zip(names, (i, j, k)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def levels(d: DataFrame, box: DataFrame, n: int) -> DataFrame:
    """(scene_id, cell of the finest grid, lev): the level of each cell with points."""
    fine = saved(d.groupBy("scene_id", *FINE).agg(F.count("*").alias("_n")), "fine")
    tall = fine.join(F.broadcast(box.select("scene_id", "_top", "_all")), "scene_id").withColumn("lev", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    cells = saved(tall.groupBy("scene_id", "lev", *up(FINE, "lev", CELL)).agg(F.sum("_n").alias("_n"), F.first("_all").alias("_all"), F.first("_top").alias("_top")), "cells")
    low = cells.groupBy("scene_id", "lev").agg(F.count("*").alias("_cells"), F.first("_all").alias("_all"), F.first("_top").alias("_top"))
    low = low.where(f"_cells <= {CELLS} * ceil(_all / {n}) or lev = _top").groupBy("scene_id").agg(F.min("lev").alias("_low"))
    cells = cells.join(F.broadcast(low), "scene_id").where("lev >= _low")
    sums = cells.select("scene_id", "lev", "_n", F.explode(F.array(*around(CELL))).alias("c")).groupBy("scene_id", "lev", *(F.col(f"c.{c}").alias(c) for c in CELL)).agg(F.sum("_n").alias("_sum"))
    full = saved(cells.select("scene_id", "lev", *CELL, "_top").join(sums.hint("merge"), ["scene_id", "lev", *CELL]).where(f"_sum >= {n} or lev = _top").select("scene_id", "lev", *CELL), "full")
    keys = tall.select("scene_id", *FINE, "lev", *up(FINE, "lev", CELL))
    return keys.join(full.hint("merge"), ["scene_id", "lev", *CELL]).groupBy("scene_id", *FINE).agg(F.min("lev").alias("lev"))


class Grid:
    """Points in cells of a width, to find those in a box round a point."""

    def __init__(self, xyz: np.ndarray, width: float):
        self.low, self.width = xyz.min(0), width
        at = np.floor((xyz - self.low) / width).astype(np.int64)
        self.last = at.max(0)
        key = (at[:, 0] * (self.last[1] + 1) + at[:, 1]) * (self.last[2] + 1) + at[:, 2]
        self.order = np.argsort(key, kind="stable")
        self.key, self.xyz = key[self.order], np.ascontiguousarray(xyz[self.order].T)

    def near(self, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in the grid's order of all points within ``r``, and of some others, and squared distances."""
        r = r * (1 + 1e-6) + 1e-6 * self.width
        lo = np.maximum(np.floor((p - self.low - r) / self.width), 0)
        hi = np.minimum(np.floor((p - self.low + r) / self.width), self.last)
        if (hi < lo).any():
            return np.empty(0, np.int64), np.empty(0)
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        rows = ((np.arange(lo[0], hi[0] + 1)[:, None] * (self.last[1] + 1) + np.arange(lo[1], hi[1] + 1)) * (self.last[2] + 1)).ravel()
        start = np.searchsorted(self.key, rows + lo[2])
        at = laid_out(start, np.searchsorted(self.key, rows + hi[2], side="right") - start)[1]
        return at, gaps(self.xyz[:, at], p)


def gaps(xyz: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances, always added up in the same order, so that they can be compared for equality."""
    x, y, z = xyz[0] - p[0], xyz[1] - p[1], xyz[2] - p[2]
    return x * x + y * y + z * z


def behind(o: np.ndarray, own: int) -> np.ndarray:
    """The order of points that are equally far: the centre's own, those after it, those before it."""
    return o - own + np.where(o < own, BEHIND, 0)


def held(d2: np.ndarray, o: np.ndarray, own: int, far: float, last: int) -> np.ndarray:
    """Which points are in a crop that ends at the squared distance ``far``, there with the point ``behind`` as ``last``."""
    return (d2 < far) | (d2 == far) & (behind(o, own) <= last)


def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(t["o"], dtype=np.int64), np.stack([np.asarray(t[c], dtype=float) for c in XYZ], axis=1) if len(t) else np.empty((0, 3))


def limits(n: int, names: list[str]):
    """For each own candidate of a group: where its crop ends, and the later candidates that it holds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        o, xyz = columns(left)
        own = np.flatnonzero(np.asarray(left["own"], dtype=bool)) if len(left) else []
        out = {c: [] for c in ("far", "last", "holds")}
        if len(own):
            ids, places = columns(right)
            width = float(left["width"][0].as_py())
            grid = Grid(places, width / 2)
            ids = ids[grid.order]
        for k in own:
            for reach in (1.0, 1.4, 2.0, 2.8, 4.0):
                at, d2 = grid.near(xyz[k], reach * width)
                some = d2 <= (reach * width) ** 2
                if np.count_nonzero(some) >= n:
                    break
            at, d2, far, last = at[some], d2[some], np.inf, BEHIND * 2 - 1
            if len(at) >= n:
                far = np.partition(d2, n - 1)[n - 1]
                last = int(np.sort(behind(ids[at[d2 == far]], o[k]))[n - np.count_nonzero(d2 < far) - 1])
            out["far"].append(float(far))
            out["last"].append(last)
            out["holds"].append(o[(o > o[k]) & held(gaps(xyz.T, xyz[k]), o, o[k], far, last)])
        out = [pa.array(out["far"], pa.float64()), pa.array(out["last"], pa.int64()), pa.array(out["holds"], pa.list_(pa.int64()))]
        return pa.table([left[c].take(pa.array(own, pa.int64())) for c in names] + out, names=[*names, "far", "last", "holds"])

    return run


def accepted(t: pa.Table) -> pa.Table:
    """Of a scene's candidates, in order, those that are surely centres: none before them that is one, or may be one, holds them.
    What is late may be held by a point that is not among the candidates."""
    o, late, out, gone, open_ = np.asarray(t["o"], dtype=np.int64), np.asarray(t["late"], dtype=bool), [], set(), set()
    holds = t["holds"].combine_chunks()
    for k in np.argsort(o):
        if int(o[k]) not in gone:
            sure = not late[k] and int(o[k]) not in open_
            (gone if sure else open_).update(holds[int(k)].as_py())
            if sure:
                out.append(k)
    return t.select(["scene_id", "o"]).take(pa.array(out, pa.int64()))


def met(centres: DataFrame, points: DataFrame, box: DataFrame, run, schema) -> DataFrame:
    """Groups of points, each point in one, with all centres whose crops reach into the group's block."""
    groups = saved(points.select("scene_id", "lev", *BLOCK).distinct(), "groups")
    there = groups.select("scene_id", F.col("lev").alias("_lev")).distinct()
    d = centres.drop("lev").join(F.broadcast(box), "scene_id").withColumn("_r", F.least(F.sqrt("far") * (1 + 1e-6) + F.col("_size") * 1e-6, F.col("_size") * F.expr("shiftleft(2L, _top)")))
    d = d.join(F.broadcast(there), "scene_id").withColumnRenamed("_lev", "lev")
    ends = lambda c, sign: F.expr(f"cast(shiftright(greatest(0L, least(shiftleft(1L, _top) - 1, floor(({c} - _{c} {sign} _r) / _size))), lev + 4) as int)")
    for c, a in zip(XYZ, BLOCK):
        d = d.withColumn(a, F.explode(F.sequence(ends(c, "-"), ends(c, "+"))))
    keys = ["scene_id", "lev", *BLOCK]
    d = d.join(groups.hint("merge"), keys, "left_semi").select(*keys, *centres.drop("scene_id", "lev").columns, (F.col("_size") * F.expr("shiftleft(1L, lev)")).alias("width"))
    return d.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(run, schema)


def free(names: list[str]):
    """The points of a group that are no centres and that no crop of an earlier centre holds; a later one's does not count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            gone, own, o = np.zeros(len(right), bool), columns(left)[0], columns(right)[0]
            for k, at in crops(left, right):
                gone[at[o[at] >= own[k]]] = True
            right = right.filter(pa.array(~gone))
        return right.select(names)

    return run


def crops(left: pa.Table, right: pa.Table):
    """Each centre's row and the rows of the points that its crop holds."""
    own, centre = columns(left)
    o, xyz = columns(right)
    grid = Grid(xyz, float(left["width"][0].as_py()))
    o = o[grid.order]
    far, last = np.asarray(left["far"], dtype=float), np.asarray(left["last"], dtype=np.int64)
    for k in range(len(own)):
        at, d2 = grid.near(centre[k], min(np.sqrt(far[k]), 1e300))
        yield k, grid.order[at[held(d2, o[at], own[k], far[k], last[k])]]


def listed(left: pa.Table, right: pa.Table) -> pa.Table:
    """scene_id, crop and point_id of all points of a group, for each crop that holds them."""
    some = list(crops(left, right)) if len(left) and len(right) else []
    at = pa.array(np.concatenate([np.empty(0, np.int64), *(x for _, x in some)]), pa.int64())
    crop = np.repeat([k for k, _ in some], [len(x) for _, x in some]).astype(np.int64)
    return pa.table([right["scene_id"].take(at), left["crop"].take(pa.array(crop)), right["point_id"].take(at)], names=["scene_id", "crop", "point_id"])


def sphere_cover(df: DataFrame, n: int, lot: int, drawn) -> DataFrame:
    """``sampling.sphere_cover`` with its draws."""
    kinds = dict(df.dtypes)
    d = df.select("scene_id", "point_id", *(F.col(c).cast("double").alias(c) for c in XYZ)).where(" and ".join(f"abs({c}) < double('infinity')" for c in XYZ) + " and scene_id is not null")
    d = saved(placed(d.withColumn("_draw", drawn), ["scene_id"], ["_draw", "point_id"], "o").drop("_draw"), "ordered")
    box = d.groupBy("scene_id").agg(F.greatest(*(F.max(c) - F.min(c) for c in XYZ)).alias("_edge"), F.count("*").alias("_all"), *(F.min(c).alias(f"_{c}") for c in XYZ))
    # the finest cells are a quarter as wide as a crop of evenly spread points on a surface; cells of level _top hold a scene
    top = F.ceil(F.log2(4 * F.sqrt(F.greatest(F.col("_all") / n, F.lit(1.0))))).cast("int")
    box = saved(box.withColumn("_top", top).withColumn("_size", F.greatest(F.expr("_edge / shiftleft(1L, _top)"), F.lit(1e-9))), "box")
    fine = [F.expr(f"cast(least(floor(({c} - _{c}) / _size), shiftleft(1L, _top) - 1) as int)").alias(f) for c, f in zip(XYZ, FINE)]
    d = d.join(F.broadcast(box), "scene_id").select("scene_id", "point_id", "o", *XYZ, *fine)
    d = d.join(levels(d, box, n).hint("merge"), ["scene_id", *FINE])
    d = saved(d.select("*", *up(FINE, "lev + 2", TILE), *up(FINE, "lev + 4", BLOCK)), "points")
    left, done = d.drop("point_id"), []
    while True:
        tile = ["scene_id", "lev", *TILE]
        count = left.groupBy(*tile).agg(F.least(F.lit(lot), FEW + 4 * F.ceil(F.count("*") / n)).alias("_due"), F.count("*").alias("_n"))
        first = left.withColumn("_at", F.row_number().over(Window.partitionBy(*tile).orderBy("o"))).where(F.col("_at") <= lot)
        first = saved(first.join(count.hint("merge"), tile).where("_at <= _due").drop("_at"), "first")
        if first.isEmpty():
            break
        # a point that may be held by one that is not looked at is late
        ends = first.groupBy(*tile).agg(F.max("o").alias("_end"), F.first("_n").alias("_n"), F.count("*").alias("_seen")).where("_n > _seen")
        ends = ends.select("scene_id", "lev", "_end", F.explode(F.array(*around(TILE))).alias("t")).groupBy("scene_id", "lev", *(F.col(f"t.{t}").alias(t) for t in TILE)).agg(F.min("_end").alias("_end"))
        there = F.broadcast(left.select("scene_id", F.col("lev").alias("_lev")).distinct().groupBy("scene_id").agg(F.collect_list("_lev").alias("_levs")))
        asked = first.select("scene_id", "o", *FINE).join(there, "scene_id").select("scene_id", "o", *FINE, F.explode("_levs").alias("lev"))
        late = asked.select("scene_id", "o", "lev", *up(FINE, "lev + 2", TILE)).join(ends.hint("merge"), tile).where("o > _end").select("scene_id", "o").distinct()
        late = late.withColumn("late", F.lit(True)).hint("merge")
        ready = saved(first.drop("_due", "_n").join(late, ["scene_id", "o"], "left").withColumn("late", F.coalesce("late", F.lit(False))), "ready")
        # tiles that the candidates of a block may reach
        wanted = saved(ready.select("scene_id", "lev", *BLOCK, F.explode(F.array(*around(TILE))).alias("t")).select("scene_id", "lev", *BLOCK, "t.*").distinct(), "wanted")
        there = F.broadcast(ready.groupBy("scene_id").agg(F.collect_set("lev").alias("_levs")))
        block = ["scene_id", "lev", *BLOCK]

        def sent(rows: DataFrame, *more) -> DataFrame:
            rows = rows.select("scene_id", "o", *XYZ, *FINE, *more).join(there, "scene_id").withColumn("lev", F.explode("_levs"))
            return rows.select("scene_id", "lev", "o", *XYZ, *more, *up(FINE, "lev + 2", TILE)).join(F.broadcast(wanted), tile).select(*(F.col(c).alias(c) for c in block), "o", *XYZ, *more)

        own = reduce(lambda x, y: x & y, (F.col(f"_{c}") == F.col(c) for c in ("lev", *BLOCK)))
        asked = sent(ready.select("*", *(F.col(c).alias(f"_{c}") for c in ("lev", *BLOCK))), "late", *(f"_{c}" for c in ("lev", *BLOCK))).withColumn("own", own).join(F.broadcast(box.select("scene_id", "_size")), "scene_id")
        asked = asked.select(*block, "o", *XYZ, "late", "own", (F.col("_size") * F.expr("shiftleft(1L, lev)")).alias("width"))
        names = ["scene_id", "lev", "o", *XYZ, "late"]
        head = f"scene_id {kinds['scene_id']}, lev int, o long, x double, y double, z double, late boolean"
        found = asked.groupBy(*block).cogroup(sent(d).groupBy(*block)).applyInArrow(limits(n, names), f"{head}, far double, last long, holds array<long>")
        found = saved(found, "limits")
        taken = found.select("scene_id", "o", "late", "holds").groupBy("scene_id").applyInArrow(accepted, f"scene_id {kinds['scene_id']}, o long")
        done.append(saved(found.drop("holds", "late").join(taken.hint("merge"), ["scene_id", "o"], "left_semi"), "taken"))
        left = saved(met(done[-1], left, box, free(left.columns), left.schema), "left")
    if not done:
        return d.select("scene_id", F.lit(0).alias("crop"), "point_id")
    centres = reduce(DataFrame.unionByName, done)
    centres = saved(placed(centres, ["scene_id"], ["o"], "crop").withColumn("crop", F.col("crop").cast("int")), "centres")
    return saved(met(centres, d, box, listed, f"scene_id {kinds['scene_id']}, crop int, point_id {kinds['point_id']}"), "crops")
