"""Feature-space algebra: sums of small matrices over all rows in Spark, their solution on the driver.

Only D x D (or r x r) matrices reach the driver, whatever the number of rows. Signs of vectors are fixed by making the largest
component positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cosine, dot, norm
from pointloom.functions.shared import saved
from pointloom.operators.order import quantiles
from pointloom.operators.pairs import block_pairs, stacked

BLOCK = 512


def cross_sums(df: DataFrame, left: str = "feat", right: str | None = None, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(X'WY, X'W1, Y'W1, sum W) over all rows. Each task adds up its Arrow batches and sends one matrix, and equal blocks of
    rows of these matrices are added in Spark."""
    rest = [F.col(right or left).cast("array<double>").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.array(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (0, 1))
            w = np.array(b.column(2))
            part = np.hstack([x, np.ones((len(x), 1))]).T @ (np.hstack([y, np.ones((len(y), 1))]) * w[:, None])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = df.select(F.col(left).cast("array<double>").alias("x"), *rest).mapInArrow(run, "i int, v array<double>")
    summed = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    if not summed.num_rows:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0
    i, j, v = (np.array(summed.column(c)) for c in ("i", "j", "v"))
    m = np.zeros((i.max() + 1, j.max() + 1))
    m[i, j] = v
    return m[:-1, :-1], m[:-1, -1], m[-1, :-1], float(m[-1, -1])


def gram(df: DataFrame, feat: str = "feat", weight: str | None = None, keys=()) -> DataFrame:
    """(keys, i, j, v): sums of weighted products of components, long form, for small D; one shuffle with partial sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    a = df.select(*keys, w.alias("_w"), feat, F.posexplode(feat).alias("i", "_a"))
    return a.select(*keys, "i", "_w", "_a", F.posexplode(feat).alias("j", "_b")).where("i <= j").groupBy(*keys, "i", "j").agg(F.sum(F.col("_w") * F.col("_a") * F.col("_b")).alias("v"))


def fixed_signs(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)


def basis(g: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of a symmetric matrix."""
    s, v = np.linalg.eigh(g)
    order = np.argsort(-s)[:r]
    return np.maximum(s[order], 0), fixed_signs(v[:, order])


def times(df: DataFrame, m: np.ndarray, feat: str = "feat", out: str = "feat", shift: np.ndarray | None = None) -> DataFrame:
    """Rows times a matrix (D x r), plus a shift, in Arrow batches."""
    base = np.zeros(m.shape[1]) if shift is None else shift

    @F.pandas_udf("array<double>")
    def mul(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ m + base)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(out, mul(F.col(feat)))


def triangle(df: DataFrame, feat: str = "feat", weight: str | None = None, fan: int = 16) -> np.ndarray:
    """R of the QR decomposition of all rows, times the roots of their weights: each task turns its batches into one triangle, and
    ``fan`` triangles into one until one is left. R'R is X'WX, but the products are never formed, so small singular values keep
    their digits. Rows x D in, at most D x D out; an empty table gives no rows."""
    rows = df.select(F.col(feat).cast("array<double>").alias("x"), F.sqrt(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).flatten()).reshape(b.num_rows, -1) * np.array(b.column(1))[:, None]
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(r), pa.int64()), pa.array(list(r), pa.list_(pa.float64()))], names=["part", "v"])

    def together(t: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1), mode="r")
        return pa.table({"part": pa.array([t["part"][0].as_py()] * len(r), pa.int64()), "v": pa.array(list(r), pa.list_(pa.float64()))})

    parts = saved(rows.mapInArrow(own, "part long, v array<double>"), "triangles")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = saved(parts.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInArrow(together, "part long, v array<double>"), "triangles")
    found = parts.toArrow()
    return np.array(found["v"].combine_chunks().flatten()).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 0))


def singular(df: DataFrame, feat: str = "feat", weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of the rows, largest first, and the right vectors (D x D)."""
    r = triangle(df, feat, weight)
    _, s, vt = np.linalg.svd(r)
    return np.pad(s, (0, len(vt) - len(s))), fixed_signs(vt.T) if len(vt) else vt


def grid_svd(cells: DataFrame, ranks) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Weighted truncated SVD of cell features (feat, n; weight sqrt(n)): scores of the largest rank, the basis, and per rank
    the energy share and the relative error (rank, energy, error)."""
    s, v = singular(cells, weight="n")
    v, e, total = v[:, : max(ranks)], s * s, max(float((s * s).sum()), 1e-300)
    rows = [(int(r), float(e[:r].sum() / total), float(np.sqrt(e[r:].sum() / total))) for r in ranks]
    return times(cells, v, out="code"), v, cells.sparkSession.createDataFrame(rows, "rank int, energy double, error double")


def svd_spectrum(df: DataFrame, r: int) -> DataFrame:
    """(k, s, energy, error): singular values, cumulative energy and relative error of each rank."""
    s, _ = singular(df)
    e, total = np.cumsum(s * s), max(float((s * s).sum()), 1e-300)
    rest = np.append(np.cumsum((s * s)[::-1])[::-1], 0)[1:]
    rows = [(k + 1, float(s[k]), float(e[k] / total), float(np.sqrt(rest[k] / total))) for k in range(min(r, len(s)))]
    return df.sparkSession.createDataFrame(rows, "k int, s double, energy double, error double")


def robust_pca(df: DataFrame, iters: int = 10, tol: float = 1e-6, lam: float | None = None, weight: str | None = None) -> DataFrame:
    """point_id, low and sparse with feat = low + sparse + a small rest: inexact augmented Lagrangian. Each round needs one
    weighted Gram matrix; rows are thresholded in place and written out."""
    n = df.count()
    d = df.select("point_id", F.col("feat").cast("array<double>").alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    g, _, _, _ = cross_sums(d, "x", weight="w")
    dim, top = len(g), float(np.sqrt(np.linalg.eigvalsh(g)[-1]))
    lam = lam or 1 / np.sqrt(max(n, dim))
    mu, size = 1.25 / top, float(np.sqrt(np.trace(g)))
    peak = d.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    scale = max(top, peak / lam)
    zeros = F.array_repeat(F.lit(0.0), dim)
    state = saved(d.withColumns({"y": F.transform("x", lambda v: v / scale), "sparse": zeros, "low": zeros}), "rpca")
    add = lambda a, b, k: F.zip_with(a, b, lambda p, q: p + k * q)
    for _ in range(iters):
        state = state.withColumn("z", add(add("x", "sparse", -1.0), "y", 1 / mu))
        g, _, _, _ = cross_sums(state, "z", weight="w")
        s, v = np.linalg.eigh(g)
        s = np.sqrt(np.maximum(s, 0))
        shrink = (v * (np.maximum(s - 1 / mu, 0) / np.maximum(s, 1e-300))) @ v.T
        state = times(state, shrink, "z", "low")
        gap = F.zip_with(add("x", "low", -1.0), "y", lambda p, q: p + q / mu)
        state = state.withColumn("sparse", F.transform(gap, lambda t: F.signum(t) * F.greatest(F.abs(t) - lam / mu, F.lit(0.0))))
        state = state.withColumn("rest", add(add("x", "low", -1.0), "sparse", -1.0)).withColumn("y", add("y", "rest", mu))
        state = saved(state.select("point_id", "x", "w", "y", "sparse", "low", "rest"), "rpca")
        left = state.agg(F.sqrt(F.sum(F.col("w") * dot(F.col("rest"), F.col("rest"))))).first()[0]
        if left <= tol * size:
            break
        mu *= 1.5
    return state.select("point_id", "low", "sparse")


def fit_projection(pairs: DataFrame, reg: float = 1e-3) -> np.ndarray:
    """W (D x r) of least squares with ridge from rows (x, y)."""
    xx, _, _, _ = cross_sums(pairs, "x")
    xy, _, _, _ = cross_sums(pairs, "x", "y")
    return np.linalg.solve(xx + reg * np.eye(len(xx)), xy)


def fit_projection_ridge(pairs: DataFrame, reg: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Ridge with intercept: (W, bias), on centred sums."""
    xx, sx, _, n = cross_sums(pairs, "x")
    xy, _, sy, _ = cross_sums(pairs, "x", "y")
    w = np.linalg.solve(xx - np.outer(sx, sx) / n + reg * np.eye(len(xx)), xy - np.outer(sx, sy) / n)
    return w, sy / n - sx / n @ w


def project_features(df: DataFrame, w: DataFrame, feat: str = "feat") -> DataFrame:
    """Rows times a matrix given as rows (j, column array): a broadcast of D x r numbers and built-in expressions."""
    cols = w.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "column"))), lambda x: x["column"]).alias("_w"))
    return df.join(F.broadcast(cols)).withColumn("projected", F.transform("_w", lambda c: dot(F.col(feat), c))).drop("_w")


def projection_quality(d: DataFrame) -> DataFrame:
    """MSE, mean and deviation of the cosine of (pred, true)."""
    mse = F.aggregate(F.zip_with("pred", "true", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("pred")
    c = cosine(F.col("pred"), F.col("true"))
    return d.agg(F.count("*").alias("n"), F.avg(mse).alias("mse"), F.avg(c).alias("cosine"), F.stddev_pop(c).alias("cosine_std"))


def procrustes(df: DataFrame, class_vectors: DataFrame) -> np.ndarray:
    """The rotation R (determinant 1) that brings features nearest to the vector of their class. Sums by class come first, so
    the product needs one row per class. df: segment, feat; class_vectors: label, feat."""
    sums = df.select("segment", F.posexplode("feat").alias("pos", "v")).groupBy("segment", "pos").agg(F.sum("v").alias("v"))
    vec = sums.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("s"))
    m, _, _, _ = cross_sums(vec.join(class_vectors.select(F.col("label").alias("segment"), F.col("feat").alias("t")).hint("merge"), "segment"), "s", "t")
    u, _, vt = np.linalg.svd(m)
    flip = np.ones(len(m))
    flip[-1] = np.sign(np.linalg.det(u @ vt))
    return (u * flip) @ vt


def separability(df: DataFrame) -> DataFrame:
    """Per class: its nearest other class by the cosine of centroids, the spread of its rows about the centroid, and the ratio of
    the mean distance to the other centroids to that spread."""
    m = df.select("segment", F.posexplode("feat").alias("pos", "v")).groupBy("segment", "pos").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    side = lambda a: m.select(F.col("segment").alias(a), "pos", F.col("m").alias(f"m{a}"))
    c = side("a").join(side("b").hint("merge"), "pos").where("a <> b").groupBy("a", "b").agg((F.sum(F.col("ma") * F.col("mb")) / F.sqrt(F.sum(F.col("ma") * F.col("ma")) * F.sum(F.col("mb") * F.col("mb")))).alias("cos"))
    best = c.withColumn("_at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))).where("_at = 1").select(F.col("a").alias("segment"), F.col("b").alias("nearest"), "cos")
    apart = side("a").join(side("b").hint("merge"), "pos").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))).alias("d"))
    apart = apart.groupBy(F.col("a").alias("segment")).agg(F.avg("d").alias("between"))
    spread = m.groupBy("segment").agg(F.sqrt(F.sum("s")).alias("spread"))
    return best.join(spread, "segment").join(apart, "segment").withColumn("ratio", F.col("between") / F.greatest("spread", F.lit(1e-12)))


def centroid_cosines(df: DataFrame) -> DataFrame:
    """(a, b, cos) of all class means, a < b."""
    m = df.select("segment", F.posexplode("feat").alias("pos", "v")).groupBy("segment", "pos").agg(F.avg("v").alias("m"))
    side = lambda a: m.select(F.col("segment").alias(a), "pos", F.col("m").alias(f"m{a}"))
    p = lambda x, y: F.sum(F.col(x) * F.col(y))
    return side("a").join(side("b").hint("merge"), "pos").where("a < b").groupBy("a", "b").agg((p("ma", "mb") / F.sqrt(p("ma", "ma") * p("mb", "mb"))).alias("cos"))


def rotation_quality(df: DataFrame, class_vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """Mean squared distance and mean cosine of the rows to the vectors of their classes, before and after a rotation."""
    d = times(df.select("segment", "feat"), rotation, out="after").join(class_vectors.select(F.col("label").alias("segment"), F.col("feat").alias("t")), "segment")
    gap = lambda c: F.avg(F.aggregate(F.zip_with(c, "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return d.agg(F.count("*").alias("n"), gap("feat").alias("before"), gap("after").alias("after"), F.avg(cosine(F.col("feat"), F.col("t"))).alias("cosine_before"), F.avg(cosine(F.col("after"), F.col("t"))).alias("cosine_after"))


def silhouette(df: DataFrame) -> DataFrame:
    """Mean silhouette by cosine distance, over all rows: the mean distance to a class follows from its sum of unit vectors."""
    u = df.select("point_id", "segment", F.transform("feat", lambda x: x / F.greatest(norm(F.col("feat")), F.lit(1e-12))).alias("u"))
    s = u.select("segment", F.posexplode("u").alias("pos", "v")).groupBy("segment", "pos").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    c = s.groupBy(F.col("segment").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("s"), F.max("n").alias("n"))
    d = u.join(F.broadcast(c)).withColumn("p", dot(F.col("u"), F.col("s")))
    own = F.col("c") == F.col("segment")
    d = d.withColumn("dist", F.when(own, 1 - (F.col("p") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(1 - F.col("p") / F.col("n")))
    r = d.groupBy("point_id", "segment").agg(F.max(F.when(own, F.col("dist"))).alias("a"), F.min(F.when(~own, F.col("dist"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    return r.agg(F.count("*").alias("n"), F.avg(F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).alias("silhouette"))


def class_sums(df: DataFrame, shift: np.ndarray) -> DataFrame:
    """(segment, i, j, v): per class X'X of the features less ``shift``, with a last column of ones. Tasks add up one matrix a
    class and hand them on when they hold many numbers, so rows of a large class are never brought together."""
    d = len(shift) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["segment", "i", "v"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1) - shift
            x, label = np.hstack([x, np.ones((len(x), 1))]), np.array(batch.column(0))
            for k in np.unique(label):
                part = x[label == k]
                held[int(k)] = held.get(int(k), 0) + part.T @ part
                if len(held) * d * d > 1 << 24:
                    yield from out()
        yield from out()

    rows = df.select(F.col("segment").cast("long"), F.col("feat").cast("array<double>")).where("segment >= 0 and feat is not null")
    parts = rows.mapInArrow(run, "segment long, i int, v array<double>")
    return parts.select("segment", "i", F.posexplode("v").alias("j", "v")).groupBy("segment", "i", "j").agg(F.sum("v").alias("v"))


def jm_gaussian(df: DataFrame, min_rows: int = 10, reg: float = 1e-10) -> DataFrame:
    """(a, b, jm): Jeffries-Matusita distance, 0 to sqrt(2), of Gaussian classes (labels from 0 on) with more than ``min_rows``
    rows. Covariances are those of samples, with ``reg`` on the diagonal. Determinants are taken as logarithms, without a floor.
    Rows without features take no part. Classes are compared block against block; none reaches the driver."""
    mean = [r.m for r in df.where("segment >= 0").select(F.posexplode("feat").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]

    def solve(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        size = int(d["j"].max()) + 1
        m = np.zeros((size, size))
        m[d["i"], d["j"]] = d["v"]
        n, first = m[-1, -1], m[-1, :-1]
        if n <= min_rows:
            return pd.DataFrame({"segment": [], "mean": [], "cov": []}, dtype=object)
        cov = (m[:-1, :-1] - np.outer(first, first) / n) / (n - 1) + reg * np.eye(size - 1)
        return pd.DataFrame({"segment": [key[0]], "mean": [first / n], "cov": [cov.ravel()]})

    def compare(one: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        size = len(one["mean"].iloc[0])
        own, far, out = stacked(one["cov"], size, size), one["mean"].iloc[0], []
        own_det = np.linalg.slogdet(own)[1]
        step = max(1, (1 << 20) // (size * size))
        for k in range(0, len(more), step):  # some matrices at a time
            part = more.iloc[k : k + step]
            cov, gap = stacked(part["cov"], size, size), stacked(part["mean"], size) - far
            both = (cov + own) / 2
            term = (gap * np.linalg.solve(both, gap[:, :, None])[:, :, 0]).sum(1) / 8
            dist = term + (np.linalg.slogdet(both)[1] - (np.linalg.slogdet(cov)[1] + own_det) / 2) / 2
            out.append(np.sqrt(2 * np.maximum(0, -np.expm1(-dist))))
        return pd.DataFrame({"a": int(one["segment"].iloc[0]), "b": more["segment"].to_numpy(), "jm": np.concatenate(out)})

    forms = class_sums(df, np.array(mean)).groupBy("segment").applyInPandas(solve, "segment long, mean array<double>, cov array<double>")
    return block_pairs(forms, "segment", "cov", compare, "a long, b long, jm double").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "jm")


def jm_histogram(df: DataFrame, bins: int = 32, mode: str = "norm", projections: int = 8, seed: int = 0) -> DataFrame:
    """(a, b, jm) from histograms of single numbers per row: ``bins`` edges between the 0.1 and 99.9 percentiles give one bin
    less, and values outside are left out. ``norm`` takes the length of features; ``dimensions`` each component, and
    ``projections`` seeded random directions. A distance is the root of 2 (1 - overlap), 0 to sqrt(2); jm takes the mean overlap of
    dimensions, and of projections the mean distance, geometric and product the geometric mean and the product of overlaps."""
    from pointloom.functions.columns import drawn

    if mode == "norm":
        d = df.select("segment", F.lit(0).alias("axis"), norm(F.col("feat")).alias("x"))
    elif mode == "dimensions":
        d = df.select("segment", F.posexplode("feat").alias("axis", "x"))
    else:
        at = F.transform("feat", lambda v, i: v * (2 * drawn(seed, F.col("axis"), i) - 1))
        d = df.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(projections - 1)))).select("segment", "axis", F.aggregate(at, F.lit(0.0), lambda s, x: s + x).alias("x"))
    d = saved(d, "axes") if mode != "norm" else d
    ends = quantiles(d, ["axis"], {"lo": ("x", 0.001), "hi": ("x", 0.999)})
    d = d.join(ends.hint("merge"), "axis").where("x >= lo and x <= hi")
    b = F.least(F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * (bins - 1)), F.lit(bins - 2))
    h = d.groupBy("axis", "segment", b.alias("bin")).agg(F.count("*").alias("n"))
    h = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("axis", "segment")))
    side = lambda a: h.select("axis", F.col("segment").alias(a), "bin", F.col("p").alias(f"p{a}"))
    k = h.select("axis", "segment").distinct()
    pairs = k.withColumnRenamed("segment", "a").join(k.withColumnRenamed("segment", "b"), "axis").where("a < b")
    s = side("a").join(side("b").hint("merge"), ["axis", "bin"]).where("a < b").groupBy("axis", "a", "b").agg(F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("bc"))
    far = lambda bc: F.sqrt(2 * F.greatest(1 - bc, F.lit(0.0)))
    each = pairs.join(s.hint("merge"), ["axis", "a", "b"], "left").select("a", "b", F.coalesce("bc", F.lit(0.0)).alias("bc"))
    if mode == "norm":
        return each.select("a", "b", far(F.col("bc")).alias("jm"))
    log = F.log(F.greatest("bc", F.lit(1e-12)))
    mean = far(F.avg("bc")) if mode == "dimensions" else F.avg(far(F.col("bc")))
    return each.groupBy("a", "b").agg(mean.alias("jm"), far(F.exp(F.avg(log))).alias("geometric"), far(F.exp(F.sum(log))).alias("product"))


def cross_scene_similarity(df: DataFrame, mode: str = "pairs") -> DataFrame:
    """(segment, a, b, cos) of classes across scenes: ``pairs`` is the mean over all pairs of rows, exactly, as the product of
    mean unit vectors; ``means`` is the cosine of class means."""
    f = F.transform("feat", lambda x: x / F.greatest(norm(F.col("feat")), F.lit(1e-12))) if mode == "pairs" else F.col("feat")
    m = df.select("scene_id", "segment", F.posexplode(f).alias("pos", "v")).groupBy("scene_id", "segment", "pos").agg(F.avg("v").alias("v"))
    side = lambda a: m.select(F.col("scene_id").alias(a), "segment", "pos", F.col("v").alias(f"v{a}"))
    j = side("a").join(side("b").hint("merge"), ["segment", "pos"]).where("a < b").groupBy("segment", "a", "b")
    p = F.sum(F.col("va") * F.col("vb"))
    return j.agg((p if mode == "pairs" else p / F.sqrt(F.sum(F.col("va") * F.col("va")) * F.sum(F.col("vb") * F.col("vb")))).alias("cos"))


def dataset_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per class of both sets: cosine of the means, and mean absolute drift of mean and deviation over dimensions."""
    def m(d: DataFrame, n: str) -> DataFrame:
        return d.select("segment", F.posexplode("feat").alias("pos", "v")).groupBy("segment", "pos").agg(F.avg("v").alias(f"m{n}"), F.stddev_pop("v").alias(f"s{n}"))

    j = m(a, "a").join(m(b, "b").hint("merge"), ["segment", "pos"]).groupBy("segment")
    return j.agg((F.sum(F.col("ma") * F.col("mb")) / F.sqrt(F.sum(F.col("ma") * F.col("ma")) * F.sum(F.col("mb") * F.col("mb")))).alias("cos"), F.avg(F.abs(F.col("ma") - F.col("mb"))).alias("mean_drift"), F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("std_drift"))


def scene_bases(df: DataFrame, r: int) -> DataFrame:
    """(scene_id, basis, s): the first ``r`` axes of every scene as one array, from its Gram matrix."""
    g = gram(df, keys=("scene_id",))

    def solve(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        n = int(d["j"].max()) + 1
        m = np.zeros((n, n))
        m[d["i"], d["j"]] = m[d["j"], d["i"]] = d["v"]
        s, v = basis(m, r)
        return pd.DataFrame({"scene_id": [key[0]], "basis": [v.ravel()], "s": [np.sqrt(s)]})

    return g.groupBy("scene_id").applyInPandas(solve, "scene_id int, basis array<double>, s array<double>")


def compare_subspaces(bases: DataFrame, r: int) -> DataFrame:
    """(a, b, ...): principal angles of scene bases: mean angle, Grassmann distance, similarity, and how the spectra differ.
    Scenes are compared block against block: one matrix product meets a basis with all those of the other block."""

    def compare(one: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        va, vb = stacked(one["basis"], -1, r)[0], stacked(more["basis"], -1, r)
        meet = (va.T @ np.moveaxis(vb, 0, 1).reshape(len(va), -1)).reshape(r, len(more), r).transpose(1, 0, 2)
        c = np.clip(np.linalg.svd(meet, compute_uv=False), 0, 1)
        angle = np.arccos(c)
        p, q = stacked(one["s"], r), stacked(more["s"], r)
        p, q = p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
        x, y = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            kl, correlation = (p * np.log(p / q)).sum(1), (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) if r > 1 else np.ones(len(more))
        return pd.DataFrame({
            "a": one["scene_id"].iloc[0], "b": more["scene_id"].to_numpy(), "mean_angle": angle.mean(1), "grassmann": np.sqrt((angle**2).sum(1)), "similarity": (c**2).mean(1),
            "kl": kl, "emd": np.abs(np.cumsum(p - q, axis=1)).sum(1), "stability": np.abs(np.diagonal(meet, axis1=1, axis2=2)).mean(1), "correlation": correlation,
        })

    return block_pairs(bases, "scene_id", "basis", compare, "a int, b int, mean_angle double, grassmann double, similarity double, kl double, emd double, stability double, correlation double")


def encode_codebook(df: DataFrame, centres: DataFrame, metric: str = "l2", keep: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """The columns of ``keep``, code and error: nearest centre (code, feat), ties to the lowest. Rows without features, and all
    rows if there are no centres, have neither. The centres, k rows by the codebook's size, pass the driver and go to each executor
    once; rows meet them some at a time, so that a task's memory depends on neither number."""
    found = centres.select("code", F.col("feat").cast("array<double>")).orderBy("code").toArrow()
    codes = found.column("code").combine_chunks()
    table = df.sparkSession.sparkContext.broadcast((codes, np.array(found.column("feat").combine_chunks().flatten()).reshape(len(codes), -1) if len(codes) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, m = table.value
        for batch in batches:
            own = np.flatnonzero(batch.column(len(keep)).is_valid().to_numpy(zero_copy_only=False)) if len(codes) else np.empty(0, np.int64)
            code, error = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            x = np.array(batch.column(len(keep)).drop_null().flatten()).reshape(len(own), -1) if len(own) else None
            step = max(1, (1 << 20) // max(1, m.size)) if len(own) else 1
            for i in range(0, len(own), step):
                gap = x[i : i + step, None] - m
                d = np.round((gap * gap if metric == "l2" else np.abs(gap)).sum(2), 12)
                code[own[i : i + step]] = d.argmin(1)
                error[own[i : i + step]] = d.min(1)
            none = np.ones(batch.num_rows, bool)
            none[own] = False
            picked = codes.take(pa.array(code, mask=none)) if len(codes) else pa.nulls(batch.num_rows, codes.type)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), picked, pa.array(error, mask=none)], names=[*keep, "code", "error"])

    rows = df.select(*keep, F.col("feat").cast("array<double>").alias("_f"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, f"code {centres.schema['code'].dataType.simpleString()}", "error double"]))


def decode_codebook(coded: DataFrame, centres: DataFrame) -> DataFrame:
    return coded.join(centres, "code").select("point_id", "code", "feat")


def codebook(df: DataFrame, k: int, rounds: int = 8, metric: str = "l2") -> DataFrame:
    """(code, feat): k-means centres (mean update) or k-medians (L1). Starts at the rows of least draw; every round is one
    pass with partial sums, only k centres are kept."""
    from pointloom.operators.sampling import draw

    start = df.select(draw(0).alias("d"), "feat").orderBy("d").limit(k).withColumn("code", (F.row_number().over(Window.orderBy("d")) - 1).cast("int")).select("code", "feat")
    centres = saved(start, "centres")
    for _ in range(rounds):
        near = encode_codebook(df, centres, metric, ("feat",)).where("code is not null").select("code", F.posexplode("feat").alias("pos", "v"))
        m = near.groupBy("code", "pos").agg((F.avg("v") if metric == "l2" else F.percentile_approx("v", 0.5, 10000)).alias("v"))
        new = m.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("feat"))
        centres = saved(new.unionByName(centres.join(new, "code", "left_anti")), "centres")
    return centres


def codebook_two_level(df: DataFrame, k: int, leaf_k: int, rounds: int = 6) -> DataFrame:
    """point_id, code, leaf: a root codebook, then for each root its own leaves, all roots in the same passes. Leaf centres are
    joined on the root, so no row meets another root's."""
    from pointloom.operators.sampling import draw

    rooted = saved(encode_codebook(df, codebook(df, k, rounds), keep=("point_id", "feat")).select("point_id", "feat", "code"), "rooted")
    leaf = rooted.withColumn("leaf", (F.row_number().over(Window.partitionBy("code").orderBy(draw(1), "point_id")) - 1).cast("int")).where(F.col("leaf") < leaf_k).select("code", "leaf", F.col("feat").alias("c"))
    d2 = F.aggregate(F.zip_with("feat", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    for turn in range(rounds + 1):
        listed = leaf.groupBy("code").agg(F.collect_list(F.struct("leaf", "c")).alias("_l"))
        best = rooted.join(listed, "code").withColumn("_x", F.explode("_l")).select("point_id", "feat", "code", "_x.leaf", "_x.c").withColumn("_d", F.round(d2, 12))
        near = saved(best.groupBy("point_id", "code").agg(F.min_by(F.struct("leaf", "feat"), F.struct("_d", "leaf")).alias("b")).select("point_id", "code", "b.leaf", "b.feat"), "leaves")
        if turn == rounds:
            return near.select("point_id", "code", "leaf")
        m = near.select("code", "leaf", F.posexplode("feat").alias("pos", "v")).groupBy("code", "leaf", "pos").agg(F.avg("v").alias("v"))
        leaf = saved(m.groupBy("code", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("c")), "leaf-centres")


def pca_colors(df: DataFrame, limit: float = 3.5) -> DataFrame:
    """point_id, r, g, b: the first three axes, outliers by the median absolute deviation left out of the range, 0 - 255."""
    g, s, _, n = cross_sums(df)
    _, v = basis(g / n - np.outer(s / n, s / n), 3)
    d = saved(times(df.select("point_id", "feat"), v, out="p").select("point_id", *(F.col("p")[k].alias(f"p{k}") for k in range(3))), "pca")
    d = d.join(F.broadcast(quantiles(d, [], {f"m{k}": (f"p{k}", 0.5) for k in range(3)})))
    gaps = d.select(*(F.abs(F.col(f"p{k}") - F.col(f"m{k}")).alias(f"g{k}") for k in range(3)))
    d = d.join(F.broadcast(quantiles(gaps, [], {f"a{k}": (f"g{k}", 0.5) for k in range(3)})))
    inside = lambda k: F.when(F.abs(F.col(f"p{k}") - F.col(f"m{k}")) <= limit * 1.4826 * F.col(f"a{k}"), F.col(f"p{k}"))
    e = d.agg(*(f(inside(k)).alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))))
    code = lambda k: (F.least(F.greatest((F.col(f"p{k}") - F.col(f"lo{k}")) / F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}"), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return d.join(F.broadcast(e)).select("point_id", *(code(k).alias(c) for k, c in enumerate("rgb")))


def shared_basis(df: DataFrame, r: int) -> tuple[np.ndarray, float]:
    """One uncentred basis over every row of every scene, with the share of energy that it explains."""
    s, v = singular(df)
    return v[:, :r], float((s[:r] ** 2).sum() / (s**2).sum())
