"""Queries of feature-space algebra, sources, streams and pipelines."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.functions.shared import shared_dir
from pointloom.operators import aggregate as A
from pointloom.operators import boxes as B
from pointloom.operators import linalg as L
from pointloom.plans.pipeline import Pipeline
from pointloom.plans.q_aggregate import PAIR, features_b, view_feats
from pointloom.plans.registry import query, rounded
from pointloom.sources import readers
from pointloom.streaming import running


def pairs(t):
    return t.features.select("point_id", F.col("feat").alias("x")).join(features_b(t).select("point_id", F.slice("feat", 1, 8).alias("y")), "point_id")


def table(t, m: np.ndarray):
    return t.spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


@query("j1_gram", "select a.pos i, b.pos j, round(sum(a.v*b.v),6)+0 v from long_features a join long_features b on a.point_id=b.point_id and a.pos<=b.pos group by 1,2")
def _(t):
    return rounded(L.gram(t.features).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}))


@query("j1_cross_sums", "select a.pos i, b.pos j, round(sum(a.v*b.v),6)+0 v from long_features a join long_features b on a.point_id=b.point_id group by 1,2")
def _(t):
    return rounded(table(t, L.cross_sums(t.features)[0]))


@query("j2_grid_svd")
def _(t):
    c = A.as_vectors(A.vector_mean(t.features, ["scene_id", "segment"]), ["scene_id", "segment"]).join(t.features.groupBy("scene_id", "segment").agg(F.count("*").alias("n")), ["scene_id", "segment"])
    return rounded(L.grid_svd(c, (4, 8, 16))[2])


@query("j3_svd_spectrum")
def _(t):
    return rounded(L.svd_spectrum(t.features, 64))


MOMENTS = "select round(sum(case when i = j then v end), 6) energy, round(sum(v*v), 6) square from (select a.pos i, b.pos j, sum(a.v*b.v{w}) v from {t} a join {t} b on a.point_id=b.point_id group by 1,2) g"


def moments(t, s):
    """The sums of the second and fourth powers of all singular values, which are traces of the Gram matrix and of its square."""
    return rounded(t.spark.createDataFrame([(float((s**2).sum()), float((s**4).sum()))], "energy double, square double"))


@query("j3_spectrum_moments", MOMENTS.format(t="long_features", w=""))
def _(t):
    return moments(t, L.singular(t.features)[0])


@query("j2_weighted_moments", "with m as (select scene_id*100+segment point_id, pos, avg(v) v, count(*) n from long_features group by 1,2) " + MOMENTS.format(t="m", w="*a.n"))
def _(t):
    c = A.as_vectors(A.vector_mean(t.features, ["scene_id", "segment"]), ["scene_id", "segment"]).join(t.features.groupBy("scene_id", "segment").agg(F.count("*").alias("n")), ["scene_id", "segment"])
    return moments(t, L.singular(c, weight="n")[0])


@query("j20_basis_energy", "select count(distinct point_id) n, round(sum(v*v),6) total, true exact, true orthogonal from long_features")
def _(t):
    """What a basis keeps and what it leaves add up to all energy, and it keeps the share that it states."""
    v, share = L.shared_basis(t.features, 8)
    part = L.times(t.features, v @ v.T, out="part")
    square = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    d = part.agg(F.count("*").alias("n"), square(F.col("part")).alias("kept"), square(F.zip_with("feat", "part", lambda a, b: a - b)).alias("rest"))
    exact = F.abs(F.col("kept") / (F.col("kept") + F.col("rest")) - share) < 1e-9
    return rounded(d.select("n", (F.col("kept") + F.col("rest")).alias("total"), exact.alias("exact"), F.lit(bool(np.abs(v.T @ v - np.eye(8)).max() < 1e-9)).alias("orthogonal")))


@query("j4_robust_pca")
def _(t):
    d = L.robust_pca(t.features, 5)
    return rounded(d.select("point_id", L.norm(F.col("low")).alias("low"), L.norm(F.col("sparse")).alias("sparse")))


@query("j5_fit_projection")
def _(t):
    return rounded(table(t, L.fit_projection(pairs(t))), 4)


W = "(select j, pos, cos(j*3e0+pos)/8 w from (select unnest(range(4)) j) a, (select unnest(range(64)) pos) b)"


def weights(t):
    return t.spark.createDataFrame([(j, [float(np.cos(j * 3.0 + p) / 8) for p in range(64)]) for j in range(4)], "j int, column array<double>")


@query("j6_project_features", f"select point_id, cast(j as int) j, round(sum(v*w),6)+0 v from long_features f join {W} w on f.pos=w.pos group by 1,2")
def _(t):
    return rounded(L.project_features(t.features, weights(t)).select("point_id", F.posexplode("projected").alias("j", "v")))


@query("j7_projection_quality", f"select count(*) n, round(avg(m),6) mse, round(avg(c),6) cosine, round(stddev_pop(c),6) cosine_std from (select point_id, avg((a-b)*(a-b)) m, sum(a*b)/greatest(sqrt(sum(a*a))*sqrt(sum(b*b)),1e-12) c from {PAIR} q group by 1) r")
def _(t):
    d = t.features.select("point_id", F.col("feat").alias("pred")).join(features_b(t).select("point_id", F.col("feat").alias("true")), "point_id")
    return rounded(L.projection_quality(d))


@query("j8_rotation_quality", "select count(*) n, round(avg(d),6) before, true better from (select f.point_id, sum((f.v-c.v)*(f.v-c.v)) d from long_features f join class_vectors c on c.label=f.segment and c.pos=f.pos group by 1) q")
def _(t):
    r = L.procrustes(t.features, view_feats(t))
    return rounded(L.rotation_quality(t.features, view_feats(t), r).select("n", "before", (F.col("after") <= F.col("before")).alias("better")))


@query("j8_procrustes")
def _(t):
    r = L.procrustes(t.features, view_feats(t))
    return rounded(table(t, r.T @ r))


MEANS = "(select segment, pos, avg(v) m, var_pop(v) s from long_features group by 1,2)"


@query("j9_separability", f"""with c as (select a.segment a, b.segment b, sum(a.m*b.m)/sqrt(sum(a.m*a.m)*sum(b.m*b.m)) c from {MEANS} a join {MEANS} b on a.pos=b.pos and a.segment<>b.segment group by 1,2), k as (select *, row_number() over (partition by a order by c desc, b) rn from c)
    select a segment, b nearest, round(c,6)+0 cos, round(spread,6) spread, round(between_,6) "between", round(between_/spread,6) ratio from k join (select x.a segment, avg(x.d) between_ from (select a.segment a, b.segment b, sqrt(sum((a.m-b.m)*(a.m-b.m))) d from {MEANS} a join {MEANS} b on a.pos=b.pos and a.segment<>b.segment group by 1,2) x group by 1) w on w.segment=k.a join (select segment, sqrt(sum(s)) spread from {MEANS} m group by 1) p on p.segment=k.a where rn=1""")
def _(t):
    return rounded(L.separability(t.features))


@query("j9_centroid_cosines", f"select a.segment a, b.segment b, round(sum(a.m*b.m)/sqrt(sum(a.m*a.m)*sum(b.m*b.m)),6)+0 cos from {MEANS} a join {MEANS} b on a.pos=b.pos and a.segment<b.segment group by 1,2")
def _(t):
    return rounded(L.centroid_cosines(t.features))


@query("j10_silhouette", """with p as (select a.point_id, a.segment, b.segment c, b.point_id o, 1-sum(a.v*b.v)/sqrt(sum(a.v*a.v)*sum(b.v*b.v)) d from long_features a join long_features b on a.pos=b.pos and a.point_id<>b.point_id group by 1,2,3,4), m as (select point_id, segment, c, avg(d) d from p group by 1,2,3),
    s as (select point_id, max(case when c=segment then d end) a, min(case when c<>segment then d end) b from m group by 1) select count(*) n, round(avg(case when a is null then 0 else (b-a)/greatest(a,b) end),6)+0 silhouette from s""")
def _(t):
    return rounded(L.silhouette(t.features))


@query("j11_jm_gaussian")
def _(t):
    d = t.features.withColumn("feat", F.slice("feat", 1, 8))
    return rounded(L.jm_gaussian(d))


@query("j12_jm_histogram", """with x as (select point_id, segment, sqrt(sum(w*w)) x from (select point_id, segment, pos, v*(1+pos % 3) w from long_features) q group by 1,2), e as (select quantile_cont(x,0.001) lo, quantile_cont(x,0.999) hi from x),
    b as (select segment, least(floor((x-lo)/greatest(hi-lo,1e-12)*31),30) bin, count(*) n from x, e where x between lo and hi group by 1,2), p as (select segment, bin, n/sum(n) over (partition by segment) p from b), k as (select distinct segment from p),
    s as (select a.segment a, b.segment b, sum(sqrt(a.p*b.p)) c from p a join p b on a.bin=b.bin and a.segment<b.segment group by 1,2) select a.segment a, b.segment b, round(sqrt(2*greatest(1-coalesce(c,0),0)),6)+0 jm from k a join k b on a.segment<b.segment left join s on s.a=a.segment and s.b=b.segment""")
def _(t):
    return rounded(L.jm_histogram(t.features.withColumn("feat", F.transform("feat", lambda v, i: v * (1 + i % 3)))))


JM_AXES = """, e as (select axis, quantile_cont(x,0.001) lo, quantile_cont(x,0.999) hi from x group by 1), b as (select x.axis, segment, least(floor((x-lo)/greatest(hi-lo,1e-12)*31),30) bin, count(*) n from x join e on e.axis=x.axis where x between lo and hi group by 1,2,3),
    p as (select axis, segment, bin, n/sum(n) over (partition by axis, segment) p from b), k as (select distinct axis, segment from p), s as (select a.axis, a.segment a, b.segment b, sum(sqrt(a.p*b.p)) c from p a join p b on a.axis=b.axis and a.bin=b.bin and a.segment<b.segment group by 1,2,3),
    j as (select a.segment a, b.segment b, coalesce(c,0) c, sqrt(2*greatest(1-coalesce(c,0),0)) jm from k a join k b on a.axis=b.axis and a.segment<b.segment left join s on s.axis=a.axis and s.a=a.segment and s.b=b.segment)
    select a, b, round({mean},6)+0 jm, round(sqrt(2*greatest(1-exp(avg(ln(greatest(c,1e-12)))),0)),6)+0 geometric, round(sqrt(2*greatest(1-exp(sum(ln(greatest(c,1e-12)))),0)),6)+0 product from j group by 1,2"""


@query("j12_jm_dimensions", "with x as (select segment, pos axis, v x from long_features)" + JM_AXES.replace("{mean}", "sqrt(2*greatest(1-avg(c),0))"))
def _(t):
    return rounded(L.jm_histogram(t.features, mode="dimensions"))


@query("j12_jm_projections", "with x as (select point_id, segment, axis, sum(v*(2*cast('0x' || substr(md5('0|' || axis || '|' || pos),1,8) as bigint)/4294967296e0-1)) x from long_features, (select unnest(range(8)) axis) r group by 1,2,3)" + JM_AXES.replace("{mean}", "avg(jm)"))
def _(t):
    return rounded(L.jm_histogram(t.features, mode="projections"))


@query("j13_cross_scene_similarity", "select a.segment, a.scene_id a, b.scene_id b, round(sum(a.v*b.v)/(count(*)/64e0),6)+0 cos from (select *, v/sqrt(sum(v*v) over (partition by point_id)) u from long_features) a0, long_features a join long_features b on a.pos=b.pos group by 1,2,3".replace("from (select *, v/sqrt(sum(v*v) over (partition by point_id)) u from long_features) a0, long_features a join long_features b on a.pos=b.pos group by 1,2,3", "from u a join u b on a.segment=b.segment and a.pos=b.pos and a.scene_id<b.scene_id group by 1,2,3").replace("select a.segment", "with u as (select point_id, scene_id, segment, pos, v/sqrt(sum(v*v) over (partition by point_id)) v from long_features) select a.segment", 1))
def _(t):
    return rounded(L.cross_scene_similarity(t.features))


@query("j13_cross_scene_means", "with m as (select scene_id, segment, pos, avg(v) v from long_features group by 1,2,3) select a.segment, a.scene_id a, b.scene_id b, round(sum(a.v*b.v)/sqrt(sum(a.v*a.v)*sum(b.v*b.v)),6)+0 cos from m a join m b on a.segment=b.segment and a.pos=b.pos and a.scene_id<b.scene_id group by 1,2,3")
def _(t):
    return rounded(L.cross_scene_similarity(t.features, "means"))


@query("j14_dataset_drift", f"with a as {MEANS.replace('from long_features', 'from long_features where scene_id % 2 = 0')}, b as {MEANS.replace('from long_features', 'from long_features where scene_id % 2 = 1')} select a.segment, round(sum(a.m*b.m)/sqrt(sum(a.m*a.m)*sum(b.m*b.m)),6)+0 cos, round(avg(abs(a.m-b.m)),6) mean_drift, round(avg(abs(sqrt(a.s)-sqrt(b.s))),6) std_drift from a join b on a.segment=b.segment and a.pos=b.pos group by 1")
def _(t):
    return rounded(L.dataset_drift(t.features.where("scene_id % 2 = 0"), t.features.where("scene_id % 2 = 1")))


@query("j15_compare_subspaces")
def _(t):
    return rounded(L.compare_subspaces(L.scene_bases(t.features, 4), 4))


@query("j16_codebook")
def _(t):
    return rounded(L.codebook(t.features, 8, 4).select("code", F.posexplode("feat").alias("pos", "v")), 4)


@query("j16_codebook_two_level")
def _(t):
    return L.codebook_two_level(t.features, 4, 3, 3)


@query("j17_encode_codebook", "select point_id, label code, round(e,6) error from (select f.point_id, c.label, sum((f.v-c.v)*(f.v-c.v)) e, row_number() over (partition by f.point_id order by round(sum((f.v-c.v)*(f.v-c.v)),12), c.label) rn from long_features f join class_vectors c on f.pos=c.pos group by 1,2) q where rn=1")
def _(t):
    return rounded(L.encode_codebook(t.features, view_feats(t).withColumnRenamed("label", "code")))


@query("j17_decode_codebook", "select p_partkey point_id, pos, round(v,6)+0 v from part join class_vectors on label = p_size % 10")
def _(t):
    d = L.decode_codebook(t.part.select(F.col("p_partkey").alias("point_id"), (F.col("p_size") % 10).alias("code")), view_feats(t).withColumnRenamed("label", "code"))
    return rounded(d.select("point_id", F.posexplode("feat").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")))


@query("j18_pca_colors")
def _(t):
    return L.pca_colors(t.features)


@query("j19_fit_projection_ridge")
def _(t):
    w, b = L.fit_projection_ridge(pairs(t))
    return rounded(table(t, np.vstack([w, b])), 4)


@query("j20_shared_basis")
def _(t):
    v, share = L.shared_basis(t.features, 8)
    return rounded(table(t, v.T @ v).withColumn("share", F.lit(share)))


@query("c4_crop_obb", """with b as (select scene_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from ref_points where x < 25 and z > 2 group by 1)
    select point_id from points p join b on b.scene_id=p.scene_id where x between lx-0.50000037 and hx+0.50000037 and y between ly-0.50000037 and hy+0.50000037 and z between lz-0.50000037 and hz+0.50000037""")
def _(t):
    """Reference points with the corners of their bounds, all turned: the smallest box is the one whose axes are turned alike."""
    ref = t.ref_points.where("x < 25 and z > 2").select("scene_id", *C.XYZ)
    b = ref.groupBy("scene_id").agg(*(F.array(F.min(c), F.max(c)).alias(c) for c in C.XYZ))
    for c in C.XYZ:
        b = b.withColumn(c, F.explode(c))
    return B.crop_obb(turned(t.points), turned(ref.unionByName(b)), 0.50000037).select("point_id")


def turned(df):
    """Turned by arctan 4/3 round z, then by arctan 3/4 round x."""
    x, y, z = F.col("x") * 0.6 - F.col("y") * 0.8, F.col("x") * 0.8 + F.col("y") * 0.6, F.col("z")
    return df.withColumns({"x": x, "y": y * 0.8 - z * 0.6, "z": y * 0.6 + z * 0.8})


@query("a1_read_points", "select point_id, scene_id, x, y, z, segment from points where split = 'val'")
def _(t):
    path = f"{shared_dir(t.spark)}/points-{uuid.uuid4().hex}"
    t.points.write.partitionBy("split", "scene_id").parquet(path)
    return readers.read_points(t.spark, path, "val", ["point_id", "scene_id", "x", "y", "z", "segment"])


@query("a9_predictions", "select point_id, cast(case when pred between 0 and 4 then pred*100 else -1 end as int) pred, cast(case when segment between 0 and 4 then segment*100 else -1 end as int) runner_up from points")
def _(t):
    m = t.region.select(F.col("r_regionkey").alias("class"), (F.col("r_regionkey") * 100).alias("id"))
    d = readers.predictions(t.points.withColumn("topk", F.array("pred", "segment")), m)
    return d.select("point_id", "pred", F.col("topk")[1].alias("runner_up"))


@query("a10_scene_meta", "select scene_id, sum(k) points, count(*) cells from (select scene_id, floor(x/2), floor(y/2), floor(z/2), count(*) k from points group by 1,2,3,4) q group by 1".replace("sum(k) points", "cast(sum(k) as bigint) points"))
def _(t):
    path = f"{shared_dir(t.spark)}/meta-{uuid.uuid4().hex}"
    readers.write_scene_meta(t.points, 2.0, path)
    return t.spark.read.schema("scene_id int, points long, cells long").json(path)


@query("a11_concat_datasets", "select cast(loop as int) loop, count(*) n, count(segment) labelled from (select segment from points union all select null from ref_points) q, (select unnest([1,2,3]) loop) l group by 1")
def _(t):
    d = readers.concat_datasets([t.points.select("point_id", "segment"), t.ref_points.select(F.col("ref_id").alias("point_id"))], 3)
    return d.groupBy("loop").agg(F.count("*").alias("n"), F.count("segment").alias("labelled"))


@query("a12_assign_split", "select point_id, case when scene_id between 5 and 6 then 'val' when scene_id = 7 then 'test' else 'train' end split from points")
def _(t):
    return readers.assign_split(t.points.drop("split"), [("val", 5, 6), ("test", 7, 7)]).select("point_id", "split")


@query("a14_holdout", "select frame_id, (row_number() over (partition by device order by frame_id)-1) % 8 = 0 held, row_number() over (partition by device order by md5('0|' || frame_id), frame_id) <= 3 drawn from frames")
def _(t):
    d = readers.holdout(t.frames.withColumn("scene_id", F.col("device")), 8, name="frame_id")
    d = readers.holdout(d.withColumnRenamed("held", "every8"), 3, "draw", name="frame_id")
    return d.select("frame_id", F.col("every8").alias("held"), F.col("held").alias("drawn"))


def streamed(t, df, by, f):
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return running.drained(f(running.replay(df, f"{path}/in", 5, by)), path)


@query("l1_stream_confusion", "select segment gt, pred, count(*) n from points where segment <> -1 group by 1,2")
def _(t):
    return streamed(t, t.points.select("point_id", "segment", "pred"), "point_id", running.stream_confusion)


@query("l2_stream_gram", "select a.pos i, b.pos j, round(sum(a.v*b.v),6)+0 v from long_features a join long_features b on a.point_id=b.point_id group by 1,2")
def _(t):
    path = f"{shared_dir(t.spark)}/gram-{uuid.uuid4().hex}"
    s = running.replay(pairs(t), f"{path}-in", 3, "point_id")
    s.writeStream.foreachBatch(running.stream_gram(path)).option("checkpointLocation", f"{path}-at").trigger(availableNow=True).start().awaitTermination()
    return rounded(table(t, running.gram_state(t.spark, path)[0]))


@query("l3_stream_meter", "select name, round(sum(value*(1+iteration % 3))/sum(1+iteration % 3),6) mean, cast(sum(1+iteration % 3) as bigint) n from metrics group by 1")
def _(t):
    return rounded(streamed(t, t.metrics.withColumn("n", 1 + F.col("iteration") % 3), "iteration", running.stream_meter))


@query("l4_stream_history", "select name, max(iteration) iteration, round(avg(value),6) mean, round(median(value),6) median from (select *, row_number() over (partition by name order by iteration desc) rn from metrics) q where rn <= 20 group by 1")
def _(t):
    path = f"{shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    d = running.drained(running.stream_history(running.replay(t.metrics, f"{path}/in", 5, "iteration"), 20), path, "update")
    return rounded(d.groupBy("name").agg(F.max_by(F.struct("iteration", "mean", "median"), "seen").alias("s")).select("name", "s.*"))


@query("l5_stream_dim_corr", f"select pos, count(*) n, round(corr(a,b),6) corr from {PAIR} q group by 1")
def _(t):
    return rounded(streamed(t, A.paired(t.features, features_b(t)), "point_id", running.stream_dim_corr))


@query("l6_stream_votes", "select point, class, round(sum(weight),9) w from contrib group by 1,2")
def _(t):
    return rounded(streamed(t, t.contrib, "view", running.stream_votes), 9)


@query("m1_pipeline", "with q as (select *, row_number() over (partition by scene_id, floor((x+1)/2), floor(y/2), floor(z/2) order by point_id) rn from points where valid) select point_id, x+1 x, 7 tag, segment label0 from q where rn=1")
def _(t):
    p = Pipeline([("filter_valid", {}), ("shift", {"dx": 1.0}), ("voxel_sample", {"size": 2.0}), ("set", {"tag": 7}), ("copy", {"label0": "segment"})])
    return p(t.points).select("point_id", "x", "tag", "label0")


