"""Queries of filters and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.operators import aggregate as A
from pointloom.operators import filters as P
from pointloom.plans.registry import query, rounded

IDX = "cast(floor({c}/2) as bigint)"
CELLS = "cast(floor(x/2) as bigint) cx, cast(floor(y/2) as bigint) cy, cast(floor(z/2) as bigint) cz"


def features_b(t):
    return t.features.withColumn("feat", F.transform("feat", lambda v, i: v * 0.9 + 0.01 * i * F.when(F.col("point_id") % 2 == 0, 1.0).otherwise(-1.0)))


FB = "(select point_id, scene_id, segment, pos, v*0.9+0.01*pos*case when point_id % 2 = 0 then 1e0 else -1e0 end v from long_features)"


@query("c1_filter_valid", "select point_id, segment from points where valid")
def _(t):
    return P.filter_valid(t.points).select("point_id", "segment")


@query("c2_filter_outliers", """with q as (select scene_id, quantile_cont(x,0.05) xl, quantile_cont(x,0.95) xh, quantile_cont(y,0.05) yl, quantile_cont(y,0.95) yh, quantile_cont(z,0.05) zl, quantile_cont(z,0.95) zh from points group by 1)
    select point_id, x between xl and xh and y between yl and yh and z between zl and zh kept from points p join q on p.scene_id = q.scene_id""")
def _(t):
    return P.filter_outliers(t.points, 0.05, 0.95).select("point_id", "kept")


@query("c2_filter_outliers_fallback", """with q as (select scene_id, median(x) xm, median(y) ym, median(z) zm, quantile_cont(x,0.05) xl, quantile_cont(x,0.95) xh, quantile_cont(y,0.05) yl, quantile_cont(y,0.95) yh, quantile_cont(z,0.05) zl, quantile_cont(z,0.95) zh from points group by 1),
    d as (select point_id, p.scene_id, x between xl and xh and y between yl and yh and z between zl and zh inside, row_number() over (partition by p.scene_id order by (x-xm)*(x-xm)+(y-ym)*(y-ym)+(z-zm)*(z-zm), point_id) rn from points p join q on p.scene_id = q.scene_id)
    select point_id, case when count(*) filter (where inside) over (partition by scene_id) < 50000 then rn <= 50000 else inside end kept from d""")
def _(t):
    return P.filter_outliers(t.points, 0.05, 0.95, 50000).select("point_id", "kept")


@query("c3_crop_aabb", """with b as (select scene_id, min(x) xl, max(x) xh, min(y) yl, max(y) yh, min(z) zl, max(z) zh from ref_points where x < 30 and z > 3 group by 1)
    select point_id from points p join b on p.scene_id = b.scene_id where x between xl-1 and xh+1 and y between yl-1 and yh+1 and z between zl-1 and zh+1""")
def _(t):
    return P.crop_aabb(t.points, t.ref_points.where("x < 30 and z > 3"), 1.0).select("point_id")


@query("c5_prune", "select point_id from points where 1/(1+exp(-opacity_logit)) >= 0.05 and greatest(exp(s0),exp(s1),exp(s2)) <= 0.2")
def _(t):
    return P.prune(C.activate(t.points)).select("point_id")


@query("c6_drop_classes", "select point_id, segment from points where segment not in (0, 3)")
def _(t):
    return P.drop_classes(t.points, (0, 3)).select("point_id", "segment")


@query("c7_common_nonzero", f"""with a as (select point_id, sqrt(sum(v*v)) n from long_features group by 1), b as (select point_id, sqrt(sum(v*v)) n from {FB} f group by 1)
    select count(*) n, count(*) filter (where a.n > 1.05) n_a, count(*) filter (where b.n > 1.05) n_b, count(*) filter (where a.n > 1.05 and b.n > 1.05) n_both from a join b using (point_id)""")
def _(t):
    return P.nonzero_counts(t.features, features_b(t), 1.05)


@query("c8_filter_pixels", "select frame, u, v, round(depth,6) depth from pixels where abs(u-320e0)/320e0/sqrt(1+depth*depth) > 0.15 and depth < 65535 and (u+v) % 5 > 0")
def _(t):
    d = t.pixels.withColumns({"dot": (F.col("u") - 320.0) / 320.0, "length": F.sqrt(1 + F.col("depth") * F.col("depth")), "segment": (F.col("u") + F.col("v")) % 5})
    return rounded(P.filter_pixels(d).select("frame", "u", "v", "depth"))


@query("c9_filter_scenes_valid", "select point_id from points where scene_id in (select scene_id from points group by 1 having avg(case when valid then 1e0 else 0 end) >= 0.5)")
def _(t):
    return P.filter_scenes_valid(t.points).select("point_id")


@query("c10_filter_boxes", "select l_orderkey, l_linenumber from lineitem where l_partkey % 3 + l_suppkey % 2 > 0")
def _(t):
    return P.filter_boxes(t.lineitem.withColumns({"lidar": F.col("l_partkey") % 3, "radar": F.col("l_suppkey") % 2})).select("l_orderkey", "l_linenumber")


@query("c11_embedding_outliers", f"""with ma as (select pos, avg(v) m from long_features group by 1), mb as (select pos, avg(v) m from {FB} f group by 1),
    da as (select point_id, sqrt(sum((v-m)*(v-m))) d from long_features join ma using (pos) group by 1), db as (select point_id, sqrt(sum((v-m)*(v-m))) d from {FB} f join mb using (pos) group by 1)
    select point_id, da.d > (select quantile_cont(d,0.95) from da) or db.d > (select quantile_cont(d,0.95) from db) outlier from da join db using (point_id)""")
def _(t):
    return P.embedding_outliers(t.features, features_b(t))


@query("c12_check_alignment", """select 'unknown_cell' rule, count(*) violations from points where l_mod % 7 = 0 union all select 'empty_cell', 0 union all select 'unknown_label', count(*) from points_l where segment > 4 union all select 'missing_xyz', 0 union all select 'mixed_cell', count(*) from (select scene_id, instance from points where segment >= 0 group by 1,2 having min(segment) < max(segment)) q
    union all select 'count_x', count(x) from points union all select 'count_segment', count(segment) from points union all select 'count_instance', count(instance) from points""".replace("points where l_mod % 7 = 0", "(select *, instance l_mod from points) p where l_mod % 7 = 0").replace("points_l", "points"))
def _(t):
    p = t.points.withColumn("grid_id", F.col("instance"))
    cells = p.where("instance % 7 <> 0").select("scene_id", "grid_id").distinct()
    labels = p.where("segment <= 4").select("segment").distinct()
    return P.check_alignment(p, cells, labels)


@query("c13_protect_classes", "select point_id, segment in (5, 6) protected from points")
def _(t):
    return P.protect_classes(t.points, (5, 6)).select("point_id", "protected")


MASKSTATS = """select view, mask, max(n) n, sqrt(sum(m*m)) mean_norm, sum(s) variance from (select scene_id view, segment mask, pos, count(*) n, avg(v) m, var_pop(v) s from long_features group by 1,2,3) q group by 1,2"""


@query("c14_filter_masks", f"select view, mask from (select *, max(n) over (partition by view) top from ({MASKSTATS}) a) b where variance <= 0.985 or n > 0.8*top")
def _(t):
    s = A.mask_stats(t.features.select(F.col("scene_id").alias("view"), F.col("segment").alias("mask"), "feat"))
    return P.filter_masks(s, 0.985).select("view", "mask")


BOUNDS = "select scene_id, count(*) n, " + ", ".join(f"min({c}) min_{c}, max({c}) max_{c}, avg({c}) mean_{c}, max({c})-min({c}) extent_{c}, (max({c})+min({c}))/2 centre_{c}" for c in "xyz") + " from points group by 1"


@query("e1_scene_bounds", "select scene_id, n, " + ", ".join(f"round({s}_{c},6) {s}_{c}" for s in ("min", "max", "mean", "extent", "centre") for c in "xyz") + f", round(sqrt(extent_x*extent_x+extent_y*extent_y+extent_z*extent_z)/2,6) radius from ({BOUNDS}) b")
def _(t):
    return rounded(A.scene_bounds(t.points))


@query("e2_recenter", f"""with b as ({BOUNDS}), c as (select p.scene_id, point_id, x-mean_x x, y-mean_y y, z-mean_z z, x-centre_x bx, y-centre_y by_, z-min_z bz from points p join b on p.scene_id = b.scene_id),
    f as (select scene_id, max(sqrt(x*x+y*y+z*z)) f from c group by 1) select point_id, round(x/f,9)+0 x, round(y/f,9)+0 y, round(z/f,9)+0 z, round(bx,9)+0 bx, round(by_,9)+0 by_, round(bz,9)+0 bz from c join f on c.scene_id = f.scene_id""")
def _(t):
    box = A.recenter(t.points, "box").select("point_id", F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("z").alias("bz"))
    return rounded(A.recenter(t.points, "unit").select("point_id", *C.XYZ).join(box, "point_id"), 9)


@query("e3_auto_contrast", "select point_id, " + ", ".join(f"round(0.5*{c}+0.5*({c}-min({c}) over w)*255e0/greatest(max({c}) over w-min({c}) over w,1),6) {c}" for c in "rgb") + " from points window w as (partition by scene_id)")
def _(t):
    return rounded(A.auto_contrast(t.points).select("point_id", "r", "g", "b"))


@query("e4_voxel_mean", f"select scene_id, cx, cy, cz, count(*) n, round(avg(x),9) x, round(avg(y),9) y, round(avg(z),9) z, min_by(segment, point_id) segment from (select *, {CELLS} from points) p group by 1,2,3,4")
def _(t):
    return rounded(A.voxel_mean(t.points, 2.0), 9)


@query("e5_vector_mean", "select scene_id, segment, cast(pos as bigint) pos, round(avg(v),6)+0 v, count(*) n from long_features group by 1,2,3")
def _(t):
    return rounded(A.vector_mean(t.features, ["scene_id", "segment"]).withColumn("pos", F.col("pos").cast("long")))


GRID = "select scene_id, sum(k) points, count(*) cells, avg(k) mean, stddev_samp(k) std, min(k) least, max(k) most, quantile_cont(k,0.5) median from (select scene_id, {c}, count(*) k from points group by 1,2,3,4) q group by 1".format(c=CELLS)


@query("e6_grid_stats", f"select scene_id, cast(points as bigint) points, cells, round(mean,6) mean, round(std,6) std, least, most, round(median,6) median, round(cells/points,6) ratio from ({GRID}) g")
def _(t):
    return rounded(A.grid_stats(t.points, 2.0))


COH = """select f.point_id, f.scene_id, f.segment, sum(f.v*m.v)/greatest(sqrt(sum(f.v*f.v))*sqrt(sum(m.v*m.v)),1e-12) cosine, sum(abs(f.v-m.v)) l1, sqrt(sum((f.v-m.v)*(f.v-m.v))) l2
    from long_features f join (select scene_id, segment, pos, avg(v) v from long_features group by 1,2,3) m on f.scene_id=m.scene_id and f.segment=m.segment and f.pos=m.pos group by 1,2,3"""


@query("e7_cell_coherence", f"select point_id, scene_id, segment, round(cosine,6) cosine, round(l1,6) l1, round(l2,6) l2 from ({COH}) q")
def _(t):
    return rounded(A.cell_coherence(t.features, ["scene_id", "segment"]))


@query("e7_pairwise_coherence", """select scene_id, segment, 1+max(k) n, round(avg(c),6)+0 cosine from (select a.scene_id, a.segment, a.point_id, b.point_id other, sum(a.v*b.v)/sqrt(sum(a.v*a.v)*sum(b.v*b.v)) c, count(*) over (partition by a.scene_id, a.segment, a.point_id) k
    from long_features a join long_features b on a.scene_id=b.scene_id and a.segment=b.segment and a.pos=b.pos and a.point_id<>b.point_id group by 1,2,3,4) q group by 1,2""")
def _(t):
    return rounded(A.pairwise_coherence(t.features, ["scene_id", "segment"]))


@query("e8_coherence_corr", f"select round(corr(cosine,l1),6) cosine_l1, round(corr(cosine,l2),6) cosine_l2, round(corr(l1,l2),6) l1_l2 from ({COH}) q")
def _(t):
    return rounded(A.coherence_corr(A.cell_coherence(t.features, ["scene_id", "segment"])))


@query("e9_rollup_scene_stats", f"""with g as (select case when scene_id % 2 = 0 then 'even' else 'odd' end dataset, mean, case when scene_id = 3 then null else std end std from ({GRID}) g)
    select dataset, count(*) scenes, count(*) filter (where mean is null or std is null) incomplete, round(avg(mean),6) mean_mean, round(stddev_pop(mean),6) std_mean, round(min(mean),6) min_mean, round(max(mean),6) max_mean, round(avg(std),6) mean_std, round(stddev_pop(std),6) std_std, round(min(std),6) min_std, round(max(std),6) max_std from g group by rollup(dataset)""")
def _(t):
    d = A.grid_stats(t.points, 2.0).select(F.when(F.col("scene_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), "mean", F.when(F.col("scene_id") != 3, F.col("std")).alias("std"))
    return rounded(A.rollup_scene_stats(d, "dataset", ["mean", "std"]))


@query("e10_class_stats", "select segment, max(n) n, round(avg(m),6)+0 mean, round(avg(s),6) std, round(sqrt(sum(m*m)),6) centroid_norm from (select segment, pos, count(*) n, avg(v) m, stddev_pop(v) s from long_features group by 1,2) q group by 1")
def _(t):
    return rounded(A.class_stats(t.features))


@query("e11_dim_profile", """select pos, round(mean,6)+0 mean, round(std,6) std, round(var,6) var, round(low,6) low, round(high,6) high, round(median,6)+0 median, zeros, negatives, nans, round(var/sum(var) over (),6) share, case when std < 1e-6 then 'dead' when abs(mean) > 10*std then 'collapsed' else 'ok' end status
    from (select pos, avg(v) mean, stddev_samp(v) std, var_samp(v) var, min(v) low, max(v) high, quantile_cont(v,0.5) median, count(*) filter (where v=0) zeros, count(*) filter (where v<0) negatives, count(*) filter (where isnan(v)) nans from long_features group by 1) q""")
def _(t):
    return rounded(A.dim_profile(t.features))


PAIR = f"(select a.point_id, a.scene_id, a.pos, a.v a, b.v b from long_features a join {FB} b on a.point_id=b.point_id and a.pos=b.pos)"


@query("e12_dim_compare", f"""select pos, count(*) n, round(avg(a),6)+0 mean_a, round(avg(b),6)+0 mean_b, round(stddev_samp(a),6) std_a, round(stddev_samp(b),6) std_b, round(avg(abs(a-b)),6) l1, round(sqrt(avg((a-b)*(a-b))),6) l2, round(max(abs(a-b)),6) largest,
    round(sum(a*b)/sqrt(sum(a*a)*sum(b*b)),6) cosine, round(corr(a,b),6) corr from {PAIR} q group by 1""")
def _(t):
    return rounded(A.dim_compare(t.features, features_b(t)))


@query("e13_feature_loss", f"select scene_id, count(*) n, round(avg(l1),6) l1, round(avg(c),6) cosine_loss from (select point_id, scene_id, avg(abs(a-b)) l1, 1-sum(a*b)/greatest(sqrt(sum(a*a))*sqrt(sum(b*b)),1e-12) c from {PAIR} q group by 1,2) r group by rollup(scene_id)")
def _(t):
    return rounded(A.feature_loss(t.features, features_b(t)))


@query("e14_snr", "select round(s,6) signal, round(n,6) noise, round(10*log10(s/n),6) snr_db from (select sum(case when pos<16 then w else 0 end) s, sum(case when pos>=16 then w else 0 end) n from (select pos, var_samp(v) w from long_features group by 1) q) r")
def _(t):
    return rounded(A.snr(t.features, 16))


@query("e14_amplification", f"select pos, round(var_samp(b)/var_samp(a),6) amplification from {PAIR} q group by 1")
def _(t):
    return rounded(A.amplification(t.features, features_b(t)))


@query("e15_variance_weights", "select pos, round(var,6) var, round(0.5+1.5*(var-min(var) over ())/(max(var) over ()-min(var) over ()),6) weight from (select pos, var_samp(v) var from long_features group by 1) q")
def _(t):
    return rounded(A.variance_weights(t.features))


@query("e16_majority_label", f"""with k as (select scene_id, {CELLS}, case when segment = -1 then null else segment end s from points), c as (select scene_id, cx, cy, cz, s, count(*) n from k group by 1,2,3,4,5),
    r as (select *, row_number() over (partition by scene_id, cx, cy, cz order by s is null, n desc, s) rn from c) select scene_id, cx, cy, cz, cast(coalesce(s,-1) as int) "label", case when s is null then 0 else n end votes from r where rn = 1""")
def _(t):
    return A.majority_label(C.cell(t.points, 2.0), ["scene_id", *A.CELL])


@query("e17_instance_boxes", """with m as (select scene_id, instance, s, row_number() over (partition by scene_id, instance order by s is null, n desc, s) rn from (select scene_id, instance, case when segment=-1 then null else segment end s, count(*) n from points group by 1,2,3) q),
    b as (select scene_id, instance, count(*) n, min(x) min_x, max(x) max_x, avg(y) mean_y from points group by 1,2)
    select b.scene_id, b.instance, n, min_x, max_x, round(mean_y*n,6) sum_y, case when s in (1,4) then -1 else coalesce(s,-1) - (case when s>1 then 1 else 0 end) - (case when s>4 then 1 else 0 end) end "label", dense_rank() over (partition by b.scene_id order by b.instance)-1 dense_id
    from b join m on b.scene_id=m.scene_id and b.instance=m.instance where rn=1""")
def _(t):
    # the sum is exact to six digits where the mean may lie on the edge of rounding
    return rounded(A.instance_boxes(t.points, (1, 4)).select("scene_id", "instance", "n", "min_x", "max_x", (F.col("mean_y") * F.col("n")).alias("sum_y"), "label", "dense_id"))


@query("e18_vote_labels", """select point, cast(case when w/total >= 0.3 then class else -1 end as int) "label", round(w/total,6) share from (select point, class, w, sum(w) over (partition by point) total, row_number() over (partition by point order by w desc, class) rn
    from (select point, class, sum(weight) w from contrib group by 1,2) a) b where rn=1""")
def _(t):
    return rounded(A.vote_labels(t.contrib, 0.3))


VIEWF = "select label as view, pos, v from class_vectors"


def view_feats(t):
    d = A.as_vectors(A.vector_mean(t.features.where("point_id % 2 = 0"), ["segment"]), ["segment"])
    return d.select(F.col("segment").alias("label"), "feat")


@query("e19_vote_labels_similarity", """with c as (select a.label view, b.label, greatest(1/(1+exp(-sum(a.v*b.v)/greatest(sqrt(sum(a.v*a.v))*sqrt(sum(b.v*b.v)),1e-12)))-0.5,0) s from class_vectors a join class_vectors b on a.pos=b.pos group by 1,2)
    select point, cast("label" as int) "label", round(w,6) votes from (select point, label, sum(weight*s) w, row_number() over (partition by point order by sum(weight*s) desc, label) rn from (select point, view % 10 view, weight from contrib) o join c on o.view=c.view group by 1,2) q where rn=1""")
def _(t):
    texts = view_feats(t)
    return rounded(A.vote_labels_similarity(t.contrib.withColumn("view", F.col("view") % 10), texts.withColumnRenamed("label", "view"), texts))


@query("e20_lift_features", """with m as (select point, pos, sum(weight*v)/sum(weight) m from (select point, view % 10 view, weight from contrib) o join class_vectors c on o.view=c.label group by 1,2)
    select point, pos, round(m/sqrt(sum(m*m) over (partition by point)),6)+0 v from m""")
def _(t):
    return rounded(A.lift_features(t.contrib.withColumn("view", F.col("view") % 10), view_feats(t).withColumnRenamed("label", "view")))


@query("e21_prune_unseen", "select p_partkey from part where p_partkey in (select point from contrib where view % 9 = 0 group by 1 having sum(weight) > 0)")
def _(t):
    return A.prune_unseen(t.part, t.contrib.where("view % 9 = 0"), "p_partkey").select("p_partkey")


@query("e22_merge_fragments", "select p_partkey point_id, round(avg(weight),9) value, count(weight) pieces from part left join (select point, weight from contrib where view % 9 = 0) c on p_partkey = point group by 1")
def _(t):
    parts = t.contrib.where("view % 9 = 0").select(F.col("point").alias("point_id"), F.col("weight").alias("value"))
    return rounded(A.merge_fragments(t.part.select(F.col("p_partkey").alias("point_id")), parts), 9)


@query("e23_cluster_language", """with k as (select distinct l_suppkey cluster, l_partkey % 10 mask from lineitem where l_partkey % 10 < l_suppkey % 4)
    select cluster, pos, round(case when count(*)>=2 then sum(v)/count(*) else 0 end,6)+0 v, count(*) n, round(avg(mask/10e0),6) score from k join class_vectors c on k.mask=c.label group by 1,2""")
def _(t):
    match = t.lineitem.where("l_partkey % 10 < l_suppkey % 4").select(F.col("l_suppkey").alias("cluster"), (F.col("l_partkey") % 10).alias("mask")).distinct().withColumn("score", F.col("mask") / 10)
    return rounded(A.cluster_language(match, view_feats(t).withColumnRenamed("label", "mask")))


@query("e24_mask_stats", f"select view, mask, n, round(mean_norm,6) mean_norm, round(variance,6) variance from ({MASKSTATS}) q")
def _(t):
    return rounded(A.mask_stats(t.features.select(F.col("scene_id").alias("view"), F.col("segment").alias("mask"), "feat")))


@query("e25_depth_scale", """with o as (select l_suppkey image, l_quantity a, l_extendedprice/1000e0 b from lineitem), m as (select image, count(*) n, median(a) ma, median(b) mb, max(b)-min(b) r from o group by 1),
    s as (select o.image, n, ma, mb, r, avg(abs(a-ma)) sa, avg(abs(b-mb)) sb from o join m on o.image=m.image group by 1,2,3,4,5)
    select image, n, round(case when n>10 and r>1e-3 then sb/sa else 1 end,6) scale, round(case when n>10 and r>1e-3 then mb-sb/sa*ma else 0 end,6) "offset" from s""")
def _(t):
    return rounded(A.depth_scale(t.lineitem.select(F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))))


@query("e26_summarize_runs", "select split run, round(avg(case when m='x' then v end),6) x, round(avg(case when m='z' then v end),6) z from (select split, scene_id, 'x' m, avg(x) v from points group by 1,2 union all select split, scene_id, 'z', avg(z) from points group by 1,2) q group by 1")
def _(t):
    s = t.points.groupBy(F.col("split").alias("run"), "scene_id").agg(F.avg("x").alias("x"), F.avg("z").alias("z")).unpivot(["run", "scene_id"], ["x", "z"], "metric", "value")
    return rounded(A.summarize_runs(s, ["x", "z"]))


@query("e27_rig_bounds", "with c as (select avg(px) cx, avg(py) cy, avg(pz) cz from cameras) select round(cx,6) cx, round(cy,6) cy, round(cz,6) cz, round(1.1*max(sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy)+(pz-cz)*(pz-cz))),6) radius from cameras, c group by cx, cy, cz")
def _(t):
    return rounded(A.rig_bounds(t.cameras))
