"""Queries of orders, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.operators import aggregate as A
from pointloom.operators import sampling as S
from pointloom.operators import sets, windows
from pointloom.plans.fixtures import VIEWS
from pointloom.plans.q_columns import MORTON
from pointloom.plans.registry import query, rounded

CELLS = "cast(floor(x/2) as bigint) cx, cast(floor(y/2) as bigint) cy, cast(floor(z/2) as bigint) cz"
IN_CELLS = f"(select *, {CELLS} from points)"
DRAW = "md5('0|' || cast(point_id as varchar))"
SERIAL = f"select scene_id, point_id, row_number() over (partition by scene_id order by code, point_id)-1 rank from (select scene_id, point_id, {MORTON} code from points) q"


@query("f1_serialize", SERIAL)
def _(t):
    return windows.serialize(t.points.select("scene_id", "point_id", *C.XYZ), 1.0).select("scene_id", "point_id", F.col("rank").cast("long").alias("rank"))


@query("f2_patches", f"""with r as ({SERIAL}), n as (select scene_id, count(*) n from r group by 1), d as (select r.*, n from r join n on r.scene_id=n.scene_id), l as (select *, (1024 - n % 1024) % 1024 lack, (n-1)//1024 last_ from d)
    select scene_id, rank//1024 patch, rank % 1024 slot, point_id from l union all select scene_id, last_, n % 1024 + rank - (last_*1024-lack), point_id from l where n > 1024 and rank >= last_*1024-lack and rank < last_*1024""")
def _(t):
    return windows.patches(windows.serialize(t.points.select("scene_id", "point_id", *C.XYZ), 1.0), 1024)


@query("f3_offsets", "select scene_id, n, cast(sum(n) over (order by scene_id) as bigint) \"offset\" from (select scene_id, count(*) n from points group by 1) q")
def _(t):
    return windows.offsets(t.points)


@query("f4_smooth_metrics", "select name, iteration, round(avg(value) over w,6) mean, round(quantile_cont(value,0.5) over w,6) median from metrics window w as (partition by name order by iteration rows between 19 preceding and current row)")
def _(t):
    return rounded(windows.smooth_metrics(t.metrics, 20).select("name", "iteration", "mean", "median"))


@query("f4_latest_metrics", "select name, round(avg(value),6) mean, round(max_by(value, iteration),6) latest from metrics group by 1")
def _(t):
    return rounded(windows.latest_metrics(t.metrics))


@query("f5_trivial_status", """select name, iteration, case when ma < 45 and mb < 1 then 'trivial' when ma > 55 or mb > 1.5 then 'learning' else 'unclear' end status
    from (select name, iteration, avg(value) over w ma, avg(value/(1+iteration % 50)) over w mb from metrics window w as (partition by name order by iteration rows between 9 preceding and current row)) q""")
def _(t):
    d = t.metrics.withColumns({"a": F.col("value"), "b": F.col("value") / (1 + F.col("iteration") % 50)})
    return windows.trivial_status(d, 45, 55).withColumn("status", F.when((F.col("ma") < 45) & (F.col("mb") < 1), "trivial").when((F.col("ma") > 55) | (F.col("mb") > 1.5), "learning").otherwise("unclear")).select("name", "iteration", "status")


@query("f6_rank_for_energy", """with e as (select pos, sum(v*v) over (order by pos)/sum(v*v) over () e from (select row_number() over (order by s desc, pos) pos, s v from (select pos, stddev_samp(v) s from long_features group by 1) a) b)
    select min(pos) filter (where e >= 0.9) rank_90, min(pos) filter (where e >= 0.95) rank_95, min(pos) filter (where e >= 0.99) rank_99 from e""")
def _(t):
    d = A.dim_profile(t.features).select("pos", F.col("std").alias("s"))
    from pyspark.sql import Window

    return windows.rank_for_energy(d.withColumn("k", F.row_number().over(Window.orderBy(F.desc("s"), "pos")).cast("long")))


STABLE = """with b as (select l_suppkey % 50 as key, least(greatest(cast(floor(l_discount*8*100+1e-9) as int),0),100) t from lineitem), g as (select key, unnest(range(101)) t from (select distinct key from b) k), c as (select key, t, count(*) n from b group by 1,2),
    a as (select g.key, g.t, cast(sum(coalesce(n,0)) over (partition by g.key order by g.t desc) as double) area from g left join c on g.key=c.key and g.t=c.t),
    s as (select key, t, abs(coalesce(lead(area) over w, area)-area)/greatest(max(area) over (partition by key),1) slope from a window w as (partition by key order by t)),
    m as (select key, t, list_sort([coalesce(lag(slope,2) over w,0), coalesce(lag(slope,1) over w,0), slope, coalesce(lead(slope,1) over w,0), coalesce(lead(slope,2) over w,0)])[3] calm from s window w as (partition by key order by t)),
    l as (select key, t, level from m, (values (0.01e0),(0.02e0),(0.05e0),(0.1e0),(1e0)) v(level) where calm < level), r as (select key, level, t - row_number() over (partition by key, level order by t) run, t from l),
    i as (select key, level, min(t) a, max(t) b, count(*) n from r group by key, level, run having count(*) >= 5), p as (select *, row_number() over (partition by key order by level, a desc) rn from i)
    select k.key, level, round((a+b)/2e0/100,6) threshold from (select distinct key from b) k left join (select * from p where rn=1) q on k.key=q.key"""


@query("f7_stable_threshold", STABLE)
def _(t):
    return rounded(windows.stable_threshold(t.lineitem.select((F.col("l_suppkey") % 50).alias("key"), (F.col("l_discount") * 8).alias("score"))))


def first_in_cell(order, cols="point_id, segment"):
    return f"select scene_id, cx, cy, cz, {cols} from (select *, row_number() over (partition by scene_id, cx, cy, cz order by {order}) rn from {IN_CELLS} a) b where rn = 1"


@query("g1_voxel_sample", f"select 'first' policy, * from ({first_in_cell('point_id')}) a union all select 'random', * from ({first_in_cell(DRAW + ', point_id')}) b union all select 'valid', * from ({first_in_cell('valid desc, ' + DRAW + ', point_id')}) c")
def _(t):
    cols = ("scene_id", "cx", "cy", "cz", "point_id", "segment")
    return S.make_views(t.points.select("scene_id", "point_id", *C.XYZ, "segment", "valid"), [(p, lambda d, p=p: S.voxel_sample(d, 2.0, p).select(*cols)) for p in ("first", "random", "valid")]).withColumnRenamed("view", "policy")


@query("g2_voxel_sample_importance", first_in_cell("opacity_logit*s0 desc, point_id", "point_id, opacity_logit*s0 score"))
def _(t):
    return S.voxel_sample_importance(t.points, 2.0, F.col("opacity_logit") * F.col("s0"))


@query("g3_voxel_fragments", f"""with a as (select scene_id, point_id, row_number() over (partition by scene_id, cx, cy, cz order by point_id)-1 at_, count(*) over (partition by scene_id, cx, cy, cz) n from {IN_CELLS} p), m as (select scene_id, max(n) top from a group by 1)
    select fragment, count(*) points, cast(sum(point_id % 1000003) as bigint) ids from (select a.scene_id, point_id, unnest(range(at_, top, n)) fragment from a join m on a.scene_id=m.scene_id) q group by 1""")
def _(t):
    return S.voxel_fragments(t.points, 2.0).groupBy("fragment").agg(F.count("*").alias("points"), F.sum(F.col("point_id") % 1000003).alias("ids"))


@query("g4_voxel_inverse", f"select point_id, min(point_id) over (partition by scene_id, cx, cy, cz) sample_id from {IN_CELLS} a")
def _(t):
    return S.voxel_inverse(t.points, S.voxel_sample(t.points, 2.0), 2.0)


@query("g5_voxel_sample_labeled", "select scene_id, cx, cy, cz, ref_id, segment from (select *, row_number() over (partition by scene_id, cx, cy, cz order by segment = -1, ref_id) rn from (select *, " + CELLS + " from ref_points) a) b where rn=1")
def _(t):
    return S.voxel_sample_labeled(t.ref_points, 2.0)


RATIO = "(0.2e0+0.6e0*cast('0x' || substr(md5('0|' || scene_id || '|' || cx || '|' || cy || '|' || cz),1,8) as bigint)/4294967296e0)"


@query("g6_sample_cells", f"select point_id from (select *, count(*) over (partition by scene_id, cx, cy, cz) n, row_number() over (partition by scene_id, cx, cy, cz order by {DRAW}, point_id) at_ from {IN_CELLS} a) b where at_ <= greatest(1, floor(n*{RATIO}))")
def _(t):
    return S.sample_cells(t.points, 2.0, 0.2, 0.8).select("point_id")


@query("g6_sample_modes", f"""with a as (select *, count(*) over (partition by scene_id, cx, cy, cz) n, row_number() over (partition by scene_id, cx, cy, cz order by {DRAW}, point_id) at_ from {IN_CELLS} a)
    select 'single' mode, point_id from a where at_ = 1 union all select 'dense', point_id from a union all select 'half', point_id from a where at_ <= greatest(1, floor(n*0.5e0))""")
def _(t):
    named = lambda mode, d: d.select(F.lit(mode).alias("mode"), "point_id")
    d = named("single", S.sample_cells(t.points, 2.0, mode="single")).unionByName(named("dense", S.sample_cells(t.points, 2.0, mode="dense")))
    return d.unionByName(named("half", S.sample_cells(t.points, 2.0, 0.5, 0.5)))


@query("g7_dropout", f"select point_id from points where cast('0x' || substr({DRAW},1,8) as bigint)/4294967296e0 >= 0.3 or segment = 5")
def _(t):
    return S.dropout(t.points, 0.3, 0, F.col("segment") == 5).select("point_id")


@query("g8_sphere_crop", "select scene_id, point_id from (select *, row_number() over (partition by scene_id order by (x-25)*(x-25)+(y-26)*(y-26)+(z-5)*(z-5), point_id) rn from points) a where rn <= 500")
def _(t):
    return S.sphere_crop(t.points, 500, (25.0, 26.0, 5.0)).select("scene_id", "point_id")


@query("g9_lattice_crops", """with g as (select unnest(range(-1,8)) kx), h as (select unnest(range(-1,9)) ky), i as (select unnest(range(-1,4)) kz), m as (select scene_id, kx, ky, kz, point_id from points, g, h, i where (kx*8-x)*(kx*8-x)+(ky*8-y)*(ky*8-y)+(kz*8-z)*(kz*8-z) <= 25),
    n as (select scene_id, kx, ky, kz, count(*) n from m group by 1,2,3,4 having count(*) >= 20), k as (select * from (select *, row_number() over (partition by scene_id order by n desc, kx, ky, kz) rn from n) a where rn <= 40)
    select m.* from m join k using (scene_id, kx, ky, kz)""")
def _(t):
    return S.lattice_crops(t.points, 5.0, 8.0, 40, 20)


CHUNK = """with b as (select scene_id, min(x) xl, max(x) xh, min(y) yl, max(y) yh from points group by 1), g as (select unnest(range(20)) wx), h as (select unnest(range(20)) wy),
    m as (select p.scene_id, wx, wy, point_id from points p join b on p.scene_id=b.scene_id, g, h where wx*6 < xh-xl+6-12 and wy*6 < yh-yl+6-12 and x-xl >= wx*6 and x-xl < wx*6+12 and y-yl >= wy*6 and y-yl < wy*6+12),
    n as (select scene_id, wx, wy, count(*) n from m group by 1,2,3 having count(*) >= 100), k as (select scene_id, wx, wy, row_number() over (partition by scene_id order by n desc, wx, wy)-1 chunk_id from n)"""


@query("g10_chunk", f"{CHUNK} select m.scene_id, chunk_id, m.wx, m.wy, point_id from m join k on m.scene_id=k.scene_id and m.wx=k.wx and m.wy=k.wy where chunk_id < 12")
def _(t):
    return S.chunk(t.points, 12.0, 6.0, 100, 12).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("g11_chunk_pair", f"{CHUNK} select r.scene_id, chunk_id, ref_id from ref_points r join b on r.scene_id=b.scene_id join k on r.scene_id=k.scene_id where chunk_id < 12 and r.x-xl >= wx*6 and r.x-xl < wx*6+12 and r.y-yl >= wy*6 and r.y-yl < wy*6+12")
def _(t):
    return S.chunk_pair(S.full_windows(t.points, 12.0, 6.0, 100, 12), t.points, t.ref_points, 12.0, 6.0).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("g12_sample_per_class", f"select point_id, segment from (select *, row_number() over (partition by segment order by {DRAW}, point_id) rn from points) a where rn <= 500 order by {DRAW}, point_id limit 2000")
def _(t):
    return S.sample_per_class(t.points, 500, 2000).select("point_id", "segment")


@query("g13_sample_weighted")
def _(t):
    return S.sample_weighted(t.points, "x", 5000)


@query("g14_farthest_sample", """with recursive s as (select 0 step, scene_id, point_id, x, y, z, cast('infinity' as double) d, point_id = min(point_id) over (partition by scene_id) pick from points union all
    select step + 1, scene_id, point_id, x, y, z, d, row_number() over (partition by scene_id order by d desc, point_id) = 1 from (
        select s.step, s.scene_id, s.point_id, s.x, s.y, s.z, least(s.d, (s.x-p.x)*(s.x-p.x) + (s.y-p.y)*(s.y-p.y) + (s.z-p.z)*(s.z-p.z)) d from s join s p on p.pick and p.scene_id = s.scene_id) q where step < 11)
    select scene_id, cast(step as int) step, point_id from s where pick""")
def _(t):
    return S.farthest_sample(t.points, 12)


@query("g15_topk_labels", """with n as (select point, class, count(*) n from contrib group by 1,2), r as (select *, row_number() over (partition by point order by n desc, class) rn from n), k as (select unnest(range(1,4)) rank)
    select p.point, cast(rank as int) rank, cast(coalesce(r.class, f.class) as int) "label" from (select distinct point from n) p cross join k left join r on r.point=p.point and rn=rank join r f on f.point=p.point and f.rn=1""")
def _(t):
    return S.topk_labels(t.contrib.groupBy("point", F.col("class").alias("label")).agg(F.count("*").alias("n")), 3)


@query("g16_make_views", "select point_id, x, 'plain' \"view\" from points union all select point_id, -x, 'flipped' from points union all select point_id, x*2, 'scaled' from points")
def _(t):
    return S.make_views(t.points, [("plain", lambda d: d), ("flipped", lambda d: C.flip(d, "x")), ("scaled", lambda d: C.scale(d, 2.0))]).select("point_id", "x", "view")


@query("g17_shuffle", f"select scene_id, point_id, row_number() over (partition by scene_id order by {DRAW}, point_id) place from points")
def _(t):
    return S.shuffle(t.points.select("scene_id", "point_id")).select("scene_id", "point_id", F.col("place").cast("long").alias("place"))


def numbered_points(t):
    """The points with ``point_id`` as a decimal: the same numbers, also from orders on (9,223,372 and up) where they are too large for a bigint."""
    return t.sql(VIEWS["points"].replace("(((l_orderkey*", "(((cast(l_orderkey as decimal(38,0))*")).withColumn("point_id", F.col("point_id").cast("decimal(38,0)"))


@query("g18_sphere_cover", "select scene_id, count(*) points, 0 odd_crops from points group by 1")
def _(t):
    """Every point is in a crop, and every crop has as many points as it should."""
    d = S.sphere_cover(numbered_points(t), 2500)
    n = t.points.groupBy("scene_id").agg(F.least(F.count("*"), F.lit(2500)).alias("due"))
    odd = d.groupBy("scene_id", "crop").agg(F.count("*").alias("n")).join(n, "scene_id").groupBy("scene_id").agg(F.count_if(F.col("n") != F.col("due")).cast("int").alias("odd_crops"))
    return d.groupBy("scene_id").agg(F.count_distinct("point_id").alias("points")).join(odd, "scene_id")


@query("h1_fuse_frames", f"select scene_id, cx, cy, cz, count(*) n, round(avg(x),9) x, round(avg(y),9) y, round(avg(z),9) z from (select *, {CELLS} from (select scene_id, x, y, z from points union all select scene_id, x, y, z from ref_points) a) b group by 1,2,3,4")
def _(t):
    return rounded(sets.fuse_frames([t.points.select("scene_id", "point_id", *C.XYZ), t.ref_points.select("scene_id", F.col("ref_id").alias("point_id"), *C.XYZ)], 2.0), 9)


@query("h2_common_cells", "select a.segment, a.pos, round(a.v,6)+0 a, round(b.v,6)+0 b from (select segment, pos, avg(v) v from long_features where scene_id < 2 group by 1,2) a join (select segment, pos, avg(v) v from long_features where scene_id >= 2 group by 1,2) b on a.segment=b.segment and a.pos=b.pos")
def _(t):
    return rounded(sets.common_cells(t.features.where("scene_id < 2"), t.features.where("scene_id >= 2"), ["segment"]))


@query("h3_distinct_rows", "select count(*) n, count(distinct embedding) distinct_n, round(count(distinct embedding)/count(*),6) ratio from embeddings")
def _(t):
    return rounded(sets.distinct_rows(t.features))


@query("h4_incomplete", "select scene_id, instance from (select distinct scene_id, instance from points) a except select scene_id, instance from points where segment = 3")
def _(t):
    return sets.incomplete(t.points.where("segment = 3").select("scene_id", "instance"), t.points.select("scene_id", "instance").distinct())


@query("h5_common_classes", "select segment from points where scene_id % 2 = 0 and segment > 0 intersect select segment from points where scene_id % 2 = 1 and segment < 4")
def _(t):
    return sets.common_classes(t.points.where("scene_id % 2 = 0 and segment > 0"), t.points.where("scene_id % 2 = 1 and segment < 4"))


@query("h5_missing_classes", "select segment from points where scene_id % 2 = 0 except select segment from points where scene_id % 2 = 1 and segment < 4")
def _(t):
    return sets.missing_classes(t.points.where("scene_id % 2 = 0"), t.points.where("scene_id % 2 = 1 and segment < 4"))
