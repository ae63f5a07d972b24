"""Queries of the row-wise operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.plans.registry import query, rounded

QN = "sqrt(q0*q0+q1*q1+q2*q2+q3*q3)"


@query("b1_activate", "select point_id, round(1/(1+exp(-opacity_logit)),6) opacity, round(exp(s0),6) s0, round(exp(s1),6) s1, round(exp(s2),6) s2 from points")
def _(t):
    return rounded(C.activate(t.points).select("point_id", "opacity", "s0", "s1", "s2"))


@query("b2_normalize_quat", f"select point_id, " + ", ".join(f"round({q}/{QN}*sign(q0),6)+0 {q}" for q in ("q0", "q1", "q2", "q3")) + " from points")
def _(t):
    return rounded(C.normalize_quat(t.points).select("point_id", "q0", "q1", "q2", "q3"))


@query("b3_rgb", f"select point_id, round((r/255e0-0.5e0)/{C.SH0}e0,6)+0 dc, cast(trunc(least(greatest(opacity_logit*{C.SH0}e0+0.5e0,0),1)*255e0) as int) rgb from points")
def _(t):
    return rounded(t.points.select("point_id", C.rgb_to_dc(F.col("r")).alias("dc"), C.dc_to_rgb(F.col("opacity_logit")).alias("rgb")))


@query("b4_clean_attrs", "select point_id, round(greatest(1/(1+exp(-opacity_logit)),0.001),6) opacity, " + ", ".join(f"round(least(greatest(exp({s}),1e-4),1),6) {s}" for s in ("s0", "s1", "s2")) + " from points")
def _(t):
    return rounded(C.clean_attrs(C.activate(t.points)).select("point_id", "opacity", "s0", "s1", "s2"))


@query("b5_normalize_color", "select point_id, round(r/127.5e0-1,6)+0 r, round(g/127.5e0-1,6)+0 g, round(b/127.5e0-1,6)+0 b from points")
def _(t):
    return rounded(t.points.select("point_id", *(C.normalize_color(F.col(c)).alias(c) for c in "rgb")))


@query("b6_l2_normalize", """select f.point_id, pos, round(case when f.point_id % 3 <> 0 then v/greatest(n,1e-8) else v end,6)+0 v from long_features f
    join (select point_id, sqrt(sum(v*v)) n from long_features group by 1) g on f.point_id = g.point_id""")
def _(t):
    d = t.features.select("point_id", F.posexplode(C.l2_normalize(F.col("feat"), F.col("point_id") % 3 != 0)).alias("pos", "v"))
    return rounded(d.withColumn("pos", F.col("pos").cast("long")))


@query("b7_valid_flag", "select point_id, bool_or(v <> 0) valid from long_features group by 1")
def _(t):
    return t.features.select("point_id", C.valid_flag(F.col("feat")).alias("valid"))


W, X, Y, Z = (f"({q}/{QN})" for q in ("q0", "q1", "q2", "q3"))
ROT = [f"1-2*({Y}*{Y}+{Z}*{Z})", f"2*({X}*{Y}-{W}*{Z})", f"2*({X}*{Z}+{W}*{Y})", f"2*({X}*{Y}+{W}*{Z})", f"1-2*({X}*{X}+{Z}*{Z})", f"2*({Y}*{Z}-{W}*{X})", f"2*({X}*{Z}-{W}*{Y})", f"2*({Y}*{Z}+{W}*{X})", f"1-2*({X}*{X}+{Y}*{Y})"]


@query("b8_quat_to_rotmat", "select point_id, " + ", ".join(f"round({e},6)+0 r{i}" for i, e in enumerate(ROT)) + " from points")
def _(t):
    return rounded(t.points.select("point_id", *(e.alias(f"r{i}") for i, e in enumerate(C.quat_to_rotmat("q0", "q1", "q2", "q3")))))


@query("b9_covariance", "select point_id, " + ", ".join(f"round(a{i}*a{j}*exp(2*s0)+b{i}*b{j}*exp(2*s1)+d{i}*d{j}*exp(2*s2),6)+0 c{i}{j}" for i in range(3) for j in range(i, 3))
    + " from (select point_id, s0, s1, s2, " + ", ".join(f"{ROT[3 * i + k]} {'abd'[k]}{i}" for i in range(3) for k in range(3)) + " from points) p")
def _(t):
    return rounded(C.activate(t.points).select("point_id", *(e.alias(n) for n, e in C.covariance().items())))


@query("b10_transform_points", "select point_id, round((x*2+y*0.5+1)/(x*0.013e0+2.7e0),9)+0 x, round((y*3-z+2)/(x*0.013e0+2.7e0),9)+0 y, round((z*0.5e0-4)/(x*0.013e0+2.7e0),9)+0 z from points")
def _(t):
    return rounded(C.transform_points(t.points, [[2, 0.5, 0, 1], [0, 3, -1, 2], [0, 0, 0.5, -4], [0.013, 0, 0, 2.7]]).select("point_id", *C.XYZ), 9)


@query("b11_rotate", """select point_id, round((x-25)*cos(0.7)-(y-26)*sin(0.7)+25,6)+0 x, round((x-25)*sin(0.7)+(y-26)*cos(0.7)+26,6)+0 y, round(z,6) z,
    round(q0*cos(0.35)-q3*sin(0.35),6)+0 q0, round(q1*cos(0.35)-q2*sin(0.35),6)+0 q1, round(q2*cos(0.35)+q1*sin(0.35),6)+0 q2, round(q3*cos(0.35)+q0*sin(0.35),6)+0 q3 from points""")
def _(t):
    return rounded(C.rotate(t.points, "z", 0.7, (25.0, 26.0, 5.0), quat=("q0", "q1", "q2", "q3")).select("point_id", *C.XYZ, "q0", "q1", "q2", "q3"))


@query("b12_scale", "select point_id, round(x*2,6) x, round(y*3,6) y, round(z*0.5,6) z, round(exp(s0)*2,6) s0, round(exp(s1)*3,6) s1, round(exp(s2)*0.5,6) s2 from points")
def _(t):
    return rounded(C.scale(C.activate(t.points), (2, 3, 0.5)).select("point_id", *C.XYZ, "s0", "s1", "s2"))


@query("b13_flip", "select point_id, -x x, -y y, q0, -q1 q1, -q2 q2, q3 from points")
def _(t):
    return C.flip(t.points, "xy").select("point_id", "x", "y", "q0", "q1", "q2", "q3")


@query("b14_shift", "select point_id, x+1 x, round(y-2.5,6) y, z+0.25 z from points")
def _(t):
    return rounded(C.shift(t.points, 1, -2.5, 0.25).select("point_id", *C.XYZ))


@query("b15_clip_range", "select point_id, least(greatest(x,10),40) x, least(greatest(y,5),30) y, least(greatest(z,1),8) z from points")
def _(t):
    return C.clip_range(t.points, (10, 5, 1, 40, 30, 8)).select("point_id", *C.XYZ)


@query("b16_jitter", "select point_id, true near from points")
def _(t):
    d = C.jitter(t.points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "z0": F.col("z")}))
    return d.select("point_id", (F.greatest(*(F.abs(F.col(c) - F.col(f"{c}0")) for c in C.XYZ)) <= 0.0500001).alias("near"))


def drawn(*parts):
    return "(cast('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")),1,8) as bigint)/4294967296e0)"


@query("b17_color_translate", "select point_id, " + ", ".join(f"round(least(greatest({c}+({drawn(chr(39) + '0' + chr(39), 'scene_id', chr(39) + c + chr(39))}-0.5)*2*255*0.1,0),255),6) {c}" for c in "rgb") + " from points")
def _(t):
    return rounded(C.color_translate(t.points).select("point_id", "r", "g", "b"))


@query("b18_color_adjust", """with a as (select point_id, scene_id, least(r*1.2e0,255) r, least(g*1.2e0,255) g, least(b*1.2e0,255) b from points),
    m as (select *, avg(0.2989e0*r+0.587e0*g+0.114e0*b) over (partition by scene_id) m from a),
    c as (select point_id, least(greatest(r*0.8e0+m*0.2e0,0),255) r, least(greatest(g*0.8e0+m*0.2e0,0),255) g, least(greatest(b*0.8e0+m*0.2e0,0),255) b from m),
    l as (select *, 0.2989e0*r+0.587e0*g+0.114e0*b l from c)
    select point_id, round(least(greatest(r*0.5e0+l*0.5e0,0),255),5) r, round(least(greatest(g*0.5e0+l*0.5e0,0),255),5) g, round(least(greatest(b*0.5e0+l*0.5e0,0),255),5) b from l""")
def _(t):
    return rounded(C.color_adjust(t.points, 1.2, 0.8, 0.5).select("point_id", "r", "g", "b"), 5)


@query("b18_turn_hue", """with a as (select point_id, r/255e0 r, g/255e0 g, b/255e0 b, greatest(r,g,b)/255e0 t, least(r,g,b)/255e0 w from points),
    h as (select *, case when t=w then 0 when t=r then (g-b)/(t-w) when t=g then (b-r)/(t-w)+2 else (r-g)/(t-w)+4 end/6 + 0.1 h, case when t>0 then (t-w)/t else 0 end s from a),
    k as (select point_id, t, s, (h-floor(h))*6 h from h), f as (select *, cast(floor(h) as int) % 6 i, h-floor(h) f, t*(1-s) p, t*(1-(h-floor(h))*s) q, t*(1-(1-(h-floor(h)))*s) u from k)
    select point_id, round(255*case i when 0 then t when 1 then q when 2 then p when 3 then p when 4 then u else t end,5)+0 r,
    round(255*case i when 0 then u when 1 then t when 2 then t when 3 then q when 4 then p else p end,5)+0 g, round(255*case i when 0 then p when 1 then p when 2 then u when 3 then t when 4 then t else q end,5)+0 b from f""")
def _(t):
    return rounded(C.turn_hue(t.points, 0.1).select("point_id", "r", "g", "b"), 5)


PROJ = """select point_id, scene_id, frame, depth, focal*right_/depth+width/2e0 u, focal*down/depth+height/2e0 v, width, height from
    (select p.point_id, p.scene_id, frame, focal, width, height, -(c*(x-px)+s*(y-py)) depth, -(c*(y-py)-s*(x-px)) right_, -(z-pz) down from points p join cameras k on k.frame % 8 = p.scene_id) q"""


@query("b19_project", f"select frame, count(*) n, count(*) filter (where depth>0.01 and u>=0 and u<width and v>=0 and v<height) seen, round(avg(depth),6) depth from ({PROJ}) w group by frame")
def _(t):
    d = C.project(t.points.join(t.cameras, F.col("frame") % 8 == F.col("scene_id")))
    return rounded(d.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"), F.avg("depth").alias("depth")))


@query("b20_unproject", """with q as (select k.frame, u, v, depth, c, s, px, py, pz, (u+0.5e0-320e0)/500e0 a, (v+0.5e0-240e0)/500e0 b from pixels p join cameras k on k.frame = p.frame)
    select frame, u, v, round(depth,9) depth, round(px-c*depth+s*a*depth,9)+0 x, round(py-s*depth-c*a*depth,9)+0 y, round(pz-b*depth,9)+0 z, round(pz-b*depth/sqrt(1+a*a+b*b),9)+0 ray_z from q""")
def _(t):
    d = t.pixels.join(t.cameras, "frame")
    d = C.unproject(C.unproject(d, ray=True).withColumn("ray_z", F.col("z")))
    return rounded(d.select(F.col("frame").cast("int").alias("frame"), "u", "v", "depth", *C.XYZ, "ray_z"), 9)


@query("b21_unproject_pano", """with q as (select frame, u, v, depth, 2*pi()*(u+0.5e0)/640-pi() th, pi()/2-pi()*(v+0.5e0)/480 ph from pixels)
    select frame, u, v, round(depth,6) depth, round(depth*cos(ph)*sin(th),6)+0 x, round(depth*cos(ph)*cos(th),6)+0 y, round(depth*sin(ph),6)+0 z from q""")
def _(t):
    return rounded(C.unproject_pano(t.pixels, 640, 480).select("frame", "u", "v", "depth", *C.XYZ))


@query("b22_slog", "select point_id, round(sign(opacity_logit)*ln(1+abs(opacity_logit)),6)+0 v, round(opacity_logit,6)+0 back from points")
def _(t):
    d = t.points.select("point_id", C.slog(F.col("opacity_logit")).alias("v"))
    return rounded(d.withColumn("back", C.sexp(F.col("v"))))


@query("b23_quantize", """with e as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from points), q as (select point_id, x, y, x0, x1, y0, y1, cast(round_even((x-x0)/(x1-x0)*255,0) as int) xc, cast(round_even((y-y0)/(y1-y0)*255,0) as int) yc from points, e)
    select point_id, xc x_code, yc y_code, round(xc/255e0*(x1-x0)+x0,6) x_back, round(yc/255e0*(y1-y0)+y0,6) y_back from q""")
def _(t):
    return rounded(C.dequantize(C.quantize(t.points, ("x", "y")), ("x", "y")).select("point_id", "x_code", "y_code", "x_back", "y_back"))


MORTON = " | ".join(f"(((cast(floor({c}) as bigint) >> {k}) & 1) << {3 * k + s})" for c, s in (("x", 2), ("y", 1), ("z", 0)) for k in range(16))


@query("b24_morton", f"select point_id, {MORTON} code, cast(floor(x) as bigint) x, cast(floor(y) as bigint) y, cast(floor(z) as bigint) z from points")
def _(t):
    d = C.cell(t.points, 1.0).select("point_id", C.morton(F.col("cx"), F.col("cy"), F.col("cz")).alias("code"))
    return d.select("point_id", "code", *(e.alias(c) for c, e in zip(C.XYZ, C.unmorton(F.col("code")))))


@query("b25_hilbert", "select point_id, cast(floor(x) as bigint) x, cast(floor(y) as bigint) y, cast(floor(z) as bigint) z from points")
def _(t):
    from pointloom.functions.curves import hilbert_decode

    d = C.hilbert(C.cell(t.points, 1.0)).withColumn("back", hilbert_decode(16)("code"))
    return d.select("point_id", "back.*")


@query("b26_voxel_coord", """select point_id, cast(floor(x/2)-min(floor(x/2)) over w as bigint) cx, cast(floor(y/2)-min(floor(y/2)) over w as bigint) cy, cast(floor((z-min(z) over w)/2) as bigint) oz from points window w as (partition by scene_id)""")
def _(t):
    a = C.voxel_coord(t.points, 2.0).withColumns({"lx": F.col("cx"), "ly": F.col("cy")})
    return C.voxel_coord(a, 2.0, "origin").select("point_id", F.col("lx").alias("cx"), F.col("ly").alias("cy"), F.col("cz").alias("oz"))


@query("b27_displacement", "select point_id, round(x/2-floor(x/2)-0.5,9)+0 dx, round(y/2-floor(y/2)-0.5,9)+0 dy, round(z/2-floor(z/2)-0.5,9)+0 dz from points")
def _(t):
    return rounded(C.displacement(t.points, 2.0).select("point_id", "dx", "dy", "dz"), 9)


@query("b28_gauss_weight", "select point_id, round(2*exp(-(x*x+z*z)/(2*20*20e0)),6) w from points")
def _(t):
    return rounded(t.points.select("point_id", C.gauss_weight(F.col("x") * F.col("x") + F.col("z") * F.col("z"), 2.0, 20.0).alias("w")))


@query("b29_yaw", "select point_id, round(atan2(2*(q0*q3+q1*q2),1-2*(q2*q2+q3*q3)),6)+0 yaw from points")
def _(t):
    return rounded(t.points.select("point_id", C.yaw("q0", "q1", "q2", "q3").alias("yaw")))


@query("b30_tanh_strength", "select point_id, round(tanh(y/10),6) strength, segment-1 label from points")
def _(t):
    return rounded(t.points.select("point_id", C.tanh_strength(F.col("y") / 10).alias("strength"), (F.col("segment") - 1).alias("label")))


@query("b31_collect_features", "select point_id, 3 + 64 as n, round(x,6) first_, round(last_,6)+0 last_ from (select p.vec_id point_id, p.label*1e0 x, p.embedding[64]::double last_ from embeddings p) q")
def _(t):
    d = t.features.select("point_id", C.collect_features("segment", "scene_id", "segment", F.col("feat")).alias("f"))
    return rounded(d.select("point_id", F.size("f").alias("n"), F.col("f")[0].alias("first_"), F.element_at("f", -1).alias("last_")))


SHB = ["0.28209479177387814", "-0.4886025119029199*y", "0.4886025119029199*z", "-0.4886025119029199*x", "1.0925484305920792*x*y", "-1.0925484305920792*y*z", "0.31539156525252005*(2*z*z-x*x-y*y)", "-1.0925484305920792*x*z", "0.5462742152960396*(x*x-y*y)",
       "-0.5900435899266435*y*(3*x*x-y*y)", "2.890611442640554*x*y*z", "-0.4570457994644658*y*(4*z*z-x*x-y*y)", "0.3731763325901154*z*(2*z*z-3*x*x-3*y*y)", "-0.4570457994644658*x*(4*z*z-x*x-y*y)", "1.445305721320277*z*(x*x-y*y)", "-0.5900435899266435*x*(x*x-3*y*y)"]


@query("b32_eval_sh", "select point_id, round(" + "+".join(f"{k + 1}e0*cast({b.split('*', 1)[0]} as double){'*' + b.split('*', 1)[1] if '*' in b else ''}" for k, b in enumerate(SHB)) + ",5)+0 c from (select point_id, x/n x, y/n y, z/n z from (select point_id, x, y, z, sqrt(x*x+y*y+z*z) n from points) a) p")
def _(t):
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in "yz"), F.col("x") * F.col("x")))
    return rounded(t.points.select("point_id", C.eval_sh([F.lit(float(k)) for k in range(1, 17)], *(F.col(c) / n for c in C.XYZ)).alias("c")), 5)


