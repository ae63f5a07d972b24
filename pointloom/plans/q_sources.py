"""Queries of readers and sinks: files written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pointloom.functions.shared import shared_dir
from pointloom.operators import sampling as S
from pointloom.plans.q_sampling import CHUNK
from pointloom.plans.registry import query, rounded
from pointloom.sources import readers

#: Points are dealt into folders of about so many, so that a group does not grow with the table.
FOLDER = 20_000
PARTS = f"(select *, cast(code % (select cast(ceil(count(*)/{FOLDER}e0) as bigint) from points) as int) part from points)"


def folder(t, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts(t):
    n = -(-t.points.count() // FOLDER)
    return t.points.withColumn("part", (F.col("code") % n).cast("int"))


def arrays(t):
    """A folder of array files per scene and part."""
    path = folder(t, "arrays")

    def render(d):
        d = d.sort_values("point_id")
        at = f"{d['split'].iloc[0]}/{d['scene_id'].iloc[0]}_{d['part'].iloc[0]}"
        yield f"{at}/coord.npy", readers.array_bytes(d[["x", "y", "z"]].to_numpy(dtype="<f8"))
        yield f"{at}/segment_r16.npy", readers.array_bytes(d["segment"].to_numpy(dtype="<i4"))

    readers.write_files(parts(t).select("split", "scene_id", "part", "point_id", "x", "y", "z", "segment"), path, ["split", "scene_id", "part"], render)
    return path


@query("a2_ingest_arrays", f"select scene_id || '_' || part scene, row_number() over (partition by scene_id, part order by point_id)-1 \"row\", x, y, z, segment from {PARTS} p")
def _(t):
    d = readers.ingest_arrays(t.spark, arrays(t), ["coord", "segment_r16"])
    return d.select("scene", "row", *(F.col("coord")[k].alias(c) for k, c in enumerate("xyz")), F.col("segment_r16")[0].cast("int").alias("segment"))


@query("a3_ingest_ply", f"select scene_id || '_' || part || '.ply' file, row_number() over (partition by scene_id, part order by point_id)-1 \"row\", x, y, z, opacity_logit from {PARTS} p")
def _(t):
    path, columns = folder(t, "ply"), ["x", "y", "z", "opacity_logit"]

    def render(d):
        yield f"{d['scene_id'].iloc[0]}_{d['part'].iloc[0]}.ply", readers.ply_bytes(d.sort_values("point_id")[["x", "y", "z", "opacity_logit"]])

    readers.write_files(parts(t).select("scene_id", "part", "point_id", *columns), path, ["scene_id", "part"], render)
    return readers.ingest_ply(t.spark, path, columns)


@query("a4_ingest_camera_text", """with i as (select o_orderkey image, o_custkey % 25 camera, o_totalprice tx from orders), p as (select p_partkey track, p_size*1e0 x, p_partkey % 1000 a, (p_partkey+3) % 1000 b, p_size % 7 u, p_size % 5 w from part),
    o as (select track, x, a image, u point from p union all select track, x, b, w from p)
    select o.track, o.x, o.point, i.image, c.frame camera, c.width, c.focal, i.tx from o join i on i.image=o.image join cameras c on c.frame=i.camera""")
def _(t):
    path = folder(t, "cameras")
    line = lambda *words: F.concat_ws(" ", *(w if not isinstance(w, str) else F.lit(w) for w in words)).alias("value")
    o, p = t.orders, t.part
    t.cameras.select(line(F.col("frame"), "PINHOLE", F.col("width"), F.col("height"), F.col("focal"))).write.text(f"{path}/cameras.txt")
    o.select(line(F.col("o_orderkey"), "1", "0", "0", "0", F.col("o_totalprice"), "0", "0", F.col("o_custkey") % 25, "a.jpg")).write.text(f"{path}/images.txt")
    key, size = F.col("p_partkey"), F.col("p_size")
    p.select(line(key, size, "0", "0", "9", "9", "9", "0.5", key % 1000, size % 7, (key + 3) % 1000, size % 5)).write.text(f"{path}/points3D.txt")
    cameras, images, seen = readers.ingest_camera_text(t.spark, path)
    d = seen.join(images.select("image", "camera", "tx"), "image").join(cameras.select("camera", "width", F.col("params")[0].alias("focal")), "camera")
    return d.select("track", "x", "point", "image", "camera", "width", "focal", "tx")


@query("a5_ingest_frames", """select 'frames/' || c_custkey || '.png' file_path, case when c_custkey % 3 = 0 then 400e0 else 500e0 + c_nationkey end focal, c_acctbal m3, 1e0 * c_custkey m7 from customer""")
def _(t):
    """Manifests of a nation each, one line a file."""
    path, k = folder(t, "manifests"), F.col("c_custkey")
    row = lambda *v: F.array(*(F.lit(x).cast("double") if not hasattr(x, "cast") else x.cast("double") for x in v))
    m = F.array(row(1, 0, 0, F.col("c_acctbal")), row(0, 1, 0, k), row(0, 0, 1, 0), row(0, 0, 0, 1))
    f = F.struct(F.concat(F.lit("frames/"), k, F.lit(".png")).alias("file_path"), F.when(k % 3 == 0, 400.0).alias("fl_x"), m.alias("transform_matrix"))
    d = t.customer.groupBy("c_nationkey").agg(F.collect_list(f).alias("frames")).select(F.col("c_nationkey").alias("manifest"), F.to_json(F.struct((500.0 + F.col("c_nationkey")).alias("fl_x"), "frames")).alias("value"))
    d.repartition(8, "manifest").write.partitionBy("manifest").text(path)
    return readers.ingest_frames_json(t.spark, path).select("file_path", "focal", F.col("matrix")[3].alias("m3"), F.col("matrix")[7].alias("m7"))


TURN = "(event_id % 60)/10e0"


@query("a6_ingest_trajectory", f"""select event_id*1e0 "time", round(cos({TURN}),6)+0 r00, round(sin({TURN}),6)+0 r01, round(-(cos({TURN})*tx + sin({TURN})*ty),6)+0 px, round(-(cos({TURN})*ty - sin({TURN})*tx),6)+0 py, -3e0 pz from (select event_id, event_id % 7 tx, event_id % 11 ty from events) e""")
def _(t):
    path, k = folder(t, "trajectory"), F.col("event_id")
    t.events.select(F.concat_ws(" ", k, F.lit("0"), F.lit("0"), (k % 60) / 10, k % 7, k % 11, F.lit("3")).alias("value")).write.text(path)
    return rounded(readers.ingest_trajectory(t.spark, path).select("time", F.col("rotation")[0].alias("r00"), F.col("rotation")[1].alias("r01"), "px", "py", "pz"))


@query("a7_ingest_annotations", """with f as (select *, case when segment < 0 then 'other' else 'c' || segment end || '_' || (instance % 3) || '.txt' file from points), r as (select scene_id, file, dense_rank() over (partition by scene_id order by file)-1 instance from (select distinct scene_id, file from f) q)
    select cast(f.scene_id as varchar) room, case when segment between 0 and 4 then segment*10 else -1 end segment, r.instance, f.x, f.y, f.z, f.r, f.g, f.b from f join r on f.scene_id=r.scene_id and f.file=r.file""".replace("f.r, f.g, f.b", "f.r*1e0 r, f.g*1e0 g, f.b*1e0 b"))
def _(t):
    path = folder(t, "annotations")

    def render(d):
        lines = "\n".join(f"{x!r} {y!r} {z!r} {r} {g} {b}" for x, y, z, r, g, b in zip(*(d[c].tolist() for c in "xyzrgb")))
        yield f"{d['scene_id'].iloc[0]}/{d['name'].iloc[0]}_{d['k'].iloc[0]}.txt", lines.encode("ascii")

    name = F.when(F.col("segment") < 0, "other").otherwise(F.concat(F.lit("c"), F.col("segment")))
    readers.write_files(t.points.select("scene_id", name.alias("name"), (F.col("instance") % 3).alias("k"), *"xyzrgb"), path, ["scene_id", "name", "k"], render)
    return readers.ingest_annotations(t.spark, path, {f"c{k}": k * 10 for k in range(5)}).select("room", "segment", F.col("instance").cast("long").alias("instance"), *"xyzrgb")


@query("a8_write_chunks", f"{CHUNK} select m.scene_id, chunk_id, count(*) n, 'train_grid2.0_chunk12.0x12.0_stride6.0x6.0' folder from m join k on m.scene_id=k.scene_id and m.wx=k.wx and m.wy=k.wy where chunk_id < 12 group by 1,2")
def _(t):
    out = readers.write_chunks(S.chunk(t.points, 12.0, 6.0, 100, 12), folder(t, "chunks"), 12.0, 6.0, 2.0, "train")
    d = t.spark.read.schema("point_id long, wx long, wy long, scene_id int, chunk_id int").parquet(out).groupBy("scene_id", "chunk_id").agg(F.count("*").alias("n"))
    return d.select("scene_id", F.col("chunk_id").cast("long").alias("chunk_id"), "n", F.lit(out.rsplit("/", 1)[-1]).alias("folder"))


@query("a13_asset_inventory", f"""with f as (select split, scene_id, part, count(*) n from {PARTS} p group by 1,2,3), a as (select split, 'coord' attr, '' "rank", n*24+128 b from f union all select split, 'segment', '16', n*4+128 from f)
    select split, attr, "rank", count(*) files, cast(sum(b) as bigint) bytes, round(sum(b)/max(sum(b)) over (),6) share from a group by rollup(split, attr, "rank")""")
def _(t):
    return rounded(readers.asset_inventory(t.spark, arrays(t)))
