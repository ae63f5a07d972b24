"""Reading scenes, cameras, manifests, trajectories and annotations into tables."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.operators.sampling import draw

#: Bytes of array and vertex files that one task reads, and the rows that it holds at a time.
TASK_BYTES = 128 << 20
READ_ROWS = 16_384


def read_points(spark: SparkSession, path: str, split: str | None = None, columns=None) -> DataFrame:
    """Labelled points partitioned by split and scene_id; unknown columns are left out, missing labels become -1."""
    df = spark.read.parquet(path)
    df = df if split is None else df.where(F.col("split") == split)
    keep = [c for c in (columns or df.columns) if c in df.columns]
    df = df.select(*keep)
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("segment", "instance") if c in keep} | {c: F.lit(-1) for c in ("segment", "instance") if columns and c in columns and c not in keep})


def files(spark: SparkSession, path: str, pattern: str, content: bool = True) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d if content else d.select("path", "modificationTime", "length")


def write_files(df: DataFrame, path: str, keys, render) -> None:
    """One or more files per group of ``keys``: ``render`` gives (name below ``path``, bytes) for a group's rows. Tasks write
    them where the session's files are; a group has to fit one task, as its file has to fit one reader."""
    from pyarrow import fs

    base = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path

    def run(d: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        n = 0
        for name, raw in render(d):
            store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(raw)
            n += 1
        return pd.DataFrame({"files": [n]})

    df.groupBy(*keys).applyInPandas(run, "files int").agg(F.sum("files")).collect()


def array_bytes(values) -> bytes:
    """An array file."""
    out = io.BytesIO()
    np.save(out, np.asarray(values), allow_pickle=False)
    return out.getvalue()


def ply_bytes(d: pd.DataFrame) -> bytes:
    """A binary vertex file with one double per column."""
    head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (len(d), "".join(f"property double {c}\n" for c in d.columns))
    return head.encode("ascii") + np.ascontiguousarray(d.to_numpy(dtype="<f8")).tobytes()


def opened(path: str):
    """A file of the session's storage, to be read at any place."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def ranges(listed: DataFrame, task_bytes: int) -> DataFrame:
    """Rows of files (with ``length``) once for each ``task_bytes`` that begin in the file, as ``start``, dealt to about as many
    tasks as the bytes fill. Only the sum of lengths reaches the driver."""
    total = listed.agg(F.sum("length")).first()[0] or 0
    return listed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), "length", F.lit(task_bytes).cast("long")))).repartition(max(1, -(-total // task_bytes)))


@dataclass(frozen=True)
class Rows:
    """Rows of equal width in a file: where they begin, how many there are, and, if they lie column by column, the place of each."""

    at: int
    n: int
    dtype: np.dtype
    columns: int = 1
    places: tuple[int, ...] | None = None

    def whole(self, f) -> Rows:
        """These rows, if the file has them all."""
        if f.size() < self.at + self.n * self.dtype.itemsize * self.columns:
            raise ValueError("the file ends before its last row")
        return self

    def begin(self, byte: int) -> int:
        """The first row that begins at ``byte`` of the file or after it."""
        width = self.dtype.itemsize * self.columns
        return min(self.n, max(0, -(-(byte - self.at) // width))) if width else self.n * (byte > self.at)

    def read(self, f, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` as last - first by ``columns`` values, as many as the file has of them."""
        n, size = max(first, min(last, self.n)) - first, self.dtype.itemsize
        part = lambda value, count: np.frombuffer(f.read_at(count * size, self.at + value * size) if count else b"", self.dtype)
        if self.places is None:
            return part(first * self.columns, n * self.columns).reshape(n, self.columns)
        return np.stack([part(k * self.n + first, n) for k in self.places], axis=1)


def array_rows(f) -> Rows:
    """What the header of an array file says."""
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or not shape:
        raise ValueError("an array file of numbers, with rows, is needed")
    columns = int(np.prod(shape[1:], dtype=np.int64))
    places = tuple(np.arange(columns).reshape(shape[1:], order="F").ravel().tolist()) if by_column and columns > 1 else None
    return Rows(f.tell(), shape[0], dtype, columns, places).whole(f)


def ingest_arrays(spark: SparkSession, path: str, attributes, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Scenes stored as folders of one array file per attribute (row i of each is point i): scene, row, and one array column
    per attribute. The rows are those of the first attribute; others are null where their file is missing or shorter.

    A task takes the rows of some ``task_bytes`` of the first attribute's file and the same rows of the others, by offset, so
    large files are shared by many tasks, nothing is joined, and files of other attributes are never opened. A file that is
    shorter than its header says is an error; a file of no rows gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = dict(r["files"])
                with ExitStack() as stack:
                    of = {}
                    for name in attributes:
                        if name in held:
                            f = stack.enter_context(opened(held[name]))
                            of[name] = (f, array_rows(f))
                    lead = of[attributes[0]][1]
                    first, end = lead.begin(r["start"]), lead.begin(r["start"] + task_bytes)
                    for i in range(first, end, READ_ROWS):
                        j = min(i + READ_ROWS, end)
                        columns = [pa.array([r["scene"]] * (j - i)), pa.array(np.arange(i, j))]
                        for name in attributes:
                            f, rows = of.get(name, (None, None))
                            got = rows.read(f, min(i, rows.n), j).astype(np.float64) if rows else np.empty((0, 1))
                            sizes = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
                            column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(got.ravel()))
                            columns.append(pa.concat_arrays([column, pa.nulls(j - i - len(got), column.type)]))
                        yield pa.RecordBatch.from_arrays(columns, names=["scene", "row", *attributes])

    listed = files(spark, path, "*.npy", content=False).select("path", "length", F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("attr"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("at"))
    scenes = listed.where(F.col("attr").isin(list(attributes))).groupBy("at").agg(F.max(F.when(F.col("attr") == attributes[0], F.col("length"))).alias("length"), F.map_from_entries(F.collect_list(F.struct("attr", "path"))).alias("files"))
    scenes = scenes.where("length is not null").select(F.element_at(F.split("at", "/"), -1).alias("scene"), "length", "files")
    return ranges(scenes, task_bytes).mapInArrow(run, "scene string, row long, " + ", ".join(f"`{a}` array<double>" for a in attributes))


PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "float32": "f4", "float64": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4"}


def vertex_rows(f) -> tuple[Rows, int | None]:
    """Where the vertices of a file are, as its header says. Elements before them have to be of equal width each. If they are
    text, ``at`` counts lines in place of bytes, and where the lines begin comes second, else None."""
    head = f.read(4096)
    while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
        more = f.read(4096)
        if not more:
            raise ValueError("the file has no whole header")
        head += more
    body = at = head.index(b"\n", head.index(b"end_header")) + 1
    kind, elements = "ascii", []
    for w in map(str.split, head[:body].decode("ascii", "replace").splitlines()):
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], None if w[1] == "list" else (">" if kind == "binary_big_endian" else "<") + PLY_TYPES[w[1]]))
    text = kind == "ascii"
    at = 0 if text else at
    for name, n, fields in elements:
        if any(t is None for _, t in fields):
            raise ValueError(f"lists in or before the vertices ({name})")
        rows = Rows(at, n, np.dtype(fields))
        if name == "vertex":
            return (rows, body) if text else (rows.whole(f), None)
        at += n * (1 if text else rows.dtype.itemsize)
    return Rows(at, 0, np.dtype("f8")), None


def text_rows(f, rows: Rows, body: int) -> Iterator[tuple[int, np.ndarray]]:
    """Vertices that are lines of text, some at a time, with the place of the first; the lines begin at ``body``."""
    f.seek(body)
    lines = islice(io.TextIOWrapper(f, encoding="ascii"), rows.at, rows.at + rows.n)
    first = 0
    while part := list(islice(lines, READ_ROWS)):
        yield first, np.array([tuple(map(float, line.split()[: len(rows.dtype)])) for line in part], dtype=rows.dtype)
        first += len(part)


def ingest_ply(spark: SparkSession, path: str, columns=("x", "y", "z"), task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, row and the named vertex properties as doubles, null where a file lacks one.

    A task takes the vertices that begin in ``task_bytes`` of a binary file, little or big end first, so a large one is shared by
    many tasks; only the named properties leave it. Text has no row width: one task reads a text file, some lines at a time. A
    file that is shorter than its header says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    rows, body = vertex_rows(f)
                    if body is not None:
                        parts = text_rows(f, rows, body) if r["start"] == 0 else ()
                    else:
                        first, end = rows.begin(r["start"]), rows.begin(r["start"] + task_bytes)
                        parts = ((i, rows.read(f, i, min(i + READ_ROWS, end))[:, 0]) for i in range(first, end, READ_ROWS))
                    for i, v in parts:
                        values = [pa.array(v[c].astype(np.float64)) if c in v.dtype.names else pa.nulls(len(v), pa.float64()) for c in columns]
                        yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(v)), pa.array(np.arange(i, i + len(v))), *values], names=["file", "row", *columns])

    listed = files(spark, path, "*.ply", content=False).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    return ranges(listed, task_bytes).mapInArrow(run, "file string, row long, " + ", ".join(f"`{c}` double" for c in columns))


def ingest_camera_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cameras.txt, images.txt and points3D.txt of a folder: cameras, images and track observations (image, track, u, v)."""
    lines = lambda n: spark.read.text(f"{path}/{n}.txt").where("value not like '#%' and value <> ''")
    w = F.split("value", " +")
    cameras = lines("cameras").select(w[0].cast("int").alias("camera"), w[1].alias("model"), w[2].cast("int").alias("width"), w[3].cast("int").alias("height"), F.transform(F.slice(w, 5, 100), lambda x: x.cast("double")).alias("params"))
    # image lines have ten words; the line after each holds triples, so ten words are never points
    pose = lines("images").where(F.size(w) == 10)
    images = pose.select(w[0].cast("int").alias("image"), *(w[k].cast("double").alias(c) for k, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), 1)), w[8].cast("int").alias("camera"), w[9].alias("name"))
    points = lines("points3D").select(w[0].cast("long").alias("track"), *(w[k].cast("double").alias(c) for k, c in enumerate("xyz", 1)), F.slice(w, 9, 100000).alias("t"))
    pairs = points.select("track", "x", "y", "z", F.posexplode("t").alias("k", "v"), "t").where("k % 2 = 0")
    return cameras, images, pairs.select("track", "x", "y", "z", F.col("v").cast("int").alias("image"), F.expr("cast(t[k + 1] as int)").alias("point"))


def ingest_frames_json(spark: SparkSession, path: str) -> DataFrame:
    """Frame manifests: file, frame path, focal and matrix (16 numbers); intrinsics of the file serve frames without their own."""
    schema = "fl_x double, frames array<struct<file_path:string,fl_x:double,transform_matrix:array<array<double>>>>"
    d = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    return d.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("fl_x").alias("_f"), F.explode("frames").alias("f")).select("file", "f.file_path", F.coalesce("f.fl_x", "_f").alias("focal"), F.flatten("f.transform_matrix").alias("matrix"))


def ingest_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Lines of time, rotation vector and translation, world to camera: time, the inverse rotation (9 numbers) and the centre."""
    w = F.split(F.trim("value"), " +")
    d = spark.read.text(path).where(F.size(w) == 7).select(*(w[k].cast("double").alias(c) for k, c in enumerate(("time", "rx", "ry", "rz", "tx", "ty", "tz"))))
    a = F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2 + F.col("rz") ** 2)
    k = [F.col(c) / F.greatest(a, F.lit(1e-12)) for c in ("rx", "ry", "rz")]
    c, s = F.cos(a), F.sin(a)
    cross = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    rot = [[(c if i == j else F.lit(0.0)) + s * cross[i][j] + (1 - c) * k[i] * k[j] for j in range(3)] for i in range(3)]
    back = [rot[j][i] for i in range(3) for j in range(3)]
    centre = [-(rot[0][i] * F.col("tx") + rot[1][i] * F.col("ty") + rot[2][i] * F.col("tz")) for i in range(3)]
    return d.select("time", F.array(*back).alias("rotation"), *(v.alias(f"p{n}") for v, n in zip(centre, "xyz")))


def ingest_annotations(spark: SparkSession, path: str, classes: dict, default: int = -1) -> DataFrame:
    """Point lines in files named class_k.txt: room, class id by name, instance by rank of the file, x, y, z, r, g, b."""
    w = F.split(F.trim("value"), " +")
    d = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("file", F.input_file_name()).where(F.size(w) >= 6)
    part = lambda k: F.element_at(F.split("file", "/"), k)
    names = spark.createDataFrame(list(classes.items()), "name string, segment int")
    d = d.select(part(-2).alias("room"), part(-1).alias("file"), F.regexp_extract(part(-1), r"^([^_]+)_", 1).alias("name"), *(w[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "r", "g", "b"))))
    ranks = d.select("room", "file").distinct().withColumn("instance", F.dense_rank().over(Window.partitionBy("room").orderBy("file")) - 1)
    return d.join(names, "name", "left").join(ranks, ["room", "file"]).withColumn("segment", F.coalesce("segment", F.lit(default))).drop("file", "name")


def concat_datasets(dfs, loop: int = 1) -> DataFrame:
    """Datasets under each other, missing columns null, every row ``loop`` times."""
    from functools import reduce

    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return d if loop == 1 else d.withColumn("loop", F.explode(F.sequence(F.lit(1), F.lit(loop))))


def assign_split(df: DataFrame, rule, key: str = "scene_id") -> DataFrame:
    """Adds split: by a list of (name, first, last) id ranges, or by a table (key, split); the rest is train."""
    if isinstance(rule, DataFrame):
        return df.join(rule, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))
    out = F.lit("train")
    for name, lo, hi in rule:
        out = F.when(F.col(key).between(lo, hi), name).otherwise(out)
    return df.withColumn("split", out)


def asset_inventory(spark: SparkSession, path: str, exclude: str = r"^$") -> DataFrame:
    """Bytes and files by split and attribute with sub-totals, and the share of all: from file listings, no content is read."""
    d = files(spark, path, "*", content=False).where(~F.col("path").rlike(exclude))
    d = d.select("length", F.element_at(F.split("path", "/"), -3).alias("split"), F.regexp_extract("path", r"/([^/]+?)(?:_r(\d+))?\.[^./]+$", 1).alias("attr"), F.regexp_extract("path", r"_r(\d+)\.[^./]+$", 1).alias("rank"))
    return d.rollup("split", "attr", "rank").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).withColumn("share", F.col("bytes") / F.max("bytes").over(Window.partitionBy()))


def holdout(frames: DataFrame, n: int, mode: str = "every", seed: int = 0, name: str = "name") -> DataFrame:
    """Adds held: every n-th frame of a scene by name, or ``n`` drawn ones."""
    order = [F.col(name)] if mode == "every" else [draw(seed, name), F.col(name)]
    at = F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)) - 1
    return frames.withColumn("held", at % n == 0 if mode == "every" else at < n)


def write_chunks(chunks: DataFrame, path: str, size: float, stride: float, voxel: float, split: str) -> str:
    """Chunks as Parquet under a name that tells how they were cut, partitioned by scene and chunk; returns the folder."""
    out = f"{path}/{split}_grid{voxel}_chunk{size}x{size}_stride{stride}x{stride}"
    chunks.write.mode("overwrite").partitionBy("scene_id", "chunk_id").parquet(out)
    return out


def predictions(df: DataFrame, class2id: DataFrame) -> DataFrame:
    """Predicted classes as output ids, top-k lists alike; unknown ones become -1. df: ..., pred, topk (array); class2id: class, id."""
    table = class2id.agg(F.map_from_entries(F.collect_list(F.struct("class", "id"))).alias("_m"))
    to = lambda c: F.coalesce(F.col("_m")[c], F.lit(-1))
    return df.join(F.broadcast(table)).withColumns({"pred": to(F.col("pred")), "topk": F.transform("topk", to)}).drop("_m")


def write_predictions(df: DataFrame, class2id: DataFrame, path: str) -> None:
    predictions(df, class2id).write.mode("overwrite").partitionBy("scene_id").parquet(path)


def write_scene_meta(df: DataFrame, size: float, path: str) -> None:
    """One JSON line of cell statistics per scene."""
    from pointloom.operators.aggregate import grid_stats

    grid_stats(df, size).write.mode("overwrite").json(path)
