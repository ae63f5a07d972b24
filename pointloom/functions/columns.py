"""Row-wise operators on points: activations, rotations, colours, quantisation, cell codes. All built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def activate(df: DataFrame, logit: str = "opacity_logit", scales=("s0", "s1", "s2")) -> DataFrame:
    """Logit to opacity, log extents to extents."""
    return df.withColumn("opacity", 1 / (1 + F.exp(-F.col(logit)))).withColumns({s: F.exp(s) for s in scales})


def normalize_quat(df: DataFrame, q=("q0", "q1", "q2", "q3")) -> DataFrame:
    """Unit quaternions with a non-negative real part; where the real part is zero all parts become zero."""
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in q[1:]), F.col(q[0]) * F.col(q[0])))
    sign = F.signum(q[0])
    return df.withColumns({c: F.col(c) / size * sign for c in q})


#: Fixed value: the zero-order spherical harmonic.
SH0 = 0.28209479177387814


def dc_to_rgb(c: Column) -> Column:
    """Zero-order coefficient to a colour of 0 to 255, truncated."""
    return (F.least(F.greatest(c * SH0 + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def rgb_to_dc(c: Column) -> Column:
    return (c / 255 - 0.5) / SH0


def clean_attrs(df: DataFrame, opacity: str = "opacity", scales=("s0", "s1", "s2")) -> DataFrame:
    """Opacity at least 0.001, extents from 1e-4 to 1."""
    return df.withColumn(opacity, F.greatest(opacity, F.lit(0.001))).withColumns({s: F.least(F.greatest(s, F.lit(1e-4)), F.lit(1.0)) for s in scales})


def normalize_color(c: Column) -> Column:
    """0 to 255 becomes -1 to 1."""
    return c / 127.5 - 1


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def l2_normalize(v: Column, valid: Column) -> Column:
    """Unit length where valid, untouched elsewhere; the length counts as 1e-8 at least."""
    return F.when(valid, F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-8)))).otherwise(v)


def valid_flag(v: Column) -> Column:
    """Whether any component is not zero."""
    return F.exists(v, lambda x: x != 0)


def quat_to_rotmat(w, x, y, z) -> list[Column]:
    """The nine entries of the rotation of a quaternion, made unit first, row by row."""
    w, x, y, z = map(F.col, (w, x, y, z))
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def covariance(quat=("q0", "q1", "q2", "q3"), scales=("s0", "s1", "s2")) -> dict[str, Column]:
    """The six distinct entries of R S S^T R^T."""
    r, s = quat_to_rotmat(*quat), [F.col(c) * F.col(c) for c in scales]
    entry = lambda i, j: sum((r[3 * i + k] * r[3 * j + k] * s[k] for k in (1, 2)), r[3 * i] * r[3 * j] * s[0])
    return {f"c{i}{j}": entry(i, j) for i in range(3) for j in range(i, 3)}


def transform_points(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Homogeneous 4 x 4 transform of x, y, z, divided by the fourth coordinate."""
    row = lambda m: sum((F.col(c) * float(v) for c, v in zip(XYZ, m)), F.lit(float(m[3])))
    return df.withColumns({c: row(m) / row(matrix[3]) for c, m in zip(XYZ, matrix)})


def rotate(df: DataFrame, axis: str, angle: float, center=(0.0, 0.0, 0.0), normals=(), quat=()) -> DataFrame:
    """Turns points about an axis through ``center``; normals turn alike and orientations are multiplied."""
    c, s = math.cos(angle), math.sin(angle)
    i = XYZ.index(axis)
    a, b = (i + 1) % 3, (i + 2) % 3
    turn = lambda u, v: (u * c - v * s, u * s + v * c)
    u, v = turn(F.col(XYZ[a]) - center[a], F.col(XYZ[b]) - center[b])
    new = {XYZ[a]: u + center[a], XYZ[b]: v + center[b]}
    if normals:
        new |= dict(zip((normals[a], normals[b]), turn(F.col(normals[a]), F.col(normals[b]))))
    if quat:
        hw, hv = math.cos(angle / 2), math.sin(angle / 2)
        w, p, q, r = F.col(quat[0]), F.col(quat[1 + i]), F.col(quat[1 + a]), F.col(quat[1 + b])
        new |= {quat[0]: hw * w - hv * p, quat[1 + i]: hw * p + hv * w, quat[1 + a]: hw * q - hv * r, quat[1 + b]: hw * r + hv * q}
    return df.withColumns(new)


def scale(df: DataFrame, factors, extents=("s0", "s1", "s2")) -> DataFrame:
    """Scales coordinates and extents, by one factor or one per axis."""
    f = [float(factors)] * 3 if isinstance(factors, (int, float)) else list(map(float, factors))
    return df.withColumns({c: F.col(c) * k for c, k in zip((*XYZ, *extents), f * 2)})


def flip(df: DataFrame, axes: str, quat=("q0", "q1", "q2", "q3")) -> DataFrame:
    """Mirrors axes; a mirrored orientation keeps its real part and the component along the axis."""
    for axis in axes:
        i = XYZ.index(axis)
        df = df.withColumns({axis: -F.col(axis)} | ({quat[1 + k]: -F.col(quat[1 + k]) for k in range(3) if k != i} if quat else {}))
    return df


def shift(df: DataFrame, dx=0.0, dy=0.0, dz=0.0) -> DataFrame:
    return df.withColumns({c: F.col(c) + float(d) for c, d in zip(XYZ, (dx, dy, dz))})


def clip_range(df: DataFrame, box) -> DataFrame:
    """Clamps coordinates to (x0, y0, z0, x1, y1, z1)."""
    return df.withColumns({c: F.least(F.greatest(c, F.lit(float(box[i]))), F.lit(float(box[i + 3]))) for i, c in enumerate(XYZ)})


def jitter(df: DataFrame, cols=XYZ, sigma: float = 0.01, clip: float = 0.05, seed: int = 0) -> DataFrame:
    """Adds clipped normal noise."""
    return df.withColumns({c: F.col(c) + F.least(F.greatest(F.randn(seed + i) * sigma, F.lit(-clip)), F.lit(clip)) for i, c in enumerate(cols)})


def drawn(*parts) -> Column:
    """A number from 0 to 1 by the md5 of parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def color_translate(df: DataFrame, ratio: float = 0.1, seed: int = 0, cols=("r", "g", "b")) -> DataFrame:
    """Adds one shift per scene and channel, at most ``ratio`` of 255 either way, within 0 to 255."""
    return df.withColumns({c: F.least(F.greatest(F.col(c) + (drawn(seed, F.col("scene_id"), c) - 0.5) * 2 * 255 * ratio, F.lit(0.0)), F.lit(255.0)) for c in cols})


def gray(r="r", g="g", b="b") -> Column:
    """Luma of a colour."""
    return 0.2989 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)


def clamp255(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))


def with_scene(df: DataFrame, *facts: Column) -> DataFrame:
    """Each row with aggregates of its scene. Tasks sum up their own rows and the few rows of scenes go to all, so no task sorts a scene.
    Rows without a scene are one, as in a window."""
    d = df.groupBy(F.col("scene_id").alias("_scene")).agg(*facts)
    return df.join(F.broadcast(d), F.col("scene_id").eqNullSafe(F.col("_scene"))).drop("_scene")


def color_adjust(df: DataFrame, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0, hue: float = 0.0) -> DataFrame:
    """Brightness, contrast against the scene's mean luma, saturation against the own luma, then hue (turns of the circle)."""
    rgb = ("r", "g", "b")
    df = df.withColumns({c: clamp255(F.col(c) * float(brightness)) for c in rgb})
    df = with_scene(df, F.avg(gray()).alias("_mean")) if contrast != 1.0 else df.withColumn("_mean", F.lit(0.0))
    df = df.withColumns({c: clamp255(F.col(c) * contrast + F.col("_mean") * (1 - contrast)) for c in rgb}).drop("_mean")
    df = df.withColumn("_luma", gray())
    df = df.withColumns({c: clamp255(F.col(c) * saturation + F.col("_luma") * (1 - saturation)) for c in rgb}).drop("_luma")
    return df if not hue else turn_hue(df, hue)


def turn_hue(df: DataFrame, hue: float) -> DataFrame:
    """Turns the hue by a part of the circle: to hue, saturation and value and back."""
    r, g, b = F.col("r") / 255, F.col("g") / 255, F.col("b") / 255
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(top > low, top - low).otherwise(F.lit(1.0))
    h = F.when(top == low, F.lit(0.0)).when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    df = df.withColumns({"_h": h + hue - F.floor(h + hue), "_s": F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0)), "_v": top})
    i = F.floor(F.col("_h") * 6)
    f, v, s = F.col("_h") * 6 - i, F.col("_v"), F.col("_s")
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    pick = lambda *c: F.element_at(F.array(*c), (i % 6 + 1).cast("int"))
    return df.withColumns({"r": pick(v, q, p, p, t, v) * 255, "g": pick(t, v, v, q, p, p) * 255, "b": pick(p, p, t, v, v, q) * 255}).drop("_h", "_s", "_v")


def slog(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def sexp(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def quantize(df: DataFrame, cols, bits: int = 8) -> DataFrame:
    """Min-max codes of 2^bits levels, halves to even, with the range of each column beside them (``c_lo``, ``c_hi``)."""
    ends = df.agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    top = 2**bits - 1
    code = lambda c: F.bround((F.col(c) - F.col(f"{c}_lo")) / F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(1e-12)) * top).cast("int")
    return df.join(F.broadcast(ends)).withColumns({f"{c}_code": code(c) for c in cols})


def dequantize(df: DataFrame, cols, bits: int = 8) -> DataFrame:
    top = 2**bits - 1
    return df.withColumns({f"{c}_back": F.col(f"{c}_code") / top * (F.col(f"{c}_hi") - F.col(f"{c}_lo")) + F.col(f"{c}_lo") for c in cols})


def spread_bits(c: Column, depth: int) -> Column:
    """Puts two zero bits before each bit."""
    out = F.lit(0).cast("long")
    for k in range(depth):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 3 * k))
    return out


def morton(cx: Column, cy: Column, cz: Column, depth: int = 16, swapped: bool = False) -> Column:
    """The z-order code, x in the highest bit of each triple; ``swapped`` exchanges x and y."""
    a, b = (cy, cx) if swapped else (cx, cy)
    return F.shiftleft(spread_bits(a, depth), 2).bitwiseOR(F.shiftleft(spread_bits(b, depth), 1)).bitwiseOR(spread_bits(cz, depth))


def unmorton(code: Column, depth: int = 16) -> list[Column]:
    """Cell coordinates of a z-order code."""
    one = F.lit(1).cast("long")
    return [sum((F.shiftleft(F.shiftright(code, 3 * k + s).bitwiseAND(one), k) for k in range(1, depth)), F.shiftright(code, s).bitwiseAND(one)) for s in (2, 1, 0)]


def voxel_coord(df: DataFrame, size: float, mode: str = "lattice") -> DataFrame:
    """Cell coordinates cx, cy, cz. ``lattice``: floor(x / size) less its scene minimum; ``origin``: the scene minimum is
    taken off first, then whole cells."""
    d = with_scene(df, *(F.min(c).alias(f"_{c}") for c in XYZ))
    cell = lambda c: F.floor(F.col(c) / size) - F.floor(F.col(f"_{c}") / size)
    shifted = lambda c: F.floor((F.col(c) - F.col(f"_{c}")) / size)
    return d.withColumns({f"c{c}": (cell if mode == "lattice" else shifted)(c).cast("long") for c in XYZ}).drop(*(f"_{c}" for c in XYZ))


def cell(df: DataFrame, size: float) -> DataFrame:
    """Cell coordinates without any shift: no window, so no shuffle."""
    return df.withColumns({f"c{c}": F.floor(F.col(c) / size).cast("long") for c in XYZ})


def displacement(df: DataFrame, size: float) -> DataFrame:
    """How far a point stands from the centre of its cell, in cells."""
    return df.withColumns({f"d{c}": F.col(c) / size - F.floor(F.col(c) / size) - 0.5 for c in XYZ})


def gauss_weight(d2: Column, a: float = 1.0, c: float = 1.0) -> Column:
    return a * F.exp(-d2 / (2 * c * c))


def yaw(w, x, y, z) -> Column:
    """The turn about z of a quaternion."""
    w, x, y, z = map(F.col, (w, x, y, z))
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def tanh_strength(c: Column) -> Column:
    return F.tanh(c)


def collect_features(*cols: Column) -> Column:
    """Scalars and arrays in the order given, as one array of doubles."""
    return F.concat(*(c if isinstance(c, Column) else F.array(F.col(c).cast("double")) for c in cols))


#: Real spherical harmonics up to degree 3.
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def eval_sh(sh: list[Column], x: Column, y: Column, z: Column) -> Column:
    """Colour for a unit direction; the number of coefficients (1, 4, 9, 16) gives the degree."""
    xx, yy, zz = x * x, y * y, z * z
    basis = [F.lit(SH0), -SH1 * y, SH1 * z, -SH1 * x]
    basis += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2 * zz - xx - yy), SH2[3] * x * z, SH2[4] * (xx - yy)]
    basis += [SH3[0] * y * (3 * xx - yy), SH3[1] * x * y * z, SH3[2] * y * (4 * zz - xx - yy), SH3[3] * z * (2 * zz - 3 * xx - 3 * yy), SH3[4] * x * (4 * zz - xx - yy), SH3[5] * z * (xx - yy), SH3[6] * x * (xx - 3 * yy)]
    return sum((c * b for c, b in zip(sh[1:], basis[1:])), sh[0] * basis[0])


def project(points: DataFrame, focal="focal", width="width", height="height", near: float = 0.01, far: float = 1e10) -> DataFrame:
    """Pinhole projection of points that already carry a camera (c, s: its yaw; px, py, pz: its place, looking inwards):
    depth, u, v and whether the point is seen."""
    dx, dy, dz = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("z") - F.col("pz")
    depth = -(F.col("c") * dx + F.col("s") * dy)
    right, down = -(F.col("c") * dy - F.col("s") * dx), -dz
    u, v = F.col(focal) * right / depth + F.col(width) / 2, F.col(focal) * down / depth + F.col(height) / 2
    df = points.withColumns({"depth": depth, "u": u, "v": v})
    return df.withColumn("seen", (F.col("depth") > near) & (F.col("depth") < far) & (F.col("u") >= 0) & (F.col("u") < F.col(width)) & (F.col("v") >= 0) & (F.col("v") < F.col(height)))


def unproject(pixels: DataFrame, ray: bool = False, focal="focal", width="width", height="height") -> DataFrame:
    """Depth pixels to world points; ``ray`` depth runs along the ray, else along the view axis. The inverse of project."""
    a, b = (F.col("u") + 0.5 - F.col(width) / 2) / F.col(focal), (F.col("v") + 0.5 - F.col(height) / 2) / F.col(focal)
    d = F.col("depth") / F.sqrt(1 + a * a + b * b) if ray else F.col("depth")
    c, s = F.col("c"), F.col("s")
    return pixels.withColumns({"x": F.col("px") - c * d + s * a * d, "y": F.col("py") - s * d - c * a * d, "z": F.col("pz") - b * d})


def unproject_pano(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Panorama pixels to points: u is the turn, v runs from the zenith down."""
    th, ph = 2 * math.pi * (F.col("u") + 0.5) / width - math.pi, math.pi / 2 - math.pi * (F.col("v") + 0.5) / height
    return pixels.withColumns({"x": F.col("depth") * F.cos(ph) * F.sin(th), "y": F.col("depth") * F.cos(ph) * F.cos(th), "z": F.col("depth") * F.sin(ph)})


def hilbert(df: DataFrame, depth: int = 16, out: str = "code", swapped: bool = False) -> DataFrame:
    """Hilbert code of the cells cx, cy, cz, in Arrow batches."""
    from pointloom.functions.curves import hilbert_encode

    a, b = ("cy", "cx") if swapped else ("cx", "cy")
    return df.withColumn(out, hilbert_encode(depth)(F.col(a), F.col(b), F.col("cz")))
