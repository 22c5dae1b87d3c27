"""Mesh basics over vertices(mesh_id, vid, x, y, z) and faces(mesh_id, fid, v0, v1, v2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import numbered

AXES = ("x", "y", "z")


def corners_of(v: DataFrame, f: DataFrame) -> DataFrame:
    """faces with x0..z2, the coordinates of their corners: one join of exploded corners, pivoted back by an aggregate. Corners are dealt by face
    before it: a partial aggregate of them would send three rows as wide as its result for each face."""
    one = f.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).join(v.select("mesh_id", "vid", *AXES), ["mesh_id", "vid"])
    picks = [F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in AXES]
    picks += [F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)]
    return one.repartition("mesh_id", "fid").groupBy("mesh_id", "fid").agg(*picks)


def cross() -> tuple[Column, Column, Column]:
    """(p1 - p0) x (p2 - p0) of corners_of's columns."""
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in AXES] for k in (1, 2))
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def face_geometry(v: DataFrame, f: DataFrame, *also: str) -> DataFrame:
    """fid, cx, cy, cz (cross product), area, nx, ny, nz (unit or zero), mx, my, mz (centroid), and the named columns of corners_of()."""
    c = corners_of(v, f).select("mesh_id", "fid", *also, *[x.alias(f"c{a}") for a, x in zip(AXES, cross(), strict=True)], *[((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3).alias(f"m{a}") for a in AXES])
    length = F.sqrt(sum((F.col(f"c{a}").cast("double") * F.col(f"c{a}") for a in AXES), F.lit(0.0)))
    c = c.withColumn("area", length / 2)
    return c.select("*", *[F.when(F.col("area") > 0.5e-10, F.col(f"c{a}") / (2 * F.col("area"))).otherwise(0.0).alias(f"n{a}") for a in AXES])


def vertex_normals(v: DataFrame, f: DataFrame) -> DataFrame:
    """v with nx, ny, nz: sums of incident cross products, normalised; +Y where that vanishes or no face is incident."""
    c = corners_of(v, f).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[x.alias(f"c{a}") for a, x in zip(AXES, cross(), strict=True)])
    s = c.groupBy("mesh_id", "vid").agg(*[F.sum(f"c{a}").alias(f"s{a}") for a in AXES])
    square = sum((F.col(f"s{a}").cast("double") * F.col(f"s{a}") for a in AXES), F.lit(0.0))
    up = {"x": 0.0, "y": 1.0, "z": 0.0}
    return v.join(s, ["mesh_id", "vid"], "left").select(*v.columns, *[F.when(square > 1e-20, F.col(f"s{a}") / F.sqrt(square)).otherwise(up[a]).alias(f"n{a}") for a in AXES])


def surface_area(v: DataFrame, f: DataFrame) -> DataFrame:
    return face_geometry(v, f).groupBy("mesh_id").agg(F.sum("area").alias("area"))


def bounding_box(points: DataFrame) -> DataFrame:
    """Per mesh: min, max, center and extent of each axis, and the diagonal."""
    b = points.groupBy("mesh_id").agg(*[g(a).alias(f"{n}_{a}") for a in AXES for n, g in (("min", F.min), ("max", F.max))])
    size = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]
    return b.select("*", *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"center_{a}") for a in AXES], *[s.alias(f"extent_{a}") for a, s in zip(AXES, size, strict=True)], F.sqrt(sum((s.cast("double") * s for s in size), F.lit(0.0))).alias("diagonal"))


def rotation(q: tuple[float, float, float, float]) -> list[list[float]]:
    """Matrix of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def transform(v: DataFrame, q: tuple[float, float, float, float], t: tuple[float, float, float]) -> DataFrame:
    """Rotates, then moves; normals are only rotated."""
    m = rotation(q)
    turn = lambda names, move: [sum((F.lit(r[i]) * F.col(n) for i, n in enumerate(names)), F.lit(s)).alias(names[k]) for k, (r, s) in enumerate(zip(m, move, strict=True))]
    normals = turn(["nx", "ny", "nz"], (0.0, 0.0, 0.0)) if "nx" in v.columns else []
    rest = [c for c in v.columns if c not in (*AXES, "nx", "ny", "nz")]
    return v.select(*rest, *turn(list(AXES), t), *normals)


def centred(v: DataFrame) -> DataFrame:
    """Moves each mesh's box centre to the origin, unless it is there already (square distance up to 1e-10)."""
    c = bounding_box(v).select("mesh_id", *[f"center_{a}" for a in AXES])
    far = sum((F.col(f"center_{a}") * F.col(f"center_{a}") for a in AXES), F.lit(0.0)) > 1e-10
    rest = [k for k in v.columns if k not in AXES]
    return v.join(c, "mesh_id").select(*rest, *[F.when(far, F.col(a) - F.col(f"center_{a}")).otherwise(F.col(a)).alias(a) for a in AXES])


def weld(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of corners(mesh_id, corner_idx, x, y, z): exact equality, ids by first appearance; -0 is 0."""
    c = corners.select("mesh_id", "corner_idx", *[(F.col(a) + 0).alias(a) for a in AXES])
    first = c.groupBy("mesh_id", *AXES).agg(F.min("corner_idx").alias("first"))
    v = numbered(first, ["first"], "vid")
    at = c.join(v, ["mesh_id", *AXES]).select("mesh_id", F.floor(F.col("corner_idx") / 3).cast("long").alias("fid"), (F.col("corner_idx") % 3).alias("k"), "vid")
    f = at.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])
    return v.select("mesh_id", "vid", *AXES), f


def compact(v: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only used vertices, numbered by first appearance in the order of (fid, corner); faces numbered by fid."""
    one = f.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    used = numbered(one.groupBy("mesh_id", "vid").agg(F.min(F.struct("fid", "k")).alias("first")), ["first"], "new").drop("first")
    faces = numbered(f.select("mesh_id", "fid"), ["fid"], "new_fid")
    moved = one.join(used, ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("new"))).alias(f"v{k}") for k in range(3)])
    out = moved.join(faces, ["mesh_id", "fid"]).select("mesh_id", F.col("new_fid").alias("fid"), "v0", "v1", "v2")
    return v.join(used, ["mesh_id", "vid"]).withColumn("vid", F.col("new")).drop("new"), out


def split(v: DataFrame, f: DataFrame, selected: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(kept, hidden) meshes by a selection(mesh_id, fid); border vertices are in both."""
    return compact(v, f.join(selected, ["mesh_id", "fid"], "left_anti")), compact(v, f.join(selected, ["mesh_id", "fid"], "left_semi"))


def combine(v: DataFrame, f: DataFrame, v2: DataFrame, f2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second mesh behind the first: ids shifted by the first's counts, per mesh_id."""
    nv = v.groupBy("mesh_id").agg((F.max("vid") + 1).alias("nv"))
    nf = f.groupBy("mesh_id").agg((F.max("fid") + 1).alias("nf"))
    shift = lambda df, cols, n: df.select(*[(F.col(c) + F.coalesce(n, F.lit(0))).alias(c) if c in cols else c for c in df.columns if c not in ("nv", "nf")])
    v2 = shift(v2.join(nv, "mesh_id", "left"), ("vid",), F.col("nv"))
    both = f2.join(nv, "mesh_id", "left").join(nf, "mesh_id", "left")
    both = both.select("mesh_id", (F.col("fid") + F.coalesce("nf", F.lit(0))).alias("fid"), *[(F.col(f"v{k}") + F.coalesce("nv", F.lit(0))).alias(f"v{k}") for k in range(3)])
    return v.select(*v2.columns).unionByName(v2), f.unionByName(both)


def selection_points(v: DataFrame, f: DataFrame, selected: DataFrame) -> DataFrame:
    """Corner points of selected faces, a vertex once for each of them."""
    s = f.join(selected, ["mesh_id", "fid"], "left_semi").select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    return s.join(v, ["mesh_id", "vid"])


def strided(points: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """Every ceil(n / cap)-th point of each mesh, from the first."""
    n = points.groupBy("mesh_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / cap)).alias("stride"))
    return numbered(points, order, "at").join(n, "mesh_id").where(F.col("at") % F.col("stride") == 0).drop("at", "stride")


def sample_surface(v: DataFrame, f: DataFrame, n: int, seed: int = 0, masked: DataFrame | None = None) -> DataFrame:
    """About n points spread by area: each face gets its whole share of n, and one more by a hash with its remainder's chance."""
    g = corners_of(v, f if masked is None else f.join(masked, ["mesh_id", "fid"], "left_anti"))
    square = reduce(lambda a, b: a + b, [c.cast("double") * c for c in cross()])
    g = g.withColumn("area", F.sqrt(square) / 2)
    total = g.groupBy("mesh_id").agg(F.sum("area").alias("total")).where("total > 1e-12")
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), "mesh_id", "fid", *c), F.lit(1 << 53)) / float(1 << 53)
    want = g.join(total, "mesh_id").withColumn("share", F.col("area") / F.col("total") * n)
    want = want.withColumn("times", (F.floor("share") + F.when(unit(F.lit("n")) < F.col("share") - F.floor("share"), 1).otherwise(0)).cast("int")).where("times > 0")
    p = want.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")).withColumn("a", unit("i", F.lit("a"))).withColumn("b", unit("i", F.lit("b")))
    flip = F.col("a") + F.col("b") > 1
    a, b = F.when(flip, 1 - F.col("a")).otherwise(F.col("a")), F.when(flip, 1 - F.col("b")).otherwise(F.col("b"))
    return p.select("mesh_id", "fid", "i", *[(F.col(f"{c}0") + a * (F.col(f"{c}1") - F.col(f"{c}0")) + b * (F.col(f"{c}2") - F.col(f"{c}0"))).alias(c) for c in AXES])
