"""Writers of mesh files and CAD text. Formats of one file per mesh: rows are made on the cluster, in order, and put together once."""

from __future__ import annotations

import numpy as np
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, numbered
from ..operators.mesh import AXES, corners_of, cross, vertex_normals


def number(c: Column) -> Column:
    """Six decimals without trailing zeros and dot."""
    s = F.format_string("%.6f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def obj_lines(v: DataFrame, f: DataFrame) -> DataFrame:
    """mesh_id, part, at, line of an OBJ file; ids count from 1."""
    n = vertex_normals(v, f)
    line = lambda key, cols: F.concat_ws(" ", F.lit(key), *cols)
    ref = lambda c: F.concat((F.col(c) + 1).cast("string"), F.lit("//"), (F.col(c) + 1).cast("string"))
    return (
        v.select("mesh_id", F.lit(0).alias("part"), F.col("vid").alias("at"), line("v", [number(F.col(a)) for a in AXES]).alias("line"))
        .union(n.select("mesh_id", F.lit(1), "vid", line("vn", [number(F.col(f"n{a}")) for a in AXES])))
        .union(f.select("mesh_id", F.lit(2), "fid", line("f", [ref(f"v{k}") for k in range(3)])))
    )


def dxf_circle_segments(circles: DataFrame, n: int = 64) -> DataFrame:
    """n line segments around each circle (feature_id, center, u, v, radius): ax..bz."""
    at = circles.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    r = F.greatest(F.col("radius"), F.lit(0.01))
    angle = lambda k: k * (2 * np.pi / n)
    point = lambda a, k: F.col(f"center.{a}") + r * (F.cos(angle(k)) * F.col(f"u.{a}") + F.sin(angle(k)) * F.col(f"v.{a}"))
    return at.select("feature_id", "k", *[point(a, F.col("k")).alias(f"a{a}") for a in AXES], *[point(a, F.col("k") + 1).alias(f"b{a}") for a in AXES])


def dense(v: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered from 0 by vid, and faces with those numbers: files refer to rows by their place."""
    named = cut(numbered(v, ["vid"], "place"))
    ids = named.select("mesh_id", "vid", "place")
    for k in range(3):
        f = f.join(ids.withColumnsRenamed({"vid": f"v{k}", "place": f"p{k}"}), ["mesh_id", f"v{k}"])
    return named.drop("vid").withColumnRenamed("place", "vid"), cut(f.select("mesh_id", "fid", *[F.col(f"p{k}").alias(f"v{k}") for k in range(3)]))


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs.open_output_stream(name)


def write_mesh(v: DataFrame, f: DataFrame, mesh_id: str, path: str) -> None:
    """One mesh as one file, by its ending. Rows stream to the driver partition by partition, in order."""
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ("obj", "stl", "ply"):
        raise ValueError(f"Unsupported export type: {end}")
    v, f = dense(v.where(F.col("mesh_id") == mesh_id), f.where(F.col("mesh_id") == mesh_id))
    if end == "obj":
        with _open(path) as out:
            for r in obj_lines(v, f).orderBy("part", "at").select("line").toLocalIterator():
                out.write(r["line"].encode() + b"\n")
    elif end == "stl":
        c = corners_of(v, f)
        n = F.sqrt(sum((x.cast("double") * x for x in cross()), F.lit(0.0)))
        c = c.select("fid", *[F.when(n * n > 1e-20, x / n).otherwise(0.0).alias(f"n{a}") for a, x in zip(AXES, cross(), strict=True)], *[f"{a}{k}" for k in range(3) for a in AXES])
        with _open(path) as out:
            out.write(b"binary mesh".ljust(80, b"\0") + np.array([c.count()], "<u4").tobytes())
            for r in c.orderBy("fid").drop("fid").toLocalIterator():
                out.write(np.array(tuple(r), "<f4").tobytes() + b"\0\0")
    elif end == "ply":
        n = vertex_normals(v, f)
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {v.count()}\n" + "".join(f"property float {a}\n" for a in ("x", "y", "z", "nx", "ny", "nz")) + f"element face {f.count()}\nproperty list uchar int vertex_indices\nend_header\n"
        with _open(path) as out:
            out.write(head.encode())
            for r in n.orderBy("vid").select(*AXES, "nx", "ny", "nz").toLocalIterator():
                out.write(np.array(tuple(r), "<f4").tobytes())
            for r in f.orderBy("fid").select("v0", "v1", "v2").toLocalIterator():
                out.write(b"\x03" + np.array(tuple(r), "<i4").tobytes())
