"""Render vertices split at creases, and line geometry of overlays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, numbered
from .fitting import basis
from .mesh import AXES, face_geometry

CREASE = 0.866


def smooth_groups(normals: np.ndarray, cosine: float = CREASE) -> np.ndarray:
    """A group number for each unit normal: chains of normals at least that near. Equal normals are looked at once."""
    unique, back = np.unique(normals, axis=0, return_inverse=True)
    label = np.full(len(unique), -1)
    n = 0
    for start in range(len(unique)):
        if label[start] >= 0:
            continue
        label[start], front = n, [start]
        while front:
            near = np.flatnonzero((unique @ unique[front.pop()] >= cosine) & (label < 0))
            label[near] = n
            front.extend(near.tolist())
        n += 1
    return label[back.ravel()]


#: Corners of a vertex that are compared with those of others at once; larger vertices are grouped one by one.
WIDE = 32


def smooth_groups_of(normals: np.ndarray, size: np.ndarray, cosine: float = CREASE) -> np.ndarray:
    """smooth_groups() of many vertices, whose unit normals lie one after the other, so many of each."""
    start, out = np.cumsum(size) - size, np.zeros(len(normals), np.int64)
    for d in np.unique(size):
        first = start[size == d]
        if d > WIDE:
            for s in first:
                out[s : s + d] = smooth_groups(normals[s : s + d], cosine)
            continue
        place = first[:, None] + np.arange(d)
        n = normals[place]
        order = np.lexsort((n[:, :, 2], n[:, :, 1], n[:, :, 0]), axis=1)
        place, n = np.take_along_axis(place, order, 1), np.take_along_axis(n, order[:, :, None], 1)
        near = (n @ n.transpose(0, 2, 1) >= cosine) | (n[:, :, None] == n[:, None]).all(3)
        label = np.broadcast_to(np.arange(d), place.shape)
        while True:
            least = np.where(near, label[:, None, :], d).min(2)
            if np.array_equal(least, label):
                break
            label = least
        out[place] = np.take_along_axis(np.cumsum(label == np.arange(d), 1) - 1, label, 1)
    return out


def crease_split(v: DataFrame, f: DataFrame, keys: DataFrame | None = None, cosine: float = CREASE) -> tuple[DataFrame, DataFrame]:
    """Render vertices (mesh_id, rid, vid, fid, nx, ny, nz) and faces (mesh_id, fid, r0, r1, r2).

    A vertex's faces whose normals chain up within the crease angle share one normal, weighted by area; with keys(mesh_id, fid,
    key) faces of different keys have render vertices of their own of the same normal. fid is the least face of a render vertex.
    A vertex's faces are grouped in one task: work grows with the square of its different normals.
    """
    g = face_geometry(v, f).select("mesh_id", "fid", *[F.col(f"c{a}").cast("double").alias(f"c{a}") for a in AXES])
    one = f.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).join(g, ["mesh_id", "fid"])
    one = one.withColumn("key", F.lit(0).cast("long")) if keys is None else one.join(keys.select("mesh_id", "fid", F.col("key").cast("long")), ["mesh_id", "fid"], "left")
    around = one.groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_list(F.struct("fid", "k", "key", F.array("cx", "cy", "cz").alias("c")))).alias("corners"))
    form = "mesh_id string, vid long, fid long, k int, key long, part int, nx double, ny double, nz double"

    def run(batches):
        for b in batches:
            at = b.column("corners")
            corner, size = at.flatten(), np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(len(at)), size)
            c = corner.field("c").flatten().to_numpy().reshape(-1, 3)
            length = np.linalg.norm(c, axis=1, keepdims=True)
            part = smooth_groups_of(np.where(length > 1e-20, c / np.maximum(length, 1e-20), 0.0), size, cosine)
            _, group = np.unique(row * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
            total = np.stack([np.bincount(group, weights=c[:, i]) for i in range(3)], 1)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            n = np.where(length > 1e-20, total / np.maximum(length, 1e-20), 0.0)[group]
            rows = {"mesh_id": b.column("mesh_id").take(pa.array(row)), "vid": b.column("vid").take(pa.array(row))} | {x: corner.field(x) for x in ("fid", "k", "key")}
            rows |= {"part": pa.array(part, pa.int32())} | {f"n{a}": pa.array(n[:, i]) for i, a in enumerate(AXES)}
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    corners = cut(around.mapInArrow(run, form))
    own = ["mesh_id", "vid", "part", "key"]
    rows = corners.groupBy(*own).agg(F.min("fid").alias("fid"), *[F.min(f"n{a}").alias(f"n{a}") for a in AXES])
    rows = cut(numbered(rows, ["vid", "part", "fid"], "rid"))
    named = corners.join(rows.select(*own[:3], F.col("key").alias("of"), "rid"), own[:3]).where(F.col("key").eqNullSafe(F.col("of")))
    faces = named.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("rid"))).alias(f"r{k}") for k in range(3)])
    return rows.select("mesh_id", "rid", "vid", "fid", "nx", "ny", "nz"), faces


def _segments(rows: DataFrame, ends: Column, *keep: str) -> DataFrame:
    """One row per element of an array of (a, b), each an array of three numbers."""
    s = rows.select(*keep, F.posexplode(ends).alias("k", "s"))
    return s.select(*keep, "k", *[F.col(f"s.{e}")[i].cast("double").alias(f"{e}{a}") for e in "ab" for i, a in enumerate(AXES)])


def _segment(a: list[Column], b: list[Column]) -> Column:
    point = lambda p: F.array(*[c.cast("double") for c in p])
    return F.struct(point(a).alias("a"), point(b).alias("b"))


def box_segments(boxes: DataFrame) -> DataFrame:
    """mesh_id, k, ax.. bz: the twelve edges of boxes(mesh_id, min_x, .., max_z)."""
    at = lambda bits: [F.col(f"{'max' if bits >> i & 1 else 'min'}_{a}") for i, a in enumerate(AXES)]
    return _segments(boxes, F.array(*[_segment(at(k), at(k | 1 << i)) for i in range(3) for k in range(8) if not k >> i & 1]), "mesh_id")


def triad_segments(origins: DataFrame, length: float) -> DataFrame:
    """mesh_id, k, ax.. bz: three axes at origins(mesh_id, x, y, z)."""
    o = [F.col(a) for a in AXES]
    return _segments(origins, F.array(*[_segment(o, [c + (length if i == k else 0.0) for i, c in enumerate(o)]) for k in range(3)]), "mesh_id")


def plane_segments(planes: DataFrame, size: float, lines: int = 10) -> DataFrame:
    """feature_id, k, ax.. bz: a square of lines + 1 lines each way over planes(feature_id, px.., nx..)."""
    u, v = basis([F.col(f"n{a}") for a in AXES])
    at = lambda s, t: [F.col(f"p{a}") + s * x + t * y for a, x, y in zip(AXES, u, v, strict=True)]
    half = size / 2
    steps = [half * (2 * k / lines - 1) for k in range(lines + 1)]
    return _segments(planes, F.array(*[_segment(at(s, -half), at(s, half)) for s in steps], *[_segment(at(-half, s), at(half, s)) for s in steps]), "feature_id")


def circle_segments(circles: DataFrame, segments: int = 64) -> DataFrame:
    """feature_id, k, ax.. bz: a polygon around circles(feature_id, px.., nx.., radius)."""
    u, v = basis([F.col(f"n{a}") for a in AXES])
    turn = lambda k: [F.col(f"p{a}") + F.col("radius") * (math.cos(2 * math.pi * k / segments) * x + math.sin(2 * math.pi * k / segments) * y) for a, x, y in zip(AXES, u, v, strict=True)]
    return _segments(circles, F.array(*[_segment(turn(k), turn((k + 1) % segments)) for k in range(segments)]), "feature_id")


def ground_segments(boxes: DataFrame, step: Column) -> DataFrame:
    """mesh_id, k, ax.. bz: lines at multiples of a step (see color.nice_step) under boxes(mesh_id, min_x, .., max_z), a step beyond them."""
    b = boxes.withColumn("step", step)
    low, high = ({a: (F.floor(F.col(f"min_{a}") / F.col("step")) - 1, F.ceil(F.col(f"max_{a}") / F.col("step")) + 1)[e] * F.col("step") for a in "xy"} for e in (0, 1))
    places = lambda a: F.sequence(F.lit(0), F.round((high[a] - low[a]) / F.col("step")).cast("int"))
    z = F.col("min_z")
    across = F.transform(places("x"), lambda k: _segment([low["x"] + k * F.col("step"), low["y"], z], [low["x"] + k * F.col("step"), high["y"], z]))
    along = F.transform(places("y"), lambda k: _segment([low["x"], low["y"] + k * F.col("step"), z], [high["x"], low["y"] + k * F.col("step"), z]))
    return _segments(b, F.concat(across, along), "mesh_id")
