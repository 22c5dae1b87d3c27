"""Cameras, picks and brushes: screen rays, projection, footprints on a mesh and their connected part."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .mesh import AXES, corners_of
from .spatial import _cell, cross, dot, minus, corner, point_cells, ray_cast
from .topology import components

Point = tuple[float, float, float]

#: Directions from the target to the eye and up directions of the six standard views, Z up.
VIEWS = {
    "front": ((0.0, -1.0, 0.0), (0.0, 0.0, 1.0)), "back": ((0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), "right": ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
    "left": ((-1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), "top": ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0)), "bottom": ((0.0, 0.0, -1.0), (0.0, -1.0, 0.0)),
}


@dataclass(frozen=True)
class Camera:
    """A pinhole: its eye, unit directions to the right, up and back, and vertical field of view in radians."""

    eye: Point
    right: Point
    up: Point
    back: Point
    fov: float = math.radians(45.0)

    @classmethod
    def looking(cls, eye: Point, back: Point, up: Point, fov: float = math.radians(45.0)) -> Camera:
        unit = lambda a: tuple(x / math.sqrt(sum(y * y for y in a)) for x in a)
        turn = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        back = unit(back)
        right = unit(turn(up, back))
        return cls(tuple(map(float, eye)), right, turn(back, right), back, fov)

    @classmethod
    def view(cls, name: str, low: Point, high: Point, aspect: float = 1.0, fov: float = math.radians(45.0)) -> Camera:
        """One of VIEWS, so far away that the box's sphere fills the narrower side with a margin of 15 %."""
        back, up = VIEWS[name]
        half = max(1e-3, min(fov / 2, math.atan(math.tan(fov / 2) * max(aspect, 1e-3))))
        away = max(1e-3, math.dist(low, high) / 2) / math.sin(half) * 1.15
        return cls.looking(tuple((a + b) / 2 + away * c for a, b, c in zip(low, high, back, strict=True)), back, up, fov)

    def rays(self, pixels: DataFrame, width: float, height: float) -> DataFrame:
        """pixels(mesh_id, pid, sx, sy; 0, 0 upper left) with ray_cast()'s columns: the eye and a unit direction."""
        t = math.tan(self.fov / 2)
        right = (2 * F.col("sx") / max(1.0, width) - 1) * (t * width / height)
        up = (1 - 2 * F.col("sy") / max(1.0, height)) * t
        d = [right * r + up * u - b for r, u, b in zip(self.right, self.up, self.back, strict=True)]
        size = F.sqrt(dot(d, d))
        return pixels.select("*", *[F.lit(e).alias(a) for a, e in zip(AXES, self.eye, strict=True)], *[(x / size).alias(f"d{a}") for a, x in zip(AXES, d, strict=True)])

    def project(self, points: DataFrame, width: float, height: float) -> DataFrame:
        """points with depth, sx and sy; points at or behind the eye have null sx and sy."""
        off = [F.col(a) - e for a, e in zip(AXES, self.eye, strict=True)]
        along = lambda axis: sum((o * k for o, k in zip(off, axis, strict=True)), F.lit(0.0))
        depth, t = -along(self.back), math.tan(self.fov / 2)
        seen = lambda c: F.when(depth > 1e-6, c)
        sx = (along(self.right) / (depth * t * (width / height)) + 1) / 2 * width
        sy = (1 - along(self.up) / (depth * t)) / 2 * height
        return points.select("*", depth.alias("depth"), seen(sx).alias("sx"), seen(sy).alias("sy"))

    def brush_radius(self, hits: DataFrame, pixels: float, height: float) -> DataFrame:
        """hits(.., x, y, z) with radius: so many pixels at each hit's distance from the eye."""
        off = [F.col(a) - e for a, e in zip(AXES, self.eye, strict=True)]
        return hits.withColumn("radius", pixels * 2 * math.tan(self.fov / 2) * F.sqrt(dot(off, off)) / max(1.0, height))


def pick(camera: Camera, pixels: DataFrame, width: float, height: float, v: DataFrame, f: DataFrame, cell: float, reach: float, hidden: DataFrame | None = None) -> DataFrame:
    """mesh_id, pid, fid, x, y, z: the nearest visible face under each pixel, and where; pixels that miss are left out."""
    rays = camera.rays(pixels, width, height)
    hit = ray_cast(rays, v, f, cell, reach, hidden)
    return rays.join(hit, ["mesh_id", "pid"]).select("mesh_id", "pid", "fid", *[(F.col(a) + F.col("t") * F.col(f"d{a}")).alias(a) for a in AXES])


def brush(hits: DataFrame, v: DataFrame, f: DataFrame, eye: Point, hidden: DataFrame | None = None) -> DataFrame:
    """mesh_id, pid, fid of faces in a brush: hits(mesh_id, pid, fid, x, y, z, radius).

    A face is in if it faces the eye and one of its corners is within the radius; the face hit is always in, hidden ones never.
    Corners meet hits in grid cells of the largest radius. Faces without an area face nowhere.
    """
    f = f if hidden is None else f.join(hidden, ["mesh_id", "fid"], "left_anti")
    size = hits.agg(F.max("radius")).first()[0] or 1.0
    near = point_cells(hits.select("mesh_id", "pid", *[F.col(a).cast("double").alias(a) for a in AXES], "radius"), size)
    near = near.select("mesh_id", "pid", "cx", "cy", "cz", "radius", *[F.col(a).alias(f"h{a}") for a in AXES])
    cells = v.select("mesh_id", "vid", *AXES, *[_cell(F.col(a), size).alias(f"c{a}") for a in AXES])
    off = [F.col(a) - F.col(f"h{a}") for a in AXES]
    inside = cells.join(near, ["mesh_id", "cx", "cy", "cz"]).where(dot(off, off) <= F.col("radius") * F.col("radius")).select("mesh_id", "pid", "vid")
    one = f.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    touched = cut(one.join(inside, ["mesh_id", "vid"]).select("mesh_id", "pid", "fid").distinct())
    t = corners_of(v, f.join(touched, ["mesh_id", "fid"], "left_semi"))
    c = [corner(k) for k in range(3)]
    n = cross(minus(c[1], c[0]), minus(c[2], c[0]))
    middle = [sum((c[k][i] for k in range(3)), F.lit(0.0)) / 3 for i in range(3)]
    front = t.where((dot(n, n) >= 1e-20) & (dot(n, [e - m for e, m in zip(map(F.lit, eye), middle, strict=True)]) > 0)).select("mesh_id", "fid")
    own = hits.select("mesh_id", "pid", "fid").join(f, ["mesh_id", "fid"], "left_semi").select("mesh_id", "pid", "fid")
    return touched.join(front, ["mesh_id", "fid"], "left_semi").select("mesh_id", "pid", "fid").union(own).distinct()


def connected_brush(hits: DataFrame, v: DataFrame, f: DataFrame, adj: DataFrame, eye: Point, hidden: DataFrame | None = None) -> DataFrame:
    """brush() without what edges inside the brush do not connect with the face hit."""
    # each hit is a mesh of its own here, so that brushes of several hits may overlap
    name = F.to_json(F.struct("mesh_id", "pid"))
    inside = cut(brush(hits, v, f, eye, hidden))
    other = inside.select("mesh_id", "pid", F.col("fid").alias("nb"))
    links = inside.join(adj.where("nb IS NOT NULL"), ["mesh_id", "fid"]).join(other, ["mesh_id", "pid", "nb"], "left_semi")
    c = components(inside.select(name.alias("mesh_id"), "fid"), links.select(name.alias("mesh_id"), "fid", "nb"))
    hit = hits.select(name.alias("mesh_id"), "fid")
    kept = c.join(c.join(hit, ["mesh_id", "fid"], "left_semi").select("mesh_id", "root").distinct(), ["mesh_id", "root"], "left_semi")
    return inside.withColumn("name", name).join(kept.select(F.col("mesh_id").alias("name"), "fid"), ["name", "fid"], "left_semi").select("mesh_id", "pid", "fid")
