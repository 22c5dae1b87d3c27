"""Nearest-neighbour, range and ray joins of points with triangles, through a cell pyramid; and deviations made of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .mesh import AXES
from .pyramid import BOX, CORNERS, NODE, SLACK, Pyramid, box_distance

Vec = list[Column]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b, strict=True)))


def minus(a: Vec, b: Vec) -> Vec:
    return [p - q for p, q in zip(a, b, strict=True)]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def corner(k: int) -> Vec:
    return [F.col(f"{a}{k}").cast("double") for a in AXES]


def with_distance(near: DataFrame) -> DataFrame:
    """near(x, y, z and the corners x0..z2 of a triangle) with d, the square distance: to its plane over the inside, else to the
    nearest side; and columns of which nearest_points() makes the point."""
    p, c = [F.col(a).cast("double") for a in AXES], [corner(k) for k in range(3)]
    # in steps, so that no expression is written out again inside another
    near = near.withColumns({f"·n{i}": x for i, x in enumerate(cross(minus(c[1], c[0]), minus(c[2], c[0])))})
    steps = {}
    for k in range(3):
        ab, ap = minus(c[(k + 1) % 3], c[k]), minus(p, c[k])
        steps[f"·t{k}"] = F.when(dot(ab, ab) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(ap, ab), dot(ab, ab))))).otherwise(0.0)
    n = [F.col(f"·n{i}") for i in range(3)]
    inside = reduce(lambda a, b: a & b, (dot(cross(minus(c[(k + 1) % 3], c[k]), minus(p, c[k])), n) >= 0 for k in range(3))) & (dot(n, n) > 0)
    near = near.withColumns(steps | {"·in": inside, "·h": dot(minus(p, c[0]), n), "·nn": dot(n, n)})
    sides = {}
    for k in range(3):
        off = [x - F.col(f"·t{k}") * y for x, y in zip(minus(p, c[k]), minus(c[(k + 1) % 3], c[k]), strict=True)]
        sides[f"·d{k}"] = dot(off, off)
    return near.withColumns(sides).withColumn("d", F.when(F.col("·in"), F.try_divide(F.col("·h") * F.col("·h"), F.col("·nn"))).otherwise(F.least("·d0", "·d1", "·d2")))


def nearest_points(near: DataFrame) -> DataFrame:
    """with_distance()'s rows with qx, qy, qz, the nearest point of the triangle: of equally near sides that of the first."""
    least = F.least("·d0", "·d1", "·d2")
    q = {}
    for i, a in enumerate(AXES):
        on = [F.col(f"{a}{k}") + F.col(f"·t{k}") * (F.col(f"{a}{(k + 1) % 3}") - F.col(f"{a}{k}")) for k in range(3)]
        side = F.when(F.col("·d0") == least, on[0]).when(F.col("·d1") == least, on[1]).otherwise(on[2])
        q[f"q{a}"] = F.when(F.col("·in"), F.col(a) - F.try_divide(F.col("·h"), F.col("·nn")) * F.col(f"·n{i}")).otherwise(side)
    return near.withColumns(q)


def square_distances(p: list[np.ndarray], c: list[list[np.ndarray]]) -> np.ndarray:
    """with_distance()'s d of points p and triangles c, in the same steps."""
    with np.errstate(all="ignore"):
        n = cross(minus(c[1], c[0]), minus(c[2], c[0]))
        nn = dot(n, n)
        inside, least = ~(nn <= 0), None
        for k in range(3):
            ab, ap = minus(c[(k + 1) % 3], c[k]), minus(p, c[k])
            long = dot(ab, ab)
            t = np.where(long > 0, np.fmax(0.0, np.fmin(1.0, dot(ap, ab) / long)), 0.0)
            inside &= ~(dot(cross(ab, ap), n) < 0)
            off = [x - t * y for x, y in zip(ap, ab, strict=True)]
            side = dot(off, off)
            least = side if least is None else np.fmin(least, side)
        h = dot(minus(p, c[0]), n)
        return np.where(inside, h * h / nn, least)


def numbered_rows(met: DataFrame) -> DataFrame:
    """Meetings with a number each, for least_in_tasks() after the join with triangles."""
    return met.withColumn("·run", F.monotonically_increasing_id())


def least_in_tasks(near: DataFrame, *marks: str) -> DataFrame:
    """mesh_id, pid, marks, d, fid, x, y, z and CORNERS: of near's rows of one meeting (·run) and one value of each of marks (booleans) that of the
    least square distance, of equal ones the least fid; a meeting may have a row in each of several batches.

    Distances are made with numpy for a batch of rows: as expressions they are evaluated far slower, and all rows of a point would be sorted
    with their corners before they become one.
    """
    near = near.select("mesh_id", "pid", "·run", *marks, "fid", *[F.col(c).cast("double").alias(c) for c in (*AXES, *CORNERS)])

    def run(batches):
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("·run", "fid", *marks, *AXES, *CORNERS)}
            d = square_distances([at[a] for a in AXES], [[at[f"{a}{k}"] for a in AXES] for k in range(3)])
            keys = [at["·run"], *[at[m] for m in marks]]
            order = np.lexsort((at["fid"], d, *reversed(keys)))
            new = np.zeros(len(order), bool)
            new[:1] = True
            for x in keys:
                new[1:] |= x[order][1:] != x[order][:-1]
            first = pa.array(order[new])
            yield pa.RecordBatch.from_arrays([*[x.take(first) for x in batch.columns], pa.array(d[order[new]])], names=[*batch.schema.names, "d"])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in near.schema)
    return near.mapInArrow(run, f"{kinds}, d double").drop("·run")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def point_cells(p: DataFrame, size: float, ring: int = 1) -> DataFrame:
    """A row per cell within so many cells of each point."""
    out = p
    for a in AXES:
        out = out.withColumn(f"c{a}", F.explode(F.sequence(_cell(F.col(a), size) - ring, _cell(F.col(a), size) + ring)))
    return out


def closest(points: DataFrame, v: DataFrame, f: DataFrame, cell: float = 1.0, pyramid: Pyramid | None = None) -> DataFrame:
    """points(mesh_id, pid, x, y, z) with the distance to the mesh, a nearest fid (the least of those at the least square distance)
    and the nearest point there (qx, qy, qz).

    Points go down the cell pyramid of the mesh (made here, or given for several calls); cell is the side of its level 0, which only
    moves the grid's lines. A mesh without faces, and points with a null or NaN coordinate, leave nulls. The rows of a point do not depend
    on its distance nor on the sizes of triangles, unless very much of the surface is equally near.
    """
    index = pyramid or Pyramid(v, f, cell)
    p = points.select("mesh_id", "pid", *[F.col(a).cast("double").alias(a) for a in AXES]).where(~F.isnan(F.col("x") + F.col("y") + F.col("z")))
    met = numbered_rows(index.meetings(index.bounded(p), True)).join(index.triangles, NODE).where(box_distance([F.col(a) for a in AXES]) <= F.col("bound") * SLACK)
    best = least_in_tasks(met).groupBy("mesh_id", "pid").agg(F.min(F.struct("d", "fid", *AXES, *CORNERS)).alias("b"))
    best = nearest_points(with_distance(best.select("mesh_id", "pid", "b.*"))).select("mesh_id", "pid", F.sqrt("d").alias("distance"), "fid", "qx", "qy", "qz")
    return points.join(best, ["mesh_id", "pid"], "left")


def within(points: DataFrame, v: DataFrame, f: DataFrame, radius: float, hidden: DataFrame | None = None, pyramid: Pyramid | None = None) -> DataFrame:
    """mesh_id, pid, fid: faces no further than the radius from each point, but hidden(mesh_id, fid)."""
    index = pyramid or Pyramid(v, f if hidden is None else f.join(hidden, ["mesh_id", "fid"], "left_anti"))
    p = points.select("mesh_id", "pid", *[F.col(a).cast("double").alias(a) for a in AXES]).where(~F.isnan(F.col("x") + F.col("y") + F.col("z"))).withColumn("bound", F.lit(float(radius) * radius))
    near = index.meetings(p, False).join(index.triangles, NODE).where(box_distance([F.col(a) for a in AXES]) <= F.col("bound") * SLACK)
    near = with_distance(near).where("d <= bound").select("mesh_id", "pid", "fid")
    return near if pyramid is None or hidden is None else near.join(hidden, ["mesh_id", "fid"], "left_anti").select("mesh_id", "pid", "fid")


def ray_cast(rays: DataFrame, v: DataFrame, f: DataFrame, cell: float = 1.0, reach: float = float("inf"), hidden: DataFrame | None = None, pyramid: Pyramid | None = None) -> DataFrame:
    """rays(mesh_id, pid, x, y, z, dx, dy, dz; unit directions) with the nearest hit up to `reach`: t and fid; rays that miss are left out.

    Rays go down the cell pyramid through the boxes that they meet, so their length costs nothing; cell as in closest(). With a
    pyramid given, hidden faces are left out of its hits.
    """
    index = pyramid or Pyramid(v, f if hidden is None else f.join(hidden, ["mesh_id", "fid"], "left_anti"), cell)
    r = rays.select("mesh_id", "pid", *[F.col(a).cast("double").alias(a) for a in (*AXES, *[f"d{a}" for a in AXES])])
    near = index.crossings(r, reach).join(index.triangles.drop(*BOX), NODE)
    if pyramid is not None and hidden is not None:
        near = near.join(hidden, ["mesh_id", "fid"], "left_anti")
    c = [corner(k) for k in range(3)]
    o, d = [F.col(a) for a in AXES], [F.col(f"d{a}") for a in AXES]
    e1, e2, s = minus(c[1], c[0]), minus(c[2], c[0]), minus(o, c[0])
    p, q = cross(d, e2), cross(s, e1)
    det = dot(e1, p)
    hit = near.withColumn("det", det).where(F.abs("det") >= 1e-12)
    hit = hit.select("mesh_id", "pid", "fid", (dot(s, p) / F.col("det")).alias("u"), (dot(d, q) / F.col("det")).alias("w"), (dot(e2, q) / F.col("det")).alias("t"))
    hit = hit.where((F.col("u") >= 0) & (F.col("w") >= 0) & (F.col("u") + F.col("w") <= 1) & (F.col("t") > 1e-6) & (F.col("t") <= reach))
    return hit.groupBy("mesh_id", "pid").agg(F.min(F.struct("t", "fid")).alias("h")).select("mesh_id", "pid", "h.t", "h.fid")


def deviation(found: DataFrame) -> DataFrame:
    """Per mesh, of closest()'s rows: max_dev, ms (mean square) and points."""
    return found.groupBy("mesh_id").agg(F.max("distance").alias("max_dev"), F.avg(F.col("distance") * F.col("distance")).alias("ms"), F.count(F.lit(1)).alias("points"))


def face_maxima(found: DataFrame) -> DataFrame:
    return found.groupBy("mesh_id", "fid").agg(F.max("distance").alias("heat"))


def vertex_maxima(v: DataFrame, f: DataFrame, per_face: DataFrame) -> DataFrame:
    """The largest value of a vertex's faces, 0 where none has one."""
    one = f.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(per_face, ["mesh_id", "fid"]).groupBy("mesh_id", "vid").agg(F.max("heat").alias("heat"))
    return v.join(one, ["mesh_id", "vid"], "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))


def in_tolerance(found: DataFrame, tolerance: float) -> DataFrame:
    share = F.avg((F.col("distance") <= tolerance).cast("int")) * 100 if tolerance > 0 else F.lit(0.0)
    return found.groupBy("mesh_id").agg(share.alias("percent"))


def contour_match(max_dev: Column, diagonal: Column) -> Column:
    """Percent of a box's diagonal that the largest deviation leaves."""
    return 100 * (1 - max_dev / F.greatest(diagonal, F.lit(1e-9)))


def reflect(points: DataFrame, point: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """The points mirrored in a plane of unit normal."""
    h = sum(((F.col(a) - o) * n for a, o, n in zip(AXES, point, normal, strict=True)), F.lit(0.0))
    return points.select(*[c for c in points.columns if c not in AXES], *[(F.col(a) - 2 * n * h).alias(a) for a, n in zip(AXES, normal, strict=True)])


def robust_loss(found: DataFrame, cutoff: float) -> DataFrame:
    """Mean of squares, each no more than the cutoff's; and the rms of those within it (the cutoff if there are none)."""
    d = F.col("distance")
    return found.groupBy("mesh_id").agg(F.avg(F.least(d * d, F.lit(cutoff * cutoff))).alias("loss"), F.coalesce(F.sqrt(F.avg(F.when(d <= cutoff, d * d))), F.lit(cutoff)).alias("rms"))
