"""A pyramid of grid cells over triangles, for nearest, range and ray joins.

Cells of level l are cubes of side cell * 2 ** l. A triangle is in one cell: of the least level whose cells are as long as
its box, that of the box's lower corner, so it reaches at most into the next cell along each axis. A node is a cell with
triangles in it or in finer cells inside; it has their common box, a point of one of them, and how many are its own and
how many are finer. Sizes of triangles and distances of points may differ by any factor: a large triangle is one row at a
coarse level, and a far point begins at the coarsest level instead of looking through empty cells.

Searches go down level by level, all points at once. A point's bound is the least distance to a node's point that it has
met; nodes whose boxes lie beyond it go. As the nodes' points draw near the surface, few nodes are left for each point.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .mesh import AXES, corners_of

CELLS = ["cx", "cy", "cz"]
NODE = ["mesh_id", "l", *CELLS]
BOX = [f"{g}{a}" for g in ("lo", "hi") for a in AXES]
CORNERS = [f"{a}{k}" for k in range(3) for a in AXES]
#: Cells are no smaller than 2 ** -FINEST of their coordinates.
FINEST = 40
#: Levels above a node's own that are made one of the other.
CLIMBS = 3
#: Rounding of a distance or logarithm must not lose a node.
SLACK = 1 + 1e-9


def _sum(x: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, x)


def _square(p: list[Column], q: list[Column]) -> Column:
    return _sum([(x - y) * (x - y) for x, y in zip(p, q, strict=True)])


def _at(names) -> list[Column]:
    return [F.col(n) for n in names]


def box_distance(p: list[Column]) -> Column:
    """Square distance of p to the node's box."""
    out = [F.greatest(F.col(f"lo{a}") - x, x - F.col(f"hi{a}"), F.lit(0.0)) for a, x in zip(AXES, p, strict=True)]
    return _sum([x * x for x in out])


def slab(o: list[Column], d: list[Column]) -> tuple[Column, Column]:
    """Where the ray o + t * d enters and leaves the node's box; it misses if that is in the wrong order."""
    near, far = [], []
    for a, x, k in zip(AXES, o, d, strict=True):
        inside = (x >= F.col(f"lo{a}")) & (x <= F.col(f"hi{a}"))
        ts = [F.try_divide(F.col(f"{g}{a}") - x, k) for g in ("lo", "hi")]
        near.append(F.when(k == 0, F.when(inside, F.lit(-math.inf)).otherwise(math.inf)).otherwise(F.least(*ts)))
        far.append(F.when(k == 0, F.when(inside, F.lit(math.inf)).otherwise(-math.inf)).otherwise(F.greatest(*ts)))
    return F.greatest(*near), F.least(*far)


class Pyramid:
    """triangles: NODE, fid and CORNERS. nodes: NODE, BOX, rx, ry, rz (a corner of a triangle in it), own and finer (numbers of
    triangles). boxes: each mesh's, with its triangles' levels and its top level, where it has at most eight nodes. low and top: the least and the
    largest of all meshes."""

    def __init__(self, v: DataFrame, f: DataFrame, cell: float = 1.0):
        self.cell = cell
        t = corners_of(v, f).select("mesh_id", "fid", *[F.col(c).cast("double").alias(c) for c in CORNERS])
        t = t.select("*", *[g(*_at(f"{a}{k}" for k in range(3))).alias(f"{n}{a}") for n, g in (("lo", F.least), ("hi", F.greatest)) for a in AXES])
        # cells so small beside their coordinates that their numbers would not be exact are not used
        size = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES], *[F.abs(c) * 2.0**-FINEST for c in BOX], F.lit(1e-200))
        t = t.withColumn("l", F.ceil(F.log2(size / cell) + 1e-9).cast("int"))
        self.triangles = cut(t.select("mesh_id", "l", *self.cells({a: F.col(f"lo{a}") for a in AXES}, F.col("l")), "fid", *CORNERS, *BOX))
        each = self.triangles.groupBy("mesh_id").agg(*[g(c).alias(c) for c, g in zip(BOX, [F.min] * 3 + [F.max] * 3, strict=True)], F.collect_set("l").alias("levels"))
        # at its top a mesh is in two cells along each axis at most
        reach = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES], F.lit(1e-200))
        top = F.greatest(F.array_max("levels"), (F.floor(F.log2(reach / cell) + 1e-9) + 1).cast("int"))
        self.boxes = cut(each.select("mesh_id", *[F.col(c).alias(f"b{c}") for c in BOX], "levels", top.alias("top")))
        most = self.boxes.agg(F.min(F.array_min("levels")).alias("low"), F.max("top").alias("top")).first()
        self.low, self.top = most["low"] or 0, most["top"] or 0
        box = [g(f"{n}{a}").alias(f"{n}{a}") for n, g in (("lo", F.min), ("hi", F.max)) for a in AXES]
        corner = F.min(F.struct("fid", *_at(("x0", "y0", "z0")))).alias("r")
        # dealt before they are summed: few of a node's lie together, and structs are summed by sorting, which a partial aggregate would do twice
        own = self.triangles.repartition(*NODE).groupBy(*NODE).agg(*box, corner, F.count(F.lit(1)).alias("n"))
        # a node goes up into all cells around it. A few levels are made of those below, so that what goes up to all the others is little
        own = made = cut(own)
        steps = [own.select(*NODE, *BOX, "r", F.col("n").alias("own"), F.lit(0).cast("long").alias("finer"))]
        for _ in range(CLIMBS):
            made = made.where(F.col("l") < self.top).select("mesh_id", (F.col("l") + 1).alias("l"), *[F.shiftright(c, 1).alias(c) for c in CELLS], *BOX, "r", "n")
            made = cut(made.repartition(*NODE).groupBy(*NODE).agg(*box, F.min("r").alias("r"), F.sum("n").alias("n")))
            steps.append(made.select(*NODE, *BOX, "r", F.lit(0).cast("long").alias("own"), F.col("n").alias("finer")))
        up = made.where(F.col("l") < self.top).withColumn("at", F.explode(F.expr(f"sequence(l + 1, {self.top})")))
        steps.append(up.select("mesh_id", F.col("at").alias("l"), *[F.expr(f"shiftright({c}, at - l)").alias(c) for c in CELLS], *BOX, "r", F.lit(0).cast("long").alias("own"), F.col("n").alias("finer")))
        nodes = reduce(DataFrame.union, steps).repartition(*NODE).groupBy(*NODE).agg(*box, F.min("r").alias("r"), F.sum("own").alias("own"), F.sum("finer").alias("finer"))
        self.nodes = cut(nodes.select(*NODE, *BOX, F.col("r.x0").alias("rx"), F.col("r.y0").alias("ry"), F.col("r.z0").alias("rz"), "own", "finer"))

    def side(self, level: Column) -> Column:
        return self.cell * F.pow(F.lit(2.0), level)

    def cells(self, p: dict[str, Column], level: Column) -> list[Column]:
        return [self.index(p[a], level).alias(f"c{a}") for a in AXES]

    def index(self, x: Column, level: Column) -> Column:
        return F.floor(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), x / self.side(level)))).cast("long")

    def _rounds(self, front: DataFrame, own: list[str], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The nodes with own triangles that each of the searches meets below front (and in it), of those that `kept` leaves.

        front: the searches' columns `own`, NODE's, BOX, the node's point, own, finer, and down, false where the search does not go on below.
        """
        kids = self.nodes.select("mesh_id", (F.col("l") + 1).alias("l"), *[F.shiftright(c, 1).alias(c) for c in CELLS], *[F.col(c).alias(f"k{c}") for c in CELLS], *BOX, "rx", "ry", "rz", "own", "finer")
        columns = [*own, "l", *CELLS, "own", "finer", "down"]
        found = [cut(kept(front).select(*columns))]
        while True:
            on = found[-1].where("down AND finer > 0").drop("own", "finer")
            levels = [r["l"] for r in on.select("l").distinct().collect()]  # no more than the pyramid has; the others' nodes are not read
            if not levels:
                break
            below = on.join(kids.where(F.col("l").isin(levels)), NODE).withColumn("l", F.col("l") - 1).withColumns({c: F.col(f"k{c}") for c in CELLS})
            found.append(cut(kept(below).select(*columns)))
        return reduce(DataFrame.union, found).where("own > 0").drop("own", "finer", "down")

    def bounded(self, points: DataFrame) -> DataFrame:
        """points(mesh_id, pid, x, y, z) with bound: a square distance within which its mesh has a triangle. It is the least to the
        points of the cells, of all levels, that the point is in when moved into the mesh's box. Points of meshes without triangles go."""
        p = _at(AXES)
        at = points.select("mesh_id", "pid", *AXES).join(self.boxes.drop("levels", "top"), "mesh_id")
        far = _sum([F.greatest((x - F.col(f"blo{a}")) * (x - F.col(f"blo{a}")), (x - F.col(f"bhi{a}")) * (x - F.col(f"bhi{a}"))) for a, x in zip(AXES, p, strict=True)])
        moved = {a: F.greatest(F.col(f"blo{a}"), F.least(F.col(f"bhi{a}"), F.col(a))) for a in AXES}
        around = at.select("mesh_id", "pid", *AXES, far.alias("far"), F.explode(F.sequence(F.lit(self.low), F.lit(self.top))).alias("l"), *[m.alias(f"m{a}") for a, m in moved.items()])
        around = around.select("mesh_id", "pid", *AXES, "far", "l", *self.cells({a: F.col(f"m{a}") for a in AXES}, F.col("l"))).join(self.nodes.select(*NODE, "rx", "ry", "rz"), NODE, "left")
        bound = F.least("far", _square(p, _at(("rx", "ry", "rz"))))
        return around.groupBy("mesh_id", "pid").agg(*[F.first(a).alias(a) for a in AXES], F.min(bound).alias("bound"))

    def meetings(self, points: DataFrame, narrow: bool) -> DataFrame:
        """points' columns mesh_id, pid, x, y, z, bound, with each node that has own triangles and whose box is no further than the
        bound (a square). With narrow, bounds fall to the nodes' points as they are met: only nearest triangles are asked for."""
        p = _at(AXES)
        own = ["mesh_id", "pid", *AXES, "bound", "low"]
        radius = F.sqrt("bound") * SLACK
        start = F.when(F.col("bound") > 0, F.least(F.ceil(F.log2(radius / self.cell) + 1e-9), F.col("top"))).cast("int")
        near = points.withColumn("low", F.lit(0.0)).join(self.boxes, "mesh_id").withColumn("start", F.greatest(F.coalesce(start, F.lit(self.low)), F.lit(self.low)))
        # searches begin where cells are as long as the bound, and look at the own triangles of coarser cells there
        near = near.withColumn("l", F.explode(F.concat(F.array("start"), F.filter("levels", lambda x: x > F.col("start"))))).withColumn("down", F.col("l") == F.col("start"))
        for a in AXES:
            first = F.greatest(self.index(F.col(a) - radius, F.col("l")) - 1, self.index(F.col(f"blo{a}"), F.col("l")))
            last = F.least(self.index(F.col(a) + radius, F.col("l")), self.index(F.col(f"bhi{a}"), F.col("l")))
            near = near.withColumns({"·a": first, "·b": last}).where(F.col("·a") <= F.col("·b")).withColumn(f"c{a}", F.explode(F.sequence("·a", "·b")))
        near = near.select(*own, "l", *CELLS, "down").join(self.nodes, NODE)

        def kept(met: DataFrame) -> DataFrame:
            met = met.withColumn("low", box_distance(p)).where(F.col("low") <= F.col("bound") * SLACK)
            if not narrow:
                return met
            met = met.withColumn("bound", F.min(F.least("bound", _square(p, _at(("rx", "ry", "rz"))))).over(Window.partitionBy("mesh_id", "pid")))
            return met.where(F.col("low") <= F.col("bound") * SLACK)

        found = self._rounds(near, own, kept)
        if narrow:
            found = found.withColumn("bound", F.min("bound").over(Window.partitionBy("mesh_id", "pid"))).where(F.col("low") <= F.col("bound") * SLACK)
        return found.drop("low")

    def crossings(self, rays: DataFrame, reach: float) -> DataFrame:
        """rays' columns mesh_id, pid, x, y, z, dx, dy, dz with each node that has own triangles and whose box the ray meets up to `reach`."""
        own = ["mesh_id", "pid", *AXES, *[f"d{a}" for a in AXES]]
        near, far = slab(_at(AXES), _at(f"d{a}" for a in AXES))

        def kept(met: DataFrame) -> DataFrame:
            met = met.withColumn("in", near).withColumn("out", far)
            size = F.abs("in") + F.abs("out")
            return met.where((F.col("in") <= F.col("out") + F.when(size < math.inf, 1e-9 * size + 1e-12).otherwise(0.0)) & (F.col("out") >= 0) & (F.col("in") <= reach))

        # searches begin where cells are as long as the ray's way through the mesh's box, and look at the own triangles of coarser cells there
        o, d = _at(AXES), _at(f"d{a}" for a in AXES)
        at = rays.join(self.boxes.select("mesh_id", *[F.col(f"b{c}").alias(c) for c in BOX], "levels", "top"), "mesh_id")
        at = at.withColumn("in", F.greatest(near, F.lit(0.0))).withColumn("out", F.least(far, F.lit(float(reach))))
        slack = 1e-9 * (F.abs("in") + F.abs("out")) + 1e-12
        at = at.withColumns({"in": F.col("in") - slack, "out": F.col("out") + slack}).where("in <= out AND out < double('infinity')")
        ends = [[x + F.col(t) * k for t in ("in", "out")] for x, k in zip(o, d, strict=True)]
        slacks = [1e-9 * (F.abs(p) + F.abs(q)) for p, q in ends]
        at = at.withColumns({f"{g}{a}": x for a, e, z in zip(AXES, ends, slacks, strict=True) for g, x in (("·a", F.least(*e) - z), ("·b", F.greatest(*e) + z))})
        long = F.greatest(*[F.col(f"·b{a}") - F.col(f"·a{a}") for a in AXES], F.lit(1e-200))
        at = at.withColumn("start", F.greatest(F.lit(self.low), F.least(F.ceil(F.log2(long / self.cell) + 1e-9), F.col("top"))).cast("int"))
        at = at.withColumn("l", F.explode(F.concat(F.array("start"), F.filter("levels", lambda x: x > F.col("start"))))).withColumn("down", F.col("l") == F.col("start"))
        for a in AXES:
            first = F.greatest(self.index(F.col(f"·a{a}"), F.col("l")) - 1, self.index(F.col(f"lo{a}"), F.col("l")))
            last = F.least(self.index(F.col(f"·b{a}"), F.col("l")), self.index(F.col(f"hi{a}"), F.col("l")))
            at = at.withColumns({"·f": first, "·t": last}).where(F.col("·f") <= F.col("·t")).withColumn(f"c{a}", F.explode(F.sequence("·f", "·t")))
        front = at.select(*own, "l", *CELLS, "down").join(self.nodes, NODE)
        return self._rounds(front, own, kept)
