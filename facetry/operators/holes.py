"""Holes: loops of open edges, their attributes, the fan fill, and references that patches are measured against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, numbered
from . import patches
from .loops import LOOP, loop_edges, ordered_loops
from .mesh import AXES


def holes(v: DataFrame, f: DataFrame) -> DataFrame:
    """A row per simple loop of three edges or more: hole_id (by perimeter, longest first), vertices in order, edges, perimeter,
    area, normal, box.

    Only vertices depend on the order of the edges: sums over them give the Newell normal of a closed loop.
    """
    loops = ordered_loops(f)
    b = loop_edges(loops)
    p, q = (v.select("mesh_id", F.col("vid").alias(n), *[F.col(a).alias(f"{a}{n}") for a in AXES]) for n in "uv")
    e = b.join(p, ["mesh_id", "u"]).join(q, ["mesh_id", "v"])
    d = [F.col(f"{a}v") - F.col(f"{a}u") for a in AXES]
    cross = [F.col(f"{a}u") * F.col(f"{c}v") - F.col(f"{c}u") * F.col(f"{a}v") for a, c in ("yz", "zx", "xy")]
    g = e.groupBy(*LOOP).agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.sqrt(sum((x.cast("double") * x for x in d), F.lit(0.0)))).alias("perimeter"), *[F.sum(x).alias(f"s{a}") for a, x in zip(AXES, cross, strict=True)],
        *[F.avg(f"{a}u").alias(f"center_{a}") for a in AXES], *[k(f"{a}u").alias(f"{n}_{a}") for a in AXES for n, k in (("min", F.min), ("max", F.max))],
    ).join(loops, LOOP)
    size = F.sqrt(sum((F.col(f"s{a}").cast("double") * F.col(f"s{a}") for a in AXES), F.lit(0.0)))
    up = {"x": 0.0, "y": 1.0, "z": 0.0}
    g = g.select("*", (size / 2).alias("area"), *[F.when(size > 1e-12, F.col(f"s{a}") / size).otherwise(up[a]).alias(f"n{a}") for a in AXES])
    order = g.withColumn("longest", -F.col("perimeter"))
    return numbered(order, ["longest", "root", "part"], "hole_id").withColumn("hole_id", (F.col("hole_id") + 1).cast("int")).drop("sx", "sy", "sz", "longest")


DIRECTIONS = {"x": (1.0, 0.0, 0.0), "y": (0.0, 1.0, 0.0), "z": (0.0, 0.0, 1.0)}


def direction(mode: str) -> list[Column]:
    if mode in DIRECTIONS:
        return [F.lit(c) for c in DIRECTIONS[mode]]
    sign = {"auto": 1.0, "inverted": -1.0}[mode]
    return [F.col(f"n{a}") * sign for a in AXES]


def fan_fill(v: DataFrame, f: DataFrame, bulge: float = 0.0, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Patch vertices and faces for all holes: a point at the loop's centre, moved along the direction by half the box's diagonal times bulge."""
    h = cut(holes(v, f))
    diagonal = F.sqrt(sum((F.pow((F.col(f"max_{a}") - F.col(f"min_{a}")).cast("double"), F.lit(2.0)) for a in AXES), F.lit(0.0)))
    nv = v.groupBy("mesh_id").agg((F.max("vid") + 1).alias("nv"))
    nf = f.groupBy("mesh_id").agg((F.max("fid") + 1).alias("nf"))
    at = h.join(nv, "mesh_id").withColumn("vid", F.col("nv") + F.col("hole_id") - 1)
    points = at.select("mesh_id", "hole_id", "vid", *[(F.col(f"center_{a}") + d * diagonal * (bulge / 2)).alias(a) for a, d in zip(AXES, direction(mode), strict=True)])
    rim = loop_edges(h).join(at.select(*LOOP, "hole_id", F.col("vid").alias("top")), LOOP).join(nf, "mesh_id")
    faces = rim.join(earlier(h, "edges"), ["mesh_id", "hole_id"])
    return points, faces.select("mesh_id", "hole_id", (F.col("nf") + F.col("before") + F.col("at")).alias("fid"), F.col("v").alias("v0"), F.col("u").alias("v1"), F.col("top").alias("v2"))


def earlier(h: DataFrame, count: str) -> DataFrame:
    """mesh_id, hole_id, before: the sum of a count over the holes of smaller ids. Only a mesh's holes meet, two numbers each."""
    w = Window.partitionBy("mesh_id").orderBy("hole_id").rowsBetween(Window.unboundedPreceding, -1)
    return h.select("mesh_id", "hole_id", F.coalesce(F.sum(count).over(w), F.lit(0)).alias("before"))


def _rims(v: DataFrame, h: DataFrame) -> DataFrame:
    """mesh_id, hole_id, vertices, rim (points in the vertices' order). Dealt by number: a few bytes a hole are much work, and would be put into one task by their size; by another key than the join's, whose exchange would stand for this one."""
    one = h.select("mesh_id", "hole_id", F.posexplode("vertices").alias("at", "vid")).join(v.select("mesh_id", "vid", *[F.col(a).cast("double").alias(a) for a in AXES]), ["mesh_id", "vid"])
    rims = one.groupBy("mesh_id", "hole_id").agg(F.array_sort(F.collect_list(F.struct("at", F.array(*AXES).alias("p")))).alias("rim"))
    return h.select("mesh_id", "hole_id", "vertices").join(rims.select("mesh_id", "hole_id", F.col("rim.p").alias("rim")), ["mesh_id", "hole_id"]).repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("mesh_id", "hole_id"))


def fill(v: DataFrame, f: DataFrame, method: str = "smooth", references: list[dict] | None = None, chosen: DataFrame | None = None, found: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Patch vertices and faces (hole_id, and ids behind the mesh's) for all holes (found: rows of holes(), if known), or those of `chosen` (mesh_id, hole_id).

    Every hole is a row and all are filled in parallel; a hole whose patch fails is left open. With references, the patch's
    inside is drawn onto them. settings: bulge, density, iterations, mode.
    """
    h = cut(holes(v, f)) if found is None else found
    h = h if chosen is None else h.join(chosen, ["mesh_id", "hole_id"], "left_semi")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                rim = np.array(r["rim"])
                try:
                    made = patches.patch(rim, method, **settings)
                except (ValueError, FloatingPointError):
                    continue
                points, faces = patches.snapped(rim, made, references or [])
                rows.append({"mesh_id": r["mesh_id"], "hole_id": r["hole_id"], "vertices": r["vertices"], "points": points.tolist(), "faces": faces.tolist()})
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    import pyarrow as pa

    schema = pa.schema([("mesh_id", pa.string()), ("hole_id", pa.int32()), ("vertices", pa.list_(pa.int64())), ("points", pa.list_(pa.list_(pa.float64()))), ("faces", pa.list_(pa.list_(pa.int64())))])
    made = cut(_rims(v, h).mapInArrow(run, "mesh_id string, hole_id int, vertices array<long>, points array<array<double>>, faces array<array<long>>").withColumns({"np": F.size("points"), "nf": F.size("faces")}))
    first = {c: t.groupBy("mesh_id").agg((F.max(c) + 1).alias("first")) for c, t in (("vid", v), ("fid", f))}
    at = made.join(earlier(made, "np"), ["mesh_id", "hole_id"]).join(first["vid"], "mesh_id").withColumn("base", F.col("first") + F.col("before")).drop("first", "before")
    points = at.select("mesh_id", "hole_id", "base", F.posexplode("points").alias("k", "p")).select("mesh_id", "hole_id", (F.col("base") + F.col("k")).alias("vid"), *[F.col("p")[i].alias(a) for i, a in enumerate(AXES)])
    n = F.size("vertices")
    name = lambda x: F.when(x < n, F.element_at("vertices", F.least(x + 1, n).cast("int"))).otherwise(F.col("base") + x - n)
    at = at.join(earlier(made, "nf"), ["mesh_id", "hole_id"]).join(first["fid"], "mesh_id")
    faces = at.select("mesh_id", "hole_id", (F.col("first") + F.col("before")).alias("start"), "vertices", "base", F.posexplode("faces").alias("k", "t"))
    return points, faces.select("mesh_id", "hole_id", (F.col("start") + F.col("k")).alias("fid"), *[name(F.col("t")[i]).alias(f"v{i}") for i in range(3)])


def solve(v: DataFrame, f: DataFrame, references: list[dict]) -> DataFrame:
    """mesh_id, hole_id and the best settings for each hole: method, mode, bulge, iterations, rms, max_dev, score, tried."""
    h = cut(holes(v, f))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [{"mesh_id": r["mesh_id"], "hole_id": r["hole_id"]} | patches.best_patch(np.array(r["rim"]), references) for r in b.to_pylist()]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    import pyarrow as pa

    kinds = {"mesh_id": pa.string(), "hole_id": pa.int32(), "method": pa.string(), "mode": pa.string(), "bulge": pa.float64(), "iterations": pa.int32(), "rms": pa.float64(), "max_dev": pa.float64(), "score": pa.float64(), "tried": pa.int32()}
    schema = pa.schema(list(kinds.items()))
    return _rims(v, h).mapInArrow(run, "mesh_id string, hole_id int, method string, mode string, bulge double, iterations int, rms double, max_dev double, score double, tried int")


def solver_references(features: DataFrame) -> DataFrame:
    """The visible planes and circles; all active ones where none is visible."""
    usable = features.where(F.col("kind").isin("plane", "circle", "disk", "cylinder"))
    shown = usable.where("visible")
    return shown if not shown.isEmpty() else usable.where("active")


def filled(v: DataFrame, f: DataFrame, patch: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return v.select("mesh_id", "vid", *AXES).unionByName(patch[0].drop("hole_id")), f.select("mesh_id", "fid", "v0", "v1", "v2").unionByName(patch[1].drop("hole_id"))


def reference_distance(kind: Column, point: list[Column], normal: list[Column], radius: Column) -> Column:
    """Distance of x, y, z to a plane, to a disk with its rim, or to a cylinder wall (its height within 2 r)."""
    d = [F.col(a) - p for a, p in zip(AXES, point, strict=True)]
    h = sum((x * n for x, n in zip(d, normal, strict=True)), F.lit(0.0))
    rho = F.sqrt(F.greatest(F.lit(0.0), sum((x * x for x in d), F.lit(0.0)) - h * h))
    off = F.greatest(F.lit(0.0), F.abs(h) - 2 * radius)
    disk = F.when(rho <= radius, F.abs(h)).otherwise(F.sqrt((rho - radius) ** 2 + h * h))
    return F.when(kind == "plane", F.abs(h)).when(kind == "disk", disk).otherwise(F.sqrt((rho - radius) ** 2 + off * off))


def nearest_reference(points: DataFrame, references: DataFrame) -> DataFrame:
    """points with the distance and feature_id of the nearest reference; the least id wins ties. References are a few rows."""
    r = references.select("feature_id", "kind", *[F.col(f"point.{a}").alias(f"p{a}") for a in AXES], *[F.col(f"normal.{a}").alias(f"n{a}") for a in AXES], "radius").collect()
    each = [F.struct(reference_distance(F.lit(x["kind"]), [F.lit(x[f"p{a}"]) for a in AXES], [F.lit(x[f"n{a}"]) for a in AXES], F.lit(x["radius"])).alias("distance"), F.lit(x["feature_id"]).alias("feature_id")) for x in r]
    best = F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<distance:double,feature_id:long>")
    return points.withColumn("_best", best).select(*points.columns, "_best.distance", "_best.feature_id")


def evaluate_patch(samples: DataFrame, references: DataFrame) -> DataFrame:
    d = nearest_reference(samples, references)
    rms, most = F.sqrt(F.avg(F.col("distance") ** 2)), F.max("distance")
    return d.groupBy("mesh_id").agg(rms.alias("rms"), most.alias("max_dev"), (rms + 0.15 * most).alias("score"), F.count(F.lit(1)).alias("samples"))
