"""Least-squares fits: sums per group on the cluster, small solves on a row per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mesh import AXES


def solved(sums: DataFrame, schema: str, f) -> DataFrame:
    """f(dict of a row's columns) -> dict or None, for each of few wide rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(sums.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for b in batches:
            yield from pa.Table.from_pylist([x for x in map(f, b.to_pylist()) if x is not None], schema=arrow).to_batches()

    return sums.mapInArrow(run, schema)


def plane_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Total least squares per group of three points or more: centroid, unit normal, ms (mean square) and max_dev.

    The normal's sign is fixed: its largest component is positive.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in by}
    x = {a: F.col(a).cast("double") for a in AXES}
    mean = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x[a]).alias(f"m{a}") for a in AXES]).where("n >= 3")
    d = {a: x[a] - F.col(f"m{a}") for a in AXES}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = points.join(mean, by).groupBy(*by, "n", "mx", "my", "mz").agg(*[F.sum(d[a] * d[b]).alias(f"c{a}{b}") for a, b in pairs])

    def solve(r):
        m = np.array([[r["c" + "".join(sorted(a + b))] for b in AXES] for a in AXES])
        values, vectors = np.linalg.eigh(m)
        n = vectors[:, 0]
        n = n if n[np.abs(n).argmax()] > 0 else -n
        return {c: r[c] for c in by} | {"n": r["n"]} | {f"p{a}": r[f"m{a}"] for a in AXES} | {f"n{a}": float(k) for a, k in zip(AXES, n, strict=True)} | {"ms": max(0.0, float(values[0])) / r["n"]}

    schema = ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "n long", *[f"p{a} double" for a in AXES], *[f"n{a} double" for a in AXES], "ms double"])
    fit = solved(sums, schema, solve)
    far = F.max(F.abs(sum(((F.col(a) - F.col(f"p{a}")) * F.col(f"n{a}") for a in AXES), F.lit(0.0))))
    return fit.join(points.join(fit, by).groupBy(*by).agg(far.alias("max_dev")), by)


def basis(n: list[Column]) -> tuple[list[Column], list[Column]]:
    """Unit u, v across a unit normal; the helper axis is X unless the normal is near it."""
    axis = [F.when(F.abs(n[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(n[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u = cross(n, axis)
    size = F.sqrt(sum((c * c for c in u), F.lit(0.0)))
    u = [c / size for c in u]
    return u, cross(n, u)


def circle_fit(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Algebraic circle per group: cx, cy, radius and ms of radial deviations. All sums and Cramer's rule are columns."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    mean = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my")).where("n >= 3")
    u, w = a - F.col("mx"), b - F.col("my")
    q = u * u + w * w
    s = points.join(mean, by).groupBy(*by, "n", "mx", "my").agg(F.sum(u * u).alias("uu"), F.sum(u * w).alias("uw"), F.sum(w * w).alias("ww"), F.sum(q * u).alias("qu"), F.sum(q * w).alias("qw"), F.sum(q).alias("q"))
    det = 2 * (F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw"))
    s = s.where(F.abs(det) > 1e-14).withColumn("du", (F.col("qu") * F.col("ww") - F.col("qw") * F.col("uw")) / det).withColumn("dw", (F.col("qw") * F.col("uu") - F.col("qu") * F.col("uw")) / det)
    r2 = F.col("du") * F.col("du") + F.col("dw") * F.col("dw") + F.col("q") / F.col("n")
    fit = s.where(r2 > 1e-12).select(*by, "n", (F.col("mx") + F.col("du")).alias("cx"), (F.col("my") + F.col("dw")).alias("cy"), F.sqrt(r2).alias("radius"))
    off = F.sqrt(F.pow(a - F.col("cx"), F.lit(2.0)) + F.pow(b - F.col("cy"), F.lit(2.0))) - F.col("radius")
    return fit.join(points.join(fit, by).groupBy(*by).agg(F.avg(off * off).alias("ms")), by)


def coverage(points: DataFrame, by: list[str], angle: Column) -> DataFrame:
    """The covered angle per group: a turn less the largest gap, the one across the start included. angle in [-pi, pi].

    Angles are counted in 65,536 classes first, so that a group's window is bounded whatever its size.
    """
    turn = 2 * math.pi
    each = points.select(*by, angle.alias("a")).groupBy(*by, F.floor(F.col("a") * (65536 / turn)).alias("k")).agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    w = Window.partitionBy(*by).orderBy("k")
    g = each.select(*by, "lo", "hi", (F.col("lo") - F.lag("hi").over(w)).alias("gap"))
    return g.groupBy(*by).agg(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.min("lo") + turn - F.max("hi")).alias("gap")).select(*by, (turn - F.col("gap")).alias("coverage"))


def sphere_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Algebraic sphere per group: cx, cy, cz, radius."""
    kinds = {c: points.schema[c].dataType.simpleString() for c in by}
    p = [F.col(a).cast("double") for a in AXES]
    q = sum((c * c for c in p), F.lit(0.0))
    terms = {"one": F.lit(1.0), **dict(zip(AXES, p, strict=True))}
    names = list(terms)
    aggs = [F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(q * t).alias(f"q_{k}") for k, t in terms.items()]
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)

    def solve(r):
        m = np.array([[r[f"{a}_{b}"] if names.index(a) <= names.index(b) else r[f"{b}_{a}"] for b in names] for a in names])
        if r["n"] < 4 or abs(np.linalg.det(m)) < 1e-14:
            return None
        k = np.linalg.solve(m, np.array([r[f"q_{a}"] for a in names]))
        c = k[1:] / 2
        r2 = float(k[0] + c @ c)
        return {x: r[x] for x in by} | {"n": r["n"], "cx": float(c[0]), "cy": float(c[1]), "cz": float(c[2]), "radius": math.sqrt(r2)} if r2 > 1e-12 else None

    return solved(sums, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "n long", "cx double", "cy double", "cz double", "radius double"]), solve)
