"""Circles and cylinder walls of many groups at once, from moments of all points.

One pass sums the 34 products of up to four coordinates per group. They are tensors that turn: the sums from which a circle
follows, seen along any direction, are contractions of them, so the search over directions looks at no point again. The
result is refined by Gauss-Newton steps on the true distances, a grouped sum over all points each.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .fitting import coverage, solved
from .mesh import AXES
from .rounds import DIRECTIONS, GAIN, directions, frame

#: Steps of the refinement, and the least arc, in radians, that counts as a circle.
STEPS, LEAST_ARC = 6, math.radians(10)
_TERMS = [t for k in range(1, 5) for t in combinations_with_replacement(range(3), k)]


def _name(t) -> str:
    return "m" + "".join(AXES[i] for i in t)


def moments(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean (x0, y0, z0), scale (the diagonal of the box), and the means of all products of one to four coordinates of
    (point - mean) / scale, named m and the axes in order."""
    p = [F.col(a).cast("double") for a in AXES]
    size = F.sqrt(sum(((F.max(x) - F.min(x)) * (F.max(x) - F.min(x)) for x in p), F.lit(0.0)))
    first = cut(points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"{a}0") for a, x in zip(AXES, p, strict=True)], size.alias("scale")).where("scale > 0"))
    d = points.join(first, by).select(*by, "n", *[f"{a}0" for a in AXES], "scale", *[((x - F.col(f"{a}0")) / F.col("scale")).alias(f"d{a}") for a, x in zip(AXES, p, strict=True)])

    def product(t):
        out = F.col(f"d{AXES[t[0]]}")
        for i in t[1:]:
            out = out * F.col(f"d{AXES[i]}")
        return out

    return d.groupBy(*by, "n", *[f"{a}0" for a in AXES], "scale").agg(*[F.avg(product(t)).alias(_name(t)) for t in _TERMS])


def tensors(row: dict) -> list[np.ndarray]:
    """The symmetric tensors of order 2, 3 and 4 of a row of moments."""
    out = [np.zeros((3,) * k) for k in (2, 3, 4)]
    for t in _TERMS:
        if len(t) > 1:
            for q in set(permutations(t)):
                out[len(t) - 2][q] = row[_name(t)]
    return out


def seen_along(t: list[np.ndarray], n: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Mean square, radius and centre (in 3D, from the mean) of the algebraic circle seen along n; an infinite mean square if there is
    none, or if it is over four scales wide. The mean square is that of (distance^2 - radius^2) / (2 radius), which near the circle is the distance's."""
    p = np.eye(3) - np.outer(n, n)
    u, w = frame(n)
    e = np.array([u, w])
    s = e @ t[0] @ e.T
    q = float(np.einsum("ij,ij", p, t[0]))
    side = e @ np.einsum("ij,ijk->k", p, t[1])
    if abs(np.linalg.det(s)) < 1e-14:
        return math.inf, 0.0, np.zeros(3)
    c = np.linalg.solve(s, side) / 2
    r2 = float(c @ c) + q
    if not 1e-12 < r2 <= 16:
        return math.inf, 0.0, np.zeros(3)
    miss = float(np.einsum("ij,ijkl,kl", p, t[2], p)) - q * q - 4 * float(c @ s @ c)
    return max(miss, 0.0) / (4 * r2), math.sqrt(r2), c @ e


def search(t: list[np.ndarray], normal: np.ndarray) -> tuple[float, np.ndarray]:
    """The direction of the least mean square: the three best of even directions and the plane's normal, turned a little until that helps no more."""
    tried = sorted((seen_along(t, np.asarray(n))[0], tuple(n)) for n in [normal, *directions(DIRECTIONS)])
    best = (math.inf, normal)
    for ms, n in tried[:3]:
        n, step = np.array(n), math.radians(5)
        while step > math.radians(0.002) and ms < math.inf:
            u, w = frame(n)
            around = [n + math.tan(step) * (math.cos(a) * u + math.sin(a) * w) for a in np.linspace(0, 2 * math.pi, 8, endpoint=False)]
            least = min((seen_along(t, m)[0], tuple(m)) for m in (x / np.linalg.norm(x) for x in around))
            if least[0] < ms:
                ms, n = least[0], np.array(least[1])
            else:
                step /= 2
        if ms < best[0]:
            best = ms, n
    return best


def circles(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n, center_x.., nx.., radius, ms, arc (radians) and is_cylinder of each group of points(by, x, y, z).

    A cylinder is taken where its wall beats the planar circle clearly; the sign of the normal makes its largest component
    positive. Groups without a circle (under three points, points on a line, an arc of under ten degrees) are left out. Points
    with a null coordinate are not used; repeated points count each.
    """
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    points = points.where(" AND ".join(f"{a} IS NOT NULL" for a in AXES)).select(*by, *[F.col(a).cast("double").alias(a) for a in AXES])
    vectors = [f"{k}{a}" for k in "nuw" for a in AXES]
    schema = f"{kinds}, n long, x0 double, y0 double, z0 double, scale double, {', '.join(f'{c} double' for c in vectors)}, flat double, is_cylinder boolean, a double, b double, r double, best double, ba double, bb double, br double, damp double"

    def begin(r):
        if r["n"] < 3:
            return None
        t = tensors(r)
        values, axes = np.linalg.eigh(t[0])
        normal = axes[:, 0]
        planar = seen_along(t, normal)[0] + max(float(values[0]), 0.0)
        ms, n = search(t, normal)
        tube = ms <= GAIN * planar and planar - ms >= 1e-8 if planar < math.inf else ms < math.inf
        n = n if tube else normal
        n = n if n[np.abs(n).argmax()] > 0 else -n
        ms, radius, centre = seen_along(t, n)
        if ms == math.inf:
            return None
        u, w = frame(n)
        out = {c: r[c] for c in (*by, "n", "x0", "y0", "z0", "scale")} | {f"{k}{a}": float(x) for k, v in (("n", n), ("u", u), ("w", w)) for a, x in zip(AXES, v, strict=True)}
        a, b = float(centre @ u), float(centre @ w)
        return out | {"flat": 0.0 if tube else max(float(values[0]), 0.0), "is_cylinder": bool(tube), "a": a, "b": b, "r": radius, "best": math.inf, "ba": a, "bb": b, "br": radius, "damp": 1e-6}

    state = cut(solved(moments(points, by), schema, begin))
    names = state.columns
    along = lambda k: sum((F.try_divide(F.col(a) - F.col(f"{a}0"), F.col("scale")) * F.col(f"{k}{a}") for a in AXES), F.lit(0.0))

    def step(r):
        out = {c: r[c] for c in names}
        j = np.array([[r["aa"], r["ab"], r["ar"]], [r["ab"], r["bb2"], r["br2"]], [r["ar"], r["br2"], 1.0]])
        if r["loss"] < r["best"]:
            out |= {"best": r["loss"], "ba": r["a"], "bb": r["b"], "br": r["r"], "damp": r["damp"] / 10}
            x = np.array([r["a"], r["b"], r["r"]]) - np.linalg.solve(j + r["damp"] * np.eye(3), np.array([r["ga"], r["gb"], r["gr"]]))
        else:  # half way back to the best
            x = (np.array([r["a"], r["b"], r["r"]]) + np.array([r["ba"], r["bb"], r["br"]])) / 2
        return out | {"a": float(x[0]), "b": float(x[1]), "r": float(x[2])}

    for _ in range(STEPS):
        # miss = distance to the centre - radius; its derivatives are -cosine, -sine and -1
        d = points.join(state, by).withColumns({"p": along("u") - F.col("a"), "q": along("w") - F.col("b")}).withColumn("far", F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")))
        d = d.withColumns({"c": F.coalesce(F.try_divide("p", "far"), F.lit(0.0)), "s": F.coalesce(F.try_divide("q", "far"), F.lit(0.0)), "miss": F.col("far") - F.col("r")})
        mean = {"loss": "miss * miss", "aa": "c * c", "ab": "c * s", "bb2": "s * s", "ar": "c", "br2": "s", "ga": "-c * miss", "gb": "-s * miss", "gr": "-miss"}
        sums = d.groupBy(*by).agg(*[F.avg(F.expr(e)).alias(k) for k, e in mean.items()])
        state = cut(solved(state.join(sums, by), schema, step))
    turn = F.atan2(along("w") - F.col("bb"), along("u") - F.col("ba"))
    found = state.join(coverage(points.join(state, by).select(*by, turn.alias("t")), by, F.col("t")), by).where(F.col("coverage") >= LEAST_ARC)
    centre = [(F.col(f"{a}0") + F.col("scale") * (F.col("ba") * F.col(f"u{a}") + F.col("bb") * F.col(f"w{a}"))).alias(f"center_{a}") for a in AXES]
    return found.select(*by, "n", *centre, "nx", "ny", "nz", (F.col("br") * F.col("scale")).alias("radius"), ((F.col("best") + F.col("flat")) * F.col("scale") * F.col("scale")).alias("ms"), F.col("coverage").alias("arc"), "is_cylinder")
