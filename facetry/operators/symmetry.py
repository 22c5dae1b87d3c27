"""Mirror planes of many meshes at once, from samples of their surfaces.

A plane is a unit normal and an offset along it from the middle of its mesh's box. A round mirrors each mesh's samples in all
of its candidate planes, and one nearest join takes all mirrored points of all meshes to the surface; a grouped sum gives each
candidate's loss, its rms and the normal equations of its distances. The next candidates are damped Gauss-Newton steps from the best so
far, so a handful of rounds stands in for hundreds of single evaluations. Samples, planes and sums are tables: none of them
comes to the driver, and a mesh has a bounded number of samples and candidates, whatever its size.

Faces of a mask give no samples, and a mirrored point whose nearest face is masked counts as one beyond the cutoff.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, forget
from . import mesh, topology
from .fitting import solved
from .mesh import AXES
from .pyramid import CORNERS, NODE, SLACK, Pyramid, box_distance
from .spatial import least_in_tasks, nearest_points, numbered_rows, with_distance

PLANE = ["nx", "ny", "nz", "offset"]
#: Samples of the search and of the refinement; cutoffs as shares of the box's diagonal.
COARSE, FINE = 768, 8192
COARSE_CUTOFF, LINE_CUTOFF, FINE_CUTOFF = 0.04, 0.035, 0.02
#: Most rounds of a refinement, the dampings that a round tries, and the gain below which a start rests.
ROUNDS, DAMPING, LEAST_GAIN = 10, (1e-6, 1e-2, 1.0), 1e-6
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SUMS = [*[f"h{i}{j}" for i, j in _PAIRS], *[f"g{i}" for i in range(3)]]


def job_mask(f: DataFrame, selected: DataFrame | None = None, holes: bool = True, rings: int = 2) -> DataFrame | None:
    """mesh_id, fid of the faces that a search leaves out: the selected ones, and those within so many rings of open edges. None if there are neither."""
    parts = [selected.select("mesh_id", "fid")] if selected is not None else []
    parts += [topology.hole_mask(f, rings).select("mesh_id", "fid")] if holes else []
    if not parts:
        return None
    return parts[0].distinct() if len(parts) == 1 else parts[0].union(parts[1]).distinct()


def tangents(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.cross(n, (1.0, 0, 0) if abs(n[0]) < 0.9 else (0, 1.0, 0))
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def boxes(v: DataFrame) -> DataFrame:
    """mesh_id, the middle (ox, oy, oz) and the diagonal of each mesh's box."""
    return mesh.bounding_box(v).select("mesh_id", *[F.col(f"center_{a}").cast("double").alias(f"o{a}") for a in AXES], "diagonal")


def score(planes: DataFrame, samples: DataFrame, index: Pyramid, masked: DataFrame | None = None) -> DataFrame:
    """planes(mesh_id, plane, ox, oy, oz, nx, ny, nz, offset, cutoff; other columns stay) with samples (their number), loss, rms and sums
    of the distances' normal equations.

    samples(mesh_id, pid, x, y, z). loss: mean of squares of the mirrored samples' distances, each no more than the cutoff's, which
    is also that of a sample whose nearest face is masked (not where one that is not masked is as near); infinite without samples. rms: of the distances within the cutoff to faces
    that are not masked; the cutoff if there are none, 0 without samples. A plane with a null or NaN scores as one that no sample meets.
    """
    n, o = [F.col(f"n{a}") for a in AXES], [F.col(f"o{a}") for a in AXES]
    p = samples.select("mesh_id", "pid", *[F.col(a).cast("double").alias(f"s{a}") for a in AXES])
    p = p.join(planes.select("mesh_id", "plane", *[f"o{a}" for a in AXES], *PLANE, "cutoff"), "mesh_id")
    high = sum((c * (F.col(f"s{a}") - m) for a, c, m in zip(AXES, n, o, strict=True)), F.lit(0.0)) - F.col("offset")
    p = p.withColumn("high", high).where(~F.isnan("high"))
    p = cut(p.select("mesh_id", F.struct("plane", "pid").alias("pid"), *[(F.col(f"s{a}") - 2 * F.col("high") * c).alias(a) for a, c in zip(AXES, n, strict=True)], *[(F.col(f"s{a}") - m).alias(f"s{a}") for a, m in zip(AXES, o, strict=True)], "high", *PLANE, "cutoff"))
    bound = index.bounded(p.select("mesh_id", "pid", *AXES)).join(p.select("mesh_id", "pid", "cutoff"), ["mesh_id", "pid"])
    bound = cut(bound.select("mesh_id", "pid", *AXES, F.least("bound", F.col("cutoff") * F.col("cutoff")).alias("bound")))
    triangles = index.triangles.withColumn("out", F.lit(False))
    if masked is not None:
        triangles = index.triangles.join(masked.select("mesh_id", "fid").distinct().withColumn("out", F.lit(True)), ["mesh_id", "fid"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    met = numbered_rows(index.meetings(bound, True)).join(triangles, NODE).where(box_distance([F.col(a) for a in AXES]) <= F.col("bound") * SLACK)
    wanted = ["d", "fid", *AXES, *CORNERS]
    near = least_in_tasks(met, "out").groupBy("mesh_id", "pid").agg(F.min(F.when(~F.col("out"), F.struct(*wanted))).alias("b"), F.min("d").alias("least"))
    # in two steps, as one would be too long to compile
    met = cut(near.where(F.col("b.d") <= F.col("least") * SLACK).select("mesh_id", "pid", "b.*"))
    near = nearest_points(with_distance(met))
    near = on = cut(near.select("mesh_id", "pid", "d", *AXES, *[f"q{a}" for a in AXES], "·in", "·nn", *[f"·n{i}" for i in range(3)]))
    # the direction in which a distance grows: the face's normal over its inside, else away from the nearest point
    size, away = F.sqrt("·nn"), F.sqrt("d")
    grows = {f"m{a}": F.when(F.col("·in"), F.try_divide(F.col(f"·n{i}"), size)).otherwise(F.try_divide(F.col(a) - F.col(f"q{a}"), away)) for i, a in enumerate(AXES)}
    near = near.withColumns(grows).withColumn("r", sum(((F.col(a) - F.col(f"q{a}")) * F.coalesce(f"m{a}", F.lit(0.0)) for a in AXES), F.lit(0.0)))
    near = near.select("mesh_id", "pid", "d", "r", *[F.coalesce(f"m{a}", F.lit(0.0)).alias(f"m{a}") for a in AXES])
    hit = p.drop(*AXES).join(near, ["mesh_id", "pid"]).where(F.col("d") <= F.col("cutoff") * F.col("cutoff"))
    # the distance's derivatives by the two tilts of the normal and by the offset
    helper = [F.when(F.abs(n[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(n[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    u = cross(n, helper)
    long = F.sqrt(dot(u, u))
    hit = hit.withColumns({f"u{a}": c / long for a, c in zip(AXES, u, strict=True)})
    u = [F.col(f"u{a}") for a in AXES]
    hit = hit.withColumns({f"w{a}": c for a, c in zip(AXES, cross(n, u), strict=True)})
    w, m, s = ([F.col(f"{k}{a}") for a in AXES] for k in "wms")
    hit = hit.withColumns({"j0": -2 * (dot(u, s) * dot(m, n) + F.col("high") * dot(m, u)), "j1": -2 * (dot(w, s) * dot(m, n) + F.col("high") * dot(m, w)), "j2": 2 * dot(m, n)})
    sums = hit.groupBy("mesh_id", F.col("pid.plane").alias("plane")).agg(
        F.count(F.lit(1)).alias("hits"), F.sum("d").alias("square"), *[F.sum(F.col(f"j{i}") * F.col(f"j{j}")).alias(f"h{i}{j}") for i, j in _PAIRS], *[F.sum(F.col(f"j{i}") * F.col("r")).alias(f"g{i}") for i in range(3)]
    )
    total = samples.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("samples"))
    out = planes.drop("samples", "loss", "rms", *_SUMS).join(sums, ["mesh_id", "plane"], "left").join(total, "mesh_id", "left")
    hits, square, c2 = F.coalesce("hits", F.lit(0)), F.coalesce("square", F.lit(0.0)), F.col("cutoff") * F.col("cutoff")
    loss = F.when(F.col("samples") > 0, (square + (F.col("samples") - hits) * c2) / F.col("samples")).otherwise(math.inf)
    rms = F.when(F.col("samples").isNull(), 0.0).when(hits > 0, F.sqrt(square / hits)).otherwise(F.col("cutoff"))
    done = cut(out.withColumns({"loss": loss, "rms": rms, "samples": F.coalesce("samples", F.lit(0))} | {c: F.coalesce(c, F.lit(0.0)) for c in _SUMS}).drop("hits", "square"))
    forget(p, bound, met, on)
    return done


def steps(states: DataFrame, damping=DAMPING) -> DataFrame:
    """A damped Gauss-Newton step of each scored plane for each damping: rows (mesh_id, start, plane, ..) to be scored."""
    kinds = {c: states.schema[c].dataType.simpleString() for c in ("mesh_id", "start")}

    def step(r):
        n = np.array([r["nx"], r["ny"], r["nz"]])
        h = np.zeros((3, 3))
        for i, j in _PAIRS:
            h[i, j] = h[j, i] = r[f"h{i}{j}"]
        g = np.array([r[f"g{i}"] for i in range(3)])
        scale = np.array([1, 1, max(r["diagonal"], 1e-300)])  # offsets count in diagonals
        h, g = h * np.outer(scale, scale), g * scale
        u, w = tangents(n)
        out = []
        for k, by in enumerate(damping):
            if not np.trace(h) > 0:
                break
            x = -np.linalg.solve(h + by * np.diag(np.diag(h)) + 1e-9 * np.trace(h) * np.eye(3), g) * scale
            size = np.linalg.norm(x[:2])
            x[:2] *= min(1.0, 0.3 / max(size, 1e-300))  # no step turns the plane by more than some 17 degrees
            t = n + x[0] * u + x[1] * w
            t /= np.linalg.norm(t)
            out.append({"k": k, "nx": float(t[0]), "ny": float(t[1]), "nz": float(t[2]), "offset": float(r["offset"] + x[2])})
        return {"mesh_id": r["mesh_id"], "start": r["start"], "next": out}

    schema = ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "next array<struct<k int, nx double, ny double, nz double, offset double>>"])
    wanted = solved(states.select("mesh_id", "start", "diagonal", *PLANE, *_SUMS), schema, step).select("mesh_id", "start", F.explode("next").alias("s"))
    base = states.select("mesh_id", "start", *[f"o{a}" for a in AXES], "diagonal", "cutoff")
    return wanted.join(base, ["mesh_id", "start"]).select("mesh_id", "start", F.struct("start", F.col("s.k").alias("k")).alias("plane"), *[f"o{a}" for a in AXES], "diagonal", *[f"s.{c}" for c in PLANE], "cutoff")


def improve(states: DataFrame, samples: DataFrame, index: Pyramid, masked: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """states(mesh_id, start, ox, oy, oz, diagonal, nx, ny, nz, offset, cutoff) moved to planes of less loss, each start by itself, with
    samples, loss and rms. A start rests when a round gains no more than a millionth of its loss, or than a millionth of the cutoff squared, and all end after `rounds`."""
    columns = ["mesh_id", "start", *[f"o{a}" for a in AXES], "diagonal", *PLANE, "cutoff", "samples", "loss", "rms", *_SUMS]
    now = score(states.withColumn("plane", F.struct("start", F.lit(-1).alias("k"))), samples, index, masked)
    now, made = cut(now.select(*columns).withColumn("moves", F.col("samples") > 0)), now
    forget(made)
    for _ in range(rounds):
        if now.where("moves").isEmpty():
            break
        tried = score(steps(now.where("moves")), samples, index, masked)
        best = tried.groupBy("mesh_id", "start").agg(F.min(F.struct("loss", F.col("plane.k").alias("k"), *PLANE, "rms", *_SUMS)).alias("b"))
        least = F.greatest(LEAST_GAIN * F.col("loss"), LEAST_GAIN**2 * F.col("cutoff") * F.col("cutoff"))
        to = now.join(best, ["mesh_id", "start"], "left").withColumn("better", F.col("moves") & F.coalesce(F.col("b.loss") < F.col("loss"), F.lit(False)))
        moves = F.col("better") & (F.col("loss") - F.col("b.loss") > least)
        taken = {c: F.when(F.col("better"), F.col(f"b.{c}")).otherwise(F.col(c)) for c in ("loss", *PLANE, "rms", *_SUMS)}
        after = cut(to.withColumn("on", moves).select(*[taken.get(c, F.col(c)).alias(c) for c in columns], F.col("on").alias("moves")))
        forget(now, tried)
        now = after
    return now.drop("moves", *_SUMS)


def finished(states: DataFrame) -> DataFrame:
    """mesh_id, normal (its largest component positive), the plane's point nearest to the box's middle, loss and rms."""
    top = F.greatest(*[F.abs(f"n{a}") for a in AXES])
    sign = F.lit(1.0)
    for a in reversed(AXES):
        sign = F.when(F.abs(f"n{a}") == top, F.signum(f"n{a}")).otherwise(sign)
    return states.withColumn("sign", sign).select("mesh_id", *[(F.col(f"n{a}") * F.col("sign")).alias(f"n{a}") for a in AXES], *[(F.col(f"o{a}") + F.col("offset") * F.col(f"n{a}")).alias(f"p{a}") for a in AXES], "samples", "loss", "rms")


def _samples(v, f, n, seed, masked):
    return cut(mesh.sample_surface(v, f, n, seed, masked).select("mesh_id", F.struct("fid", "i").alias("pid"), *AXES))


def refine(v: DataFrame, f: DataFrame, planes: DataFrame, masked: DataFrame | None = None, index: Pyramid | None = None) -> DataFrame:
    """planes(mesh_id, nx, ny, nz, px, py, pz), one a mesh with a normal of any length above 0, moved to the least robust loss near them, with a cutoff of twice and then once
    FINE_CUTOFF. A mesh whose surface is masked or has no area keeps its plane (loss infinite, rms 0)."""
    long = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AXES), F.lit(0.0)))
    at = planes.withColumn("long", long).where("long > 0").join(boxes(v), "mesh_id")
    unit = {a: F.col(f"n{a}") / F.col("long") for a in AXES}
    offset = sum((unit[a] * (F.col(f"p{a}") - F.col(f"o{a}")) for a in AXES), F.lit(0.0))
    states = cut(at.select("mesh_id", F.lit(0).alias("start"), *[f"o{a}" for a in AXES], "diagonal", *[unit[a].alias(f"n{a}") for a in AXES], offset.alias("offset"), (2 * FINE_CUTOFF * F.col("diagonal")).alias("cutoff")))
    index, samples = index or Pyramid(v, f), _samples(v, f, FINE, 0, masked)
    wide = improve(states, samples, index, masked)
    return finished(improve(wide.withColumn("cutoff", FINE_CUTOFF * F.col("diagonal")), samples, index, masked))


def auto_symmetry(v: DataFrame, f: DataFrame, masked: DataFrame | None = None, index: Pyramid | None = None, best: int = 3) -> DataFrame:
    """Each mesh's mirror plane of least loss: those through the box's middle across the samples' principal axes and the coordinate
    axes are scored, the `best` of them improved together, and the best of these refined. Meshes without samples have no row."""
    index = index or Pyramid(v, f)
    few = _samples(v, f, COARSE, 1, masked)
    x = [F.col(a).cast("double") for a in AXES]
    sums = few.groupBy("mesh_id").agg(*[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in _PAIRS])

    def axes(r):
        m = np.zeros((3, 3))
        for i, j in _PAIRS:
            m[i, j] = m[j, i] = r[f"c{i}{j}"]
        found = [*np.linalg.eigh(m)[1].T, *np.eye(3)]
        return {"mesh_id": r["mesh_id"], "axes": [{"start": k, "nx": float(n[0]), "ny": float(n[1]), "nz": float(n[2])} for k, n in enumerate(found)]}

    kind = v.schema["mesh_id"].dataType.simpleString()
    starts = solved(sums, f"mesh_id {kind}, axes array<struct<start int, nx double, ny double, nz double>>", axes).select("mesh_id", F.inline("axes"))
    starts = cut(starts.join(boxes(v), "mesh_id").withColumn("offset", F.lit(0.0)).withColumn("cutoff", COARSE_CUTOFF * F.col("diagonal")))
    scored = score(starts.withColumn("plane", F.col("start")), few, index, masked)
    rank = F.row_number().over(Window.partitionBy("mesh_id").orderBy("loss", "start"))  # six rows a mesh
    chosen = cut(scored.withColumn("rank", rank).where(F.col("rank") <= best).select(*starts.columns))
    near = improve(chosen, few, index, masked)
    return refine(v, f, _best(near), masked, index)


def symmetry_from_line(v: DataFrame, f: DataFrame, lines: DataFrame, masked: DataFrame | None = None, index: Pyramid | None = None, candidates: int = 90) -> DataFrame:
    """lines(mesh_id, ax, ay, az, bx, by, bz), one a mesh: of `candidates` planes that hold the line, equally turned about it, the one of least
    loss, refined. A line shorter than 1e-5 of the diagonal, and a mesh without samples, have no row."""
    index = index or Pyramid(v, f)
    few = _samples(v, f, COARSE, 1, masked)
    kind = v.schema["mesh_id"].dataType.simpleString()

    def fan(r):
        a, b = (np.array([r[f"{k}{c}"] for c in AXES], float) for k in "ab")
        size = np.linalg.norm(b - a)
        if not size >= 1e-5 * r["diagonal"] or size == 0:
            return None
        u, w = tangents((b - a) / size)
        out = []
        for k in range(candidates):
            n = u * math.cos(math.pi * k / candidates) + w * math.sin(math.pi * k / candidates)
            out.append({"start": k, "nx": float(n[0]), "ny": float(n[1]), "nz": float(n[2]), "offset": float(n @ (a - [r[f"o{c}"] for c in AXES]))})
        return {"mesh_id": r["mesh_id"], "fan": out}

    ends = lines.select("mesh_id", *[F.col(f"{k}{c}").cast("double").alias(f"{k}{c}") for k in "ab" for c in AXES]).dropna()
    fans = solved(ends.join(boxes(v), "mesh_id"), f"mesh_id {kind}, fan array<struct<start int, nx double, ny double, nz double, offset double>>", fan)
    fans = cut(fans.select("mesh_id", F.inline("fan")).join(boxes(v), "mesh_id").withColumn("cutoff", LINE_CUTOFF * F.col("diagonal")))
    return refine(v, f, _best(score(fans.withColumn("plane", F.col("start")), few, index, masked)), masked, index)


def _best(scored: DataFrame) -> DataFrame:
    """The plane of least loss a mesh, as refine() takes it."""
    b = scored.where("samples > 0").groupBy("mesh_id").agg(F.min(F.struct("loss", "start", *PLANE, *[f"o{a}" for a in AXES])).alias("b"))
    return cut(b.select("mesh_id", "b.*").select("mesh_id", *[f"n{a}" for a in AXES], *[(F.col(f"o{a}") + F.col("offset") * F.col(f"n{a}")).alias(f"p{a}") for a in AXES]))
