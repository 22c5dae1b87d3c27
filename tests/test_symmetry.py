"""Mirror planes against brute force and analytic truth, several meshes a call."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import mesh, symmetry
from facetry.operators.pyramid import Pyramid


def tables(spark, meshes):
    v = [(m, i, *map(float, p)) for m, (vs, _) in meshes.items() for i, p in enumerate(vs)]
    f = [(m, i, *map(int, t)) for m, (_, fs) in meshes.items() for i, t in enumerate(fs)]
    return spark.createDataFrame(v, "mesh_id string, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id string, fid long, v0 long, v1 long, v2 long")


def wedge(r: np.ndarray, shift, bump: bool):
    """A frustum mirrored in x = 0 alone, over a trapezium, turned by r and moved; with bump, a tall spike (faces from 12 on) on one side only."""
    foot = [(-2, 0), (2, 0), (1, 1.5), (-1, 1.5)]
    vs = [(x * k, y * k, z) for z, k in ((0, 1), (2.6, 0.7)) for x, y in foot]
    fs = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), *[t for k in range(4) for t in ((k, (k + 1) % 4, (k + 1) % 4 + 4), (k, (k + 1) % 4 + 4, k + 4))]]
    if bump:
        vs += [(1.6, 0.2, 2.6), (1.9, 0.2, 2.6), (1.7, 0.5, 2.6), (1.75, 0.3, 6.0)]
        fs += [(8, 9, 11), (9, 10, 11), (10, 8, 11)]
    return np.array(vs, float) @ r.T + shift, fs


def turn(seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0]
    return q * np.sign(np.linalg.det(q))


def nearest(p, a, b, c):
    """Distances of many points to one triangle."""
    n = np.cross(b - a, c - a)
    inside = np.all([np.cross(y - x, p - x) @ n >= 0 for x, y in ((a, b), (b, c), (c, a))], axis=0)
    ends = []
    for x, y in ((a, b), (b, c), (c, a)):
        t = np.clip((p - x) @ (y - x) / ((y - x) @ (y - x)), 0, 1)
        ends.append(np.linalg.norm(p - x - t[:, None] * (y - x), axis=1))
    return np.where(inside, np.abs((p - a) @ n) / np.linalg.norm(n), np.min(ends, axis=0))


def test_scores_match_brute_force(spark):
    meshes = {"a": wedge(turn(1), (3, -2, 5), True), "b": wedge(turn(2) * 7, (100, 0, 0), False), "all masked": wedge(turn(3), (0, 0, 0), False)}
    v, f = tables(spark, meshes)
    masked = spark.createDataFrame([("a", 12), ("a", 13), ("a", 12), ("b", 3), *[("all masked", k) for k in range(12)]], "mesh_id string, fid long")
    samples = mesh.sample_surface(v, f, 150, 5, masked).select("mesh_id", F.struct("fid", "i").alias("pid"), "x", "y", "z")
    box = symmetry.boxes(v)
    planes = []
    for k, m in enumerate(meshes):
        for j in range(3):
            n = turn(10 * k + j)[0]
            planes.append((m, j, *map(float, n), 0.1 * j))
    planes = spark.createDataFrame([*planes, ("a", 9, math.nan, 0.0, 1.0, 0.0)], "mesh_id string, plane int, nx double, ny double, nz double, offset double").join(box, "mesh_id").withColumn("cutoff", 0.1 * F.col("diagonal"))
    got = {(r["mesh_id"], r["plane"]): r for r in symmetry.score(planes, samples, Pyramid(v, f), masked).collect()}
    hidden = {(r["mesh_id"], r["fid"]) for r in masked.collect()}
    assert len(got) == 10
    for r in planes.collect():
        g, (vs, fs) = got[r["mesh_id"], r["plane"]], meshes[r["mesh_id"]]
        p = np.array([(s["x"], s["y"], s["z"]) for s in samples.where(F.col("mesh_id") == r["mesh_id"]).collect()])
        c = r["cutoff"]
        if not len(p):
            assert g["loss"] == math.inf and g["rms"] == 0 and g["samples"] == 0
            continue
        if r["plane"] == 9:
            assert g["loss"] == pytest.approx(c * c) and g["rms"] == c
            continue
        n = np.array([r["nx"], r["ny"], r["nz"]])
        q = p - 2 * ((p - [r["ox"], r["oy"], r["oz"]]) @ n - r["offset"])[:, None] * n
        d = np.array([nearest(q, *(vs[i] for i in t)) for t in fs])
        open_ = np.array([(r["mesh_id"], k) not in hidden for k in range(len(fs))])
        out, d = d[open_].min(axis=0) > d.min(axis=0) * (1 + 1e-9), d.min(axis=0)
        within = (d <= c) & ~out
        assert g["loss"] == pytest.approx(np.where(out, c * c, np.minimum(d * d, c * c)).mean(), rel=1e-9)
        assert g["rms"] == pytest.approx(math.sqrt((d[within] ** 2).mean()) if within.any() else c, rel=1e-9)


def test_planes_of_several_meshes_are_found(spark):
    turns = {"a": (turn(4), (3, -2, 5), True), "b": (turn(5) * 7, (100, 0, 0), False)}
    v, f = tables(spark, {m: wedge(*t) for m, t in turns.items()})
    masked = spark.createDataFrame([("a", k) for k in range(12, 15)], "mesh_id string, fid long")
    index = Pyramid(v, f)

    def right(rows):
        for r in rows:
            true = turns[r["mesh_id"]][0][:, 0] / np.linalg.norm(turns[r["mesh_id"]][0][:, 0])
            n, p = np.array([r["nx"], r["ny"], r["nz"]]), np.array([r["px"], r["py"], r["pz"]])
            assert abs(n @ true) > 0.99999 and abs((p - turns[r["mesh_id"]][1]) @ n) < 2e-3 * np.linalg.norm(turns[r["mesh_id"]][0][:, 0]), r
        return len(rows)

    assert right(symmetry.auto_symmetry(v, f, masked, index).collect()) == 2
    lines = []
    for m, (r, s, _) in turns.items():
        a, b = r @ (0.03, 0.3, 0.1) + s, r @ (0.0, 0.35, 2.5) + s
        lines.append((m, *map(float, a), *map(float, b)))
    kind = "mesh_id string, ax double, ay double, az double, bx double, by double, bz double"
    assert right(symmetry.symmetry_from_line(v, f, spark.createDataFrame(lines, kind), masked, index).collect()) == 2
    point = spark.createDataFrame([("a", *[1.0] * 6), ("b", *[None] * 6)], kind)
    assert symmetry.symmetry_from_line(v, f, point, masked, index).count() == 0


def test_mask_is_selection_and_rims(spark):
    v, f = tables(spark, {"a": wedge(np.eye(3), (0, 0, 0), True)})
    picked = spark.createDataFrame([("a", 0)], "mesh_id string, fid long")
    ids = lambda d: {r["fid"] for r in d.collect()}
    assert ids(symmetry.job_mask(f, picked, holes=True)) == {0, 12, 13, 14} and ids(symmetry.job_mask(f, picked, holes=False)) == {0} and symmetry.job_mask(f, holes=False) is None
