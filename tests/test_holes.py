"""Loops and fills against analytic truth and brute force."""

import math

import numpy as np
import pytest

from facetry.operators import health, holes, loops, patches

from .test_operators import BOX, box, tables


def ring(n, bend=0.0):
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return np.stack([np.cos(a), np.sin(a), bend * np.cos(2 * a)], axis=1)


def test_cycles_come_apart_where_they_touch():
    two = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (5, 6), (6, 2)]
    assert loops.simple_cycles(*zip(*two)) == [[0, 1, 2, 3], [2, 4, 5, 6]]
    assert loops.simple_cycles(*zip((0, 1), (1, 2), (2, 0), (2, 7), (7, 8), (4, 5), (5, 4))) == [[0, 1, 2]]  # a dead end, and two edges


def test_two_holes_that_touch(spark):
    """A grid of 6 x 6 cells without two that share a corner."""
    w = 7
    points = [(x, y, 0) for y in range(w) for x in range(w)]
    faces = []
    for y in range(w - 1):
        for x in range(w - 1):
            if (x, y) not in ((2, 2), (3, 3)):
                a = y * w + x
                faces += [(a, a + 1, a + w + 1), (a, a + w + 1, a + w)]
    h = holes.holes(*tables(spark, points, faces)).orderBy("hole_id").collect()
    assert [r["edges"] for r in h] == [24, 4, 4] and [r["hole_id"] for r in h] == [1, 2, 3]
    assert all(len(r["vertices"]) == r["edges"] for r in h)


@pytest.mark.parametrize("n", [3, 4, 7, 20])
@pytest.mark.parametrize("method", patches.METHODS)
def test_patches_close_the_rim(n, method):
    rim = ring(n, 0.2)
    points, faces = patches.patch(rim, method)
    uses = patches.edge_uses(faces)
    sides = {tuple(sorted((i, (i + 1) % n))) for i in range(n)}
    assert all(uses[e] == 1 for e in sides) and all(k == 2 for e, k in uses.items() if e not in sides)
    directed = {(int(t[k]), int(t[(k + 1) % 3])) for t in faces for k in range(3)}
    assert all(((i + 1) % n, i) in directed for i in range(n))  # against the rim
    assert patches.areas(np.concatenate([rim, points]), faces).min() > 0


def all_triangulations(i, j):
    if j - i < 2:
        yield []
    for k in range(i + 1, j):
        for a in all_triangulations(i, k):
            for b in all_triangulations(k, j):
                yield [*a, *b, (j, k, i)]


def test_least_area_is_least_of_all(seed=4):
    rim = ring(8, 0.6) + np.random.default_rng(seed).normal(0, 0.1, (8, 3))
    got = patches.areas(rim, patches.least_area(rim)[1]).sum()
    assert got == pytest.approx(min(patches.areas(rim, np.array(t)).sum() for t in all_triangulations(0, 7)))


def test_ears_of_a_concave_rim_fill_it_exactly():
    rim = np.array([(0, 0, 0), (4, 0, 0), (4, 4, 0), (2, 1, 0), (0, 4, 0)], float)
    assert patches.areas(rim, patches.ear_clip(rim)[1]).sum() == pytest.approx(patches.newell(rim)[1]) == pytest.approx(10)


def test_smooth_fill_bulges_and_flips_help():
    rim = ring(24)
    low, high = (patches.patch(rim, "smooth", bulge=b, density=2.0)[0] for b in (0.0, 0.5))
    assert len(low) > 20 and np.abs(low[:, 2]).max() < 1e-9 and high[:, 2].max() > 0.1
    quad = np.array([(0, 0, 0), (1, 1.5, 0), (0, 4, 0), (-1, 1.5, 0)], float)
    assert sorted(map(sorted, patches.flip_edges(quad, np.array([(0, 1, 2), (0, 2, 3)]), set()).tolist())) == [[0, 1, 3], [1, 2, 3]]


def test_solver_prefers_the_flat_fill_and_snaps():
    plane = [{"kind": "plane", "point": (0, 0, 0), "normal": (0, 0, 1), "radius": 0.0}]
    best = patches.best_patch(ring(12), plane)
    assert best["score"] < 1e-9 and best["tried"] > 10
    made = patches.patch(ring(12), "smooth", bulge=0.5, density=2.0)
    assert np.abs(patches.snapped(ring(12), made, plane)[0][:, 2]).max() < np.abs(made[0][:, 2]).max()
    tube = {"kind": "cylinder", "point": (0, 0, 0), "normal": (0, 0, 1), "radius": 2.0}
    assert patches.distances(np.array([[5.0, 0, 0], [2, 0, 1], [2, 0, 7]]), [tube])[:, 0].tolist() == [3, 0, 3]
    assert np.allclose(patches.projected(np.array([[5.0, 0, 1]]), [tube]), [[2, 0, 1]])


@pytest.mark.parametrize("method", patches.METHODS)
def test_filled_boxes_are_watertight(spark, method):
    v, f = box(spark, [*BOX[1:6], *BOX[7:]])
    v, f = holes.filled(v, f, holes.fill(v, f, method))
    r = health.report(v, f).first()
    assert r["is_watertight"] and r["inconsistent_normals"] == 0 and r["hole_count"] == 0


def test_solve_in_spark(spark):
    v, f = box(spark, BOX[2:])
    r = holes.solve(v, f, [{"kind": "plane", "point": (0.0, 0.0, 0.0), "normal": (0.0, 0.0, 1.0), "radius": 0.0}]).first()
    assert r["score"] == pytest.approx(0) and r["hole_id"] == 1


def test_solver_splits_a_rim_once(monkeypatch):
    calls = []
    flips = patches.flip_edges
    monkeypatch.setattr(patches, "flip_edges", lambda *a, **k: calls.append(1) or flips(*a, **k))
    rim, plane = ring(12, 0.4), [{"kind": "plane", "point": (0.0, 0.0, 0.0), "normal": (0.0, 0.0, 1.0), "radius": 0.0}]
    best = patches.best_patch(rim, plane)
    assert len(calls) == 1 and best["tried"] > 40
    settings = {k: best[k] for k in ("method", "mode", "bulge", "iterations") if k in best}
    assert patches.judged(rim, patches.patch(rim, **settings), plane) == (best["rms"], best["max_dev"], best["score"])


def test_holes_are_dealt_over_tasks(spark):
    v = spark.createDataFrame([("m", i, float(i), 0.0, 0.0) for i in range(3)], "mesh_id string, vid long, x double, y double, z double")
    h = spark.createDataFrame([("m", k, [0, 1, 2]) for k in range(64)], "mesh_id string, hole_id int, vertices array<long>")
    from pyspark.sql import functions as F

    assert holes._rims(v, h).select(F.spark_partition_id()).distinct().count() > 1


def test_ears_of_long_rims_are_those_of_a_whole_search(monkeypatch):
    def searched(rim):
        p = patches.flat(rim, patches.newell(rim)[0])
        left, faces = list(range(len(rim))), []
        while len(left) > 3:
            corners = [[left[(k + j) % len(left)] for j in (-1, 0, 1)] for k in range(len(left))]
            turns = [patches._turn(*p[t]) for t in corners]
            inside = lambda t: [x for x in left if x not in t and all(patches._turn(p[s], p[e], p[x]) >= -1e-14 for s, e in zip(t, t[1:] + t[:1]))]
            k = next((k for k, t in enumerate(corners) if turns[k] > 1e-14 and not inside(t)), int(np.argmax(turns)))
            faces.append(tuple(reversed(corners[k])))
            left.pop(k)
        return [*faces, tuple(left[::-1])]

    r = np.random.default_rng(5)
    star = lambda n: ring(n) * (1 + 0.6 * r.random(n))[:, None] + [0, 0, 0.1]
    for rim in (star(9), star(30), star(41), r.normal(size=(17, 3))):
        assert [tuple(t) for t in patches.ear_clip(rim)[1].tolist()] == searched(rim)
    rim = star(150)
    calls = []
    ears = patches.ear_clip
    monkeypatch.setattr(patches, "ear_clip", lambda x: calls.append(1) or ears(x))
    monkeypatch.setattr(patches, "RIM_PAIRS", 200)
    patches.best_patch(rim, [{"kind": "plane", "point": (0, 0, 0), "normal": (0, 0, 1), "radius": 0.0}])
    assert len(calls) == 1
    assert np.array_equal(patches.from_rim(ring(40), rim), np.linalg.norm(ring(40)[:, None] - rim[None], axis=2).min(axis=1))


def test_the_solver_query_settles_every_hole_of_the_scan(spark):
    from facetry.plans.catalog import QUERIES
    from facetry.plans.scans import scan

    d = "/root/testdata/sf0.001"
    found = holes.holes(*scan(spark, d)).collect()
    got = QUERIES["g13_solve_fill"](spark, d).collect()
    assert max(r["edges"] for r in found) > 12
    assert sorted(r["hole_id"] for r in got) == sorted(r["hole_id"] for r in found)
