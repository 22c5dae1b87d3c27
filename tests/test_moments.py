"""Circles and walls of many groups at once against the helper over single sets of points."""

import math

import numpy as np
import pytest

from facetry.operators import moments, rounds

from .test_alignment import tube


def test_groups_against_the_helper(spark):
    r = np.random.default_rng(6)
    a = r.uniform(0, 2 * math.pi, 500)
    ring = np.column_stack([1 + 5 * np.cos(a), 2 + 5 * np.sin(a), np.full(500, 0.5)]) + r.normal(0, 0.005, (500, 3))
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    sets = {
        "wall": tube(10.0, (1.0, 2.0, 3.0), 360, 0.02), "turned": tube(4.0, (0.0, 0.0, 0.0), 200, 0.01) @ turn.T + 1e4, "arc": tube(25.0, (5.0, 0.0, 0.0), 60, 0.01),
        "ring": ring, "small": ring * 1e-3, "line": np.column_stack([np.arange(9.0)] * 3), "two": ring[:2],
    }
    rows = [(k, *map(float, x)) for k, v in sets.items() for x in v] + [("wall", None, 1.0, 2.0)]
    got = {x["g"]: x for x in moments.circles(spark.createDataFrame(rows, "g string, x double, y double, z double"), ["g"]).collect()}
    assert set(got) == {"wall", "turned", "arc", "ring", "small"}
    for k, x in got.items():
        want, size = rounds.fit_circle(sets[k] - sets[k].mean(axis=0)), float(np.linalg.norm(np.ptp(sets[k], axis=0)))
        assert x["n"] == len(sets[k]) and x["is_cylinder"] == want["is_cylinder"], k
        assert abs(np.array([x["nx"], x["ny"], x["nz"]]) @ want["normal"]) > 0.9995, k
        assert x["radius"] == pytest.approx(want["radius"], rel=5e-3), k
        assert x["ms"] <= want["ms"] * 1.1 + 1e-12 * size**2, k
        off = np.array([x[f"center_{c}"] for c in "xyz"]) - sets[k].mean(axis=0) - want["center"]
        n = want["normal"]
        assert np.linalg.norm(off - (off @ n) * n) < 5e-3 * size, k


def test_moments_turn(spark):
    """Sums seen along a direction are those of the points themselves."""
    r = np.random.default_rng(8)
    p = r.normal(size=(300, 3)) * (3, 2, 1) + (10, 0, 5)
    (row,) = moments.moments(spark.createDataFrame([("m", *map(float, x)) for x in p], "g string, x double, y double, z double"), ["g"]).collect()
    t = moments.tensors(row.asDict())
    d = (p - p.mean(axis=0)) / row["scale"]
    for n in rounds.directions(7):
        u, w = rounds.frame(n)
        flat = np.column_stack([d @ u, d @ w])
        c, radius = rounds.algebraic_circle(flat)
        ms, got, centre = moments.seen_along(t, n)
        far = ((flat - c) ** 2).sum(axis=1)
        assert got == pytest.approx(radius) and np.allclose([centre @ u, centre @ w], c) and ms == pytest.approx(float(((far - radius**2) ** 2).mean()) / (4 * radius**2))


def test_empty(spark):
    assert moments.circles(spark.createDataFrame([], "g string, x double, y double, z double"), ["g"]).count() == 0
