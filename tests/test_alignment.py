"""Alignment, symmetry, circles and histories against analytic truth."""

import math

import numpy as np
import pytest

from facetry.operators import alignment, mesh, rounds, topology, versions

from .test_operators import box


def test_turns_compose_and_take_directions():
    r = np.random.default_rng(1)
    for a, b in [*r.normal(size=(20, 2, 3)), ((1, 0, 0), (-1, 0, 0)), ((0, 0, 1), (0, 0, 1))]:
        a, b = np.asarray(a, float), np.asarray(b, float)
        assert np.allclose(alignment.rotate(alignment.turn_between(a, b), a / np.linalg.norm(a)), b / np.linalg.norm(b))
    p, q = (x / np.linalg.norm(x) for x in r.normal(size=(2, 4)))
    v = r.normal(size=3)
    assert np.allclose(alignment.rotate(alignment.times(p, q), v), alignment.rotate(p, alignment.rotate(q, v)))


def test_three_two_one_undoes_any_motion():
    r = np.random.default_rng(2)
    q = r.normal(size=4)
    q /= np.linalg.norm(q)
    t = r.normal(size=3)
    true = {"z": ((1.0, 2, 3), (0, 0, 1)), "x": ((4.0, 5, 6), (1, 0, 0)), "y": ((7.0, 8, 9), (0, 1, 0))}
    slots = {a: {"point": alignment.rotate(q, p) + t, "normal": alignment.rotate(q, n)} for a, (p, n) in true.items()}
    turn, shift, residual = alignment.align(slots, primary="z")
    assert residual == pytest.approx(0, abs=1e-5)
    for a, f in slots.items():
        k = "xyz".index(a)
        assert abs(alignment.rotate(turn, f["normal"])[k]) == pytest.approx(1) and (alignment.rotate(turn, f["point"]) + shift)[k] == pytest.approx(0, abs=1e-9)
    assert alignment.without(*alignment.auto_slots([{"kind": "circle", "feature_id": 7}, {"kind": "plane", "feature_id": 8}]), 7) == ({"y": {"kind": "plane", "feature_id": 8}}, None)


def test_plane_parameters_come_back():
    n, d = alignment.from_parameters(*alignment.to_parameters((0.48, 0.6, 0.64), 3.0))
    assert np.allclose(n, (0.48, 0.6, 0.64)) and d == 3.0


def tube(radius, centre, degrees, noise=0.0, seed=1):
    r = np.random.default_rng(seed)
    a, z = (x.ravel() for x in np.meshgrid(np.radians(np.linspace(0, degrees, 60)), np.linspace(0, 10, 12)))
    return np.column_stack([centre[0] + radius * np.cos(a), centre[1] + radius * np.sin(a), z]) + r.normal(0, noise, (a.size, 3))


@pytest.mark.parametrize("radius, centre, degrees, noise, within", [(8, (2, -3), 240, 0, 0.01), (12, (0, 0), 30, 0, 0.1), (9, (3, -7), 200, 0.02, 0.02)])
def test_cylinder_patches(radius, centre, degrees, noise, within):
    got = rounds.fit_circle(tube(radius, centre, degrees, noise))
    assert got["is_cylinder"] and got["radius"] == pytest.approx(radius, abs=within) and abs(got["normal"][2]) > 0.99


def test_planar_ring_is_no_cylinder():
    a = np.linspace(0, 2 * math.pi, 720, endpoint=False)
    got = rounds.fit_circle(np.column_stack([1 + 5 * np.cos(a), 2 + 5 * np.sin(a), np.full(720, 0.5)]))
    assert not got["is_cylinder"] and got["radius"] == pytest.approx(5, abs=1e-3) and np.allclose(got["center"], (1, 2, 0.5), atol=1e-3)


def test_history_and_rings(spark):
    h = versions.History({"n": 0}, steps=3)
    for n in range(1, 6):
        h.do(n=n)
    assert [h.undo()["n"] for _ in range(5)] == [4, 3, 2, 2, 2] and h.redo()["n"] == 3
    h.do(n=9)
    assert h.redo()["n"] == 9
    v, f = box(spark)
    rings = versions.Rings(f.where("fid = 0"), topology.face_adjacency(f), mesh.face_geometry(v, f), 100.0)
    first, second = rings.grow().count(), rings.grow().count()
    assert 1 < first < second and rings.shrink().count() == first and rings.shrink().count() == 1 and rings.shrink().count() == 0
    assert versions.Settings.load({"angle": 500, "later": 1}).angle == 180.0 and versions.Settings.load(versions.Settings().store()) == versions.Settings()
    one, two = f.where("fid < 3").select("mesh_id", "fid"), f.where("fid BETWEEN 2 AND 4").select("mesh_id", "fid")
    assert versions.stroke(one, two).count() == 5 and versions.stroke(one, two, True).count() == 2 and versions.select(one, two, False).count() == 3
