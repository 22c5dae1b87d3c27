"""Loops walked many at once, and patches in plain numbers."""

import numpy as np

from facetry.operators import holes, loops, patches

from .test_operators import tables


def test_many_loops_are_walked_in_batches_as_one_by_one(spark, monkeypatch):
    w = 13
    gone = {(4 * i + 1, 4 * j + 1) for i in range(3) for j in range(3)} | {(6, 6), (2, 2)}
    f = [t for y in range(w - 1) for x in range(w - 1) if (x, y) not in gone for a in [y * w + x] for t in ((a, a + 1, a + w + 1), (a, a + w + 1, a + w))]
    v, f = tables(spark, [(x * 1.0, y * 1.0, (x * y) % 3) for y in range(w) for x in range(w)], f)
    f = f.union(f.selectExpr("'n' AS mesh_id", "fid", "v0", "v1", "v2"))
    monkeypatch.setattr(loops, "WALKED", 3)
    plans = []
    monkeypatch.setattr(loops, "cut", lambda t: plans.append(t._jdf.queryExecution().optimizedPlan().toString()) or t.localCheckpoint())
    got = loops.ordered_loops(f).collect()
    assert not any("FlatMapGroupsInPandas" in p for p in plans)
    uses = {(r[f"v{k}"], r[f"v{(k + 1) % 3}"]) for r in f.where("mesh_id = 'm'").collect() for k in range(3)}
    open_edges = [(a, b) for a, b in uses if (b, a) not in uses]
    want = loops.simple_cycles(*zip(*open_edges))
    for name in "mn":
        assert sorted(list(r["vertices"]) for r in got if r["mesh_id"] == name) == want and len(want) == 12
    assert len({(r["mesh_id"], r["root"], r["part"]) for r in got}) == len(got) and max(r["part"] for r in got) > 0


def test_flips_and_least_areas_make_no_small_arrays(monkeypatch):
    """The smooth patch of a square hole of eight edges, worked out once with np.cross for each face."""
    rim = np.array([(0, 0, 3), (100, 0, 70), (200, 0, 9), (200, 100, 55), (200, 200, 20), (100, 200, 81), (0, 200, 34), (0, 100, 12)], float)
    calls = []
    cross = np.cross
    monkeypatch.setattr(patches.np, "cross", lambda *a, **k: calls.append(1) or cross(*a, **k))
    points, faces = patches.patch(rim, "smooth", density=1.5)
    assert len(calls) < 10
    uses = patches.edge_uses(faces)
    assert len(faces) == 6 + 2 * len(points) and sorted(uses.values()) == [1] * 8 + [2] * (len(uses) - 8)


def test_known_holes_are_not_found_again(spark, monkeypatch):
    w = 6
    f = [t for y in range(w - 1) for x in range(w - 1) if (x, y) != (2, 2) for a in [y * w + x] for t in ((a, a + 1, a + w + 1), (a, a + w + 1, a + w))]
    v, f = tables(spark, [(x * 1.0, y * 1.0, 0.0) for y in range(w) for x in range(w)], f)
    found = holes.holes(v, f).where("edges <= 4").localCheckpoint()
    monkeypatch.setattr(holes, "holes", None)
    faces = holes.fill(v, f, "ear", found=found)[1].collect()
    assert len(faces) == 2 and {r[f"v{k}"] for r in faces for k in range(3)} == {14, 15, 20, 21}
