"""Repair with one numbering against its steps one after the other."""

import random

from facetry.operators import health, topology

from .test_operators import tables


def rough(seed):
    """A sheet with turned, doubled, flat and missing faces, fins on some edges, a far small piece and a strip of Moebius."""
    r, w = random.Random(seed), 12
    p = [(x * 1.0, y * 1.0, r.random()) for y in range(w) for x in range(w)] + [(50 + x, 0.0, x * y) for x in range(2) for y in range(2)]
    t = [x for y in range(w - 1) for x in range(w - 1) if r.random() > 0.15 for a in [y * w + x] for x in ((a, a + 1, a + w + 1), (a, a + w + 1, a + w))]
    t = [x if r.random() > 0.3 else (x[0], x[2], x[1]) for x in t]
    t += [(0, 0, 1), (3, 4, 3), t[5], (10, 11, w * w), (10, 11, w * w + 1)] + [(w * w + a, w * w + b, w * w + c) for a, b, c in ((0, 1, 2), (1, 3, 2))]
    k = len(p)
    p += [(100.0 + i, i % 2, i * i) for i in range(5)]
    t += [(k + i, k + (i + 1) % 5, k + (i + 2) % 5) for i in range(5)]
    return p, t


def test_repair_equals_its_steps(spark, monkeypatch):
    v, f = tables(spark, *rough(1))
    v2, f2 = tables(spark, *rough(2))
    v, f = v.union(v2.selectExpr("'n' AS mesh_id", "vid", "x", "y", "z")), f.union(f2.selectExpr("'n' AS mesh_id", "fid", "v0", "v1", "v2"))
    a, b = health.remove_degenerate(v, f)
    a, b = health.remove_small_components(a, health.unify_normals(a, b), 0.02)
    want = sorted(map(tuple, a.collect())), sorted(map(tuple, b.select("mesh_id", "fid", "v0", "v1", "v2").collect()))
    calls, compact = [], health.compact
    monkeypatch.setattr(health, "compact", lambda *x: calls.append(1) or compact(*x))
    a, b = health.auto_repair(v, f, 0.02)
    assert len(calls) == 1
    assert (sorted(map(tuple, a.select("mesh_id", "vid", "x", "y", "z").collect())), sorted(map(tuple, b.collect()))) == want


def test_pairs_at_edges_by_blocks(spark):
    f = tables(spark, *rough(3))[1].selectExpr("mesh_id", "fid", "5000 * v0 AS v0", "5000 * v1 AS v1", "5000 * v2 AS v2")  # over many blocks
    sides = {}
    for r in f.collect():
        for k in range(3):
            u, v = r[f"v{k}"], r[f"v{(k + 1) % 3}"]
            sides.setdefault((min(u, v), max(u, v)), []).append((r["fid"], u))
    want = sorted((fid, min(x)[0], u == min(x)[1], len(x) == 2) for x in sides.values() for fid, u in x if fid != min(x)[0])
    assert sorted((r["fid"], r["other"], r["alike"], r["two"]) for r in topology.edge_pairs(f).collect()) == want
