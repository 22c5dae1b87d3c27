"""The cell pyramid against brute force: sizes and distances of very different scale, several meshes, rays of any direction."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import spatial
from facetry.operators.pyramid import Pyramid

from .test_operators import box, tables


def nearest(p, tri):
    """Square distance and point, by the closest of the plane's point, if inside, and the three sides' points."""
    p, (a, b, c) = np.array(p, float), np.array(tri, float)
    found = []
    n = np.cross(b - a, c - a)
    if n @ n > 0:
        q = p - ((p - a) @ n) / (n @ n) * n
        if all(np.cross(y - x, q - x) @ n >= 0 for x, y in ((a, b), (b, c), (c, a))):
            found.append(q)
    for x, y in ((a, b), (b, c), (c, a)):
        t = np.clip((p - x) @ (y - x) / ((y - x) @ (y - x)), 0, 1) if (y - x) @ (y - x) > 0 else 0.0
        found.append(x + t * (y - x))
    return min(((p - q) @ (p - q), tuple(q)) for q in found)


def hit(o, d, tri, reach):
    a, b, c = np.array(tri, float)
    m = np.array([b - a, c - a, -np.array(d, float)]).T
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    u, w, t = np.linalg.solve(m, np.array(o, float) - a)
    return t if u >= 0 and w >= 0 and u + w <= 1 and 1e-6 < t <= reach else None


def soup(seed, n, sizes):
    r = random.Random(seed)
    points = []
    for _ in range(n):
        at, s = [r.uniform(-50, 50) for _ in range(3)], r.choice(sizes)
        points += [[x + r.uniform(-s, s) for x in at] for _ in range(3)]
    return points, [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(n)]


def two_meshes(spark):
    """Triangles from 0.01 to the scene's size in one mesh, tiny ones far from the origin in another, and a degenerate one."""
    p, f = soup(1, 150, [0.01, 0.5, 5])
    p += [[-60, -60, -10], [60, -60, -12], [0, 70, -11], [3, 3, 3], [3, 3, 3], [3, 3, 3]]
    f += [(450, 451, 452), (453, 454, 455)]
    q, g = soup(2, 40, [1.0])
    q = [[1e5 + x / 1000 for x in c] for c in q]
    v, faces = tables(spark, p, f, "a")
    w, more = tables(spark, q, g, "b")
    return v.union(w), faces.union(more), {"a": [[p[i] for i in t] for t in f], "b": [[q[i] for i in t] for t in g]}


def probes():
    r = random.Random(3)
    near = [("a", k, *(r.uniform(-60, 60) for _ in range(3))) for k in range(60)]
    far = [("a", 60 + k, *(r.choice([-1, 1]) * r.uniform(1e3, 1e6) for _ in range(3))) for k in range(20)]
    other = [("b", k, *(1e5 + r.uniform(-0.1, 0.1) for _ in range(3))) for k in range(20)] + [("b", 20, 0.0, 0.0, 0.0), ("b", 21, 1e140, 0.0, 0.0)]
    return near + far + other


SCHEMA = "mesh_id string, pid long, x double, y double, z double"


@pytest.mark.parametrize("cell", [1.0, 37.5])
def test_closest_of_any_size_and_distance(spark, cell):
    v, f, triangles = two_meshes(spark)
    points = spark.createDataFrame([*probes(), ("a", 900, None, 1.0, 1.0), ("a", 901, float("nan"), 1.0, 1.0), ("none", 1, 0.0, 0.0, 0.0)], SCHEMA)
    got = {(r["mesh_id"], r["pid"]): r for r in spatial.closest(points, v, f, cell).collect()}
    assert len(got) == points.count()
    assert all(got[k]["distance"] is None and got[k]["fid"] is None for k in (("a", 900), ("a", 901), ("none", 1)))
    for m, pid, *p in probes():
        r, want = got[m, pid], [nearest(p, t) for t in triangles[m]]
        d, q = min(want)
        assert r["distance"] == pytest.approx(math.sqrt(d), rel=1e-9, abs=1e-9)
        assert want[r["fid"]][0] == pytest.approx(d, rel=1e-9, abs=1e-12)
        if max(map(abs, p)) < 1e9:
            assert [r["qx"], r["qy"], r["qz"]] == pytest.approx(list(want[r["fid"]][1]), abs=1e-6 * max(1.0, *map(abs, p)) ** 0.5)


def test_rows_of_a_point_do_not_grow_with_distance(spark):
    """A flat plate of 3,200 triangles and one as large as the scene: far points meet few nodes."""
    n = 40
    points = [(x, y, 0.0) for y in range(n + 1) for x in range(n + 1)] + [(-500.0, -500.0, -1.0), (500.0, -500.0, -1.0), (0.0, 700.0, -1.0)]
    faces = [t for y in range(n) for x in range(n) for a in [y * (n + 1) + x] for t in ((a, a + 1, a + n + 2), (a, a + n + 2, a + n + 1))]
    v, f = tables(spark, points, [*faces, (len(points) - 3, len(points) - 2, len(points) - 1)], "m")
    index = Pyramid(v, f)
    far = spark.createDataFrame([("m", k, 20.3, 19.6, z) for k, z in enumerate((0.1, 3.0, 40.0, 1000.0, 40000.0))], SCHEMA)
    met = index.meetings(index.bounded(far), True)
    rows = {r["pid"]: r["count"] for r in met.join(index.triangles, ["mesh_id", "l", "cx", "cy", "cz"]).groupBy("pid").count().collect()}
    assert len(rows) == 5 and max(rows.values()) <= 60, rows
    got = {r["pid"]: r["distance"] for r in spatial.closest(far, v, f, pyramid=index).collect()}
    assert got == pytest.approx({0: 0.1, 1: 3.0, 2: 40.0, 3: 1000.0, 4: 40000.0})


def test_within_any_radius(spark):
    v, f, triangles = two_meshes(spark)
    points = spark.createDataFrame(probes()[:60], SCHEMA)
    hidden = f.where("mesh_id = 'a' AND fid % 3 = 0").select("mesh_id", "fid")
    for radius in (0.05, 7.0, 500.0):
        got = sorted((r["pid"], r["fid"]) for r in spatial.within(points, v, f, radius, hidden).collect())
        assert got == sorted((pid, k) for m, pid, *p in probes()[:60] for k, t in enumerate(triangles[m]) if k % 3 and nearest(p, t)[0] <= radius**2)


def test_rays_of_any_direction(spark):
    v, f, triangles = two_meshes(spark)
    r = random.Random(9)
    rays = []
    for k in range(80):
        d = [r.gauss(0, 1) for _ in range(3)] if k % 4 else [[1, 0, 0], [0, -1, 0], [0, 0, -1]][k // 4 % 3]
        s = math.sqrt(sum(x * x for x in d))
        rays.append(("a", k, *(r.uniform(-90, 90) for _ in range(3)), *(x / s for x in d)))
    at = np.mean([t for t in triangles["b"]], axis=1)
    for k in range(20):
        o = [1e5 + r.uniform(-1, 1) for _ in range(3)]
        d = np.array(at[k]) - o
        rays.append(("b", k, *o, *(d / np.sqrt(d @ d))))
    table = spark.createDataFrame([(m, k, *map(float, x)) for m, k, *x in rays], SCHEMA + ", dx double, dy double, dz double")
    for reach in (60.0, math.inf):
        got = {(x["mesh_id"], x["pid"]): (x["t"], x["fid"]) for x in spatial.ray_cast(table, v, f, 1.0, reach).collect()}
        for m, k, *x in rays:
            want = [(t, j) for j, tri in enumerate(triangles[m]) if (t := hit(x[:3], x[3:], tri, reach)) is not None]
            assert ((m, k) in got) == bool(want), (m, k)
            if want:
                assert got[m, k][0] == pytest.approx(min(want)[0], rel=1e-6, abs=1e-6) and got[m, k][1] == min(want)[1]
        assert sum(m == "a" for m, _ in got) >= 5 and sum(m == "b" for m, _ in got) >= 10


def test_box_from_outside_and_corners(spark):
    v, f = box(spark, s=2.0)
    p = spark.createDataFrame([("m", 0, 6.0, 1.0, 1.0), ("m", 1, 2.5, 2.5, 2.5), ("m", 2, 1.0, 1.0, 0.9)], SCHEMA)
    got = {r["pid"]: (r["distance"], r["qx"], r["qy"], r["qz"]) for r in spatial.closest(p, v, f).collect()}
    assert got[0] == pytest.approx((4.0, 2.0, 1.0, 1.0)) and got[1] == pytest.approx((0.5 * math.sqrt(3), 2, 2, 2)) and got[2] == pytest.approx((0.9, 1.0, 1.0, 0.0))
    rays = spark.createDataFrame([("m", 0, -5.0, 0.7, 0.9, 1.0, 0.0, 0.0), ("m", 1, -5.0, 0.7, 0.9, -1.0, 0.0, 0.0), ("m", 2, 1.2, 0.7, 0.9, 0.0, 0.0, 1.0)], SCHEMA + ", dx double, dy double, dz double")
    assert {r["pid"]: r["t"] for r in spatial.ray_cast(rays, v, f).collect()} == pytest.approx({0: 5.0, 2: 1.1})


def test_no_faces(spark):
    v, f = box(spark)
    points = spark.createDataFrame([("m", 0, 6.0, 1.0, 1.0)], SCHEMA)
    (r,) = spatial.closest(points, v, f.limit(0)).collect()
    assert r["distance"] is None and spatial.within(points, v, f.limit(0), 10.0).count() == 0


def test_rays_begin_at_the_level_of_their_way_through_the_box(spark, monkeypatch):
    n = 40
    points = [(float(x), float(y), 0.1 * ((x * 7 + y * 3) % 5)) for y in range(n) for x in range(n)]
    faces = [t for y in range(n - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n + 1), (a, a + n + 1, a + n))]
    v = spark.createDataFrame([("m", i, *p) for i, p in enumerate(points)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", i, *t) for i, t in enumerate(faces)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    down = [("m", i, x + 0.25, x + 0.5, 9.0, 0.0, 0.0, -1.0) for i, x in enumerate((0.0, 17.0, 38.0))]
    rays = spark.createDataFrame(down + [("m", 7, -3.0, 5.3, 0.2, 1.0, 0.0, 0.0), ("m", 8, 9.0, 9.0, 9.0, 0.0, 0.0, 1.0)], "mesh_id string, pid long, x double, y double, z double, dx double, dy double, dz double")
    fronts, rounds = [], Pyramid._rounds
    monkeypatch.setattr(Pyramid, "_rounds", lambda self, front, *a: fronts.append((self.top, front)) or rounds(self, front, *a))
    found = {r["pid"]: r["t"] for r in spatial.ray_cast(rays, v, f).collect()}
    top, front = fronts[0]
    assert front.where("pid < 7").agg(F.max("l")).first()[0] < top and front.where("pid = 7").agg(F.max("l")).first()[0] == top
    assert set(found) == {0, 1, 2, 7} and found[7] >= 3

    def hit(o, d):
        best = math.inf
        for a, b, c in faces:
            p, e1, e2 = np.array(points[a]), np.subtract(points[b], points[a]), np.subtract(points[c], points[a])
            m = np.stack([e1, e2, -np.array(d)], 1)
            if abs(np.linalg.det(m)) > 1e-12:
                u, w, t = np.linalg.solve(m, np.array(o) - p)
                if u >= 0 and w >= 0 and u + w <= 1 and 1e-6 < t < best:
                    best = t
        return best

    for r in rays.where("pid < 8").collect():
        assert found[r["pid"]] == pytest.approx(hit(r[2:5], r[5:8]))
