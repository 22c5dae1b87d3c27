"""Analytic truth and invariants, mostly for what SQL can't express."""

import math
import random

import pytest

from facetry.operators import fitting, health, holes, mesh, spatial, topology
from facetry.sources import meshes, sinks

BOX = [(0, 3, 2), (0, 2, 1), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def tables(spark, points, faces, name="m"):
    v = spark.createDataFrame([(name, i, *map(float, p)) for i, p in enumerate(points)], "mesh_id string, vid long, x double, y double, z double")
    return v, spark.createDataFrame([(name, i, *t) for i, t in enumerate(faces)], "mesh_id string, fid long, v0 long, v1 long, v2 long")


def box_points(s=1.0, at=(0, 0, 0)):
    return [(at[0] + x * s, at[1] + y * s, at[2] + z * s) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]


def box(spark, faces=BOX, s=1.0):
    return tables(spark, box_points(s), faces)


def test_box_is_watertight(spark):
    r = health.report(*box(spark)).first()
    assert r["is_watertight"] and r["euler_characteristic"] == 2 and r["genus"] == 0 and r["component_count"] == 1 and r["hole_count"] == 0 and r["inconsistent_normals"] == 0


def test_open_box_has_a_hole_and_the_fan_closes_it(spark):
    v, f = box(spark, BOX[2:])
    h = holes.holes(v, f).collect()
    assert len(h) == 1 and h[0]["edges"] == 4 and h[0]["perimeter"] == pytest.approx(4) and h[0]["area"] == pytest.approx(1)
    v, f = holes.filled(v, f, holes.fan_fill(v, f))
    r = health.report(v, f).first()
    assert r["is_watertight"] and r["inconsistent_normals"] == 0


def test_defects_are_repaired(spark):
    faces = [*BOX, (0, 0, 1), (1, 2, 6), (8, 9, 10)]
    faces[2] = (4, 6, 5)
    v, f = tables(spark, [*box_points(), (100, 0, 0), (101, 0, 0), (100, 1, 0)], faces)
    r = health.report(v, f, loops=False).first()
    assert r["degenerate_faces"] == 1 and r["duplicate_faces"] == 1
    v2, f2 = health.auto_repair(v, f.where("fid != 13"), 0.05)
    r = health.report(v2, f2).first()
    assert r["faces"] == 12 and r["is_watertight"] and r["inconsistent_normals"] == 0
    volume = sum(p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0]) for p in ([[r[f"{a}{k}"] for a in "xyz"] for k in range(3)] for r in mesh.corners_of(v2, f2).collect()))
    assert volume == pytest.approx(6)


def test_bow_tie_has_one_non_manifold_vertex(spark):
    _, f = tables(spark, [(0, 0, 0)] * 5, [(0, 1, 2), (0, 3, 4)])
    assert [tuple(r) for r in health.fans(f).where("fans > 1").select("vid", "fans").collect()] == [(0, 2)]


def test_components_match_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1150)]
    nodes = sorted({*range(300), *range(1000, 1151)})
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    n = spark.createDataFrame([("m", x) for x in nodes], "mesh_id string, fid long")
    got = topology.components(n, spark.createDataFrame([("m", a, b) for a, b in links], "mesh_id string, fid long, nb long"))
    assert {x["fid"]: x["root"] for x in got.collect()} == {x: find(x) for x in nodes}


def test_flood_stops_at_creases(spark):
    v, f = box(spark)
    adj, g = topology.face_adjacency(f), mesh.face_geometry(v, f)
    seed = f.where("fid = 0").select("mesh_id", "fid")
    assert sorted(r["fid"] for r in topology.flood(f, adj, g, seed, 45).collect()) == [0, 1]
    assert topology.flood(f, adj, g, seed, 100).count() == 12


def test_closest_point_and_sphere_of_random_soup(spark):
    r = random.Random(1)
    points, faces = [], []
    for i in range(60):
        c = [r.uniform(0, 100) for _ in range(3)]
        points += [[x + r.uniform(-6, 6) for x in c] for _ in range(3)]
        faces.append((3 * i, 3 * i + 1, 3 * i + 2))
    v, f = tables(spark, points, faces)
    probes = [[r.uniform(-80, 180) for _ in range(3)] for _ in range(40)]
    p = spark.createDataFrame([("m", i, *q) for i, q in enumerate(probes)], "mesh_id string, pid long, x double, y double, z double")

    def far(q, t):
        """By a fine grid of barycentric points, refined around the best."""
        best, lo, size = (1e9, 0, 0), (0.0, 0.0), 1.0
        for _ in range(12):
            for i in range(9):
                for j in range(9):
                    a, b = lo[0] + size * i / 8, lo[1] + size * j / 8
                    if a >= -1e-12 and b >= -1e-12 and a + b <= 1 + 1e-12:
                        d = math.dist(q, [x + a * (y - x) + b * (z - x) for x, y, z in zip(*t)])
                        best = min(best, (d, a, b))
            size /= 2
            lo = (max(0, best[1] - size / 2), max(0, best[2] - size / 2))
        return best[0]

    want = [[far(q, [points[k] for k in t]) for t in faces] for q in probes]
    got = {x["pid"]: x["distance"] for x in spatial.closest(p, v, f, 10.0).collect()}
    assert all(got[i] == pytest.approx(min(w), abs=1e-2) for i, w in enumerate(want))
    near = {(x["pid"], x["fid"]) for x in spatial.within(p, v, f, 30.0).collect()}
    assert {(i, j) for i, w in enumerate(want) for j, d in enumerate(w) if d <= 29.95} <= near <= {(i, j) for i, w in enumerate(want) for j, d in enumerate(w) if d <= 30.05}


def test_ray_hits_the_near_side(spark):
    v, f = box(spark, s=2.0)
    rays = spark.createDataFrame([("m", 0, -5.0, 0.7, 0.9, 1.0, 0.0, 0.0), ("m", 1, -5.0, 5.0, 0.9, 1.0, 0.0, 0.0)], "mesh_id string, pid long, x double, y double, z double, dx double, dy double, dz double")
    got = spatial.ray_cast(rays, v, f, 1.0, 20.0).collect()
    assert [(r["pid"], r["t"]) for r in got] == [(0, pytest.approx(5.0))]


def test_fits(spark):
    r = random.Random(2)
    rows = [("m", r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-0.001, 0.001)) for _ in range(500)]
    p = spark.createDataFrame(rows, "mesh_id string, x double, y double, z double")
    fit = fitting.plane_fit(p, ["mesh_id"]).first()
    assert fit["nz"] > 0.999 and fit["max_dev"] < 0.002
    ring = spark.createDataFrame([("m", 1 + 5 * math.cos(t / 50), 2 + 5 * math.sin(t / 50)) for t in range(100)], "mesh_id string, x double, y double")
    c = fitting.circle_fit(ring, ["mesh_id"]).first()
    assert (c["cx"], c["cy"], c["radius"]) == (pytest.approx(1), pytest.approx(2), pytest.approx(5))
    ball = []
    for _ in range(300):
        q = [r.gauss(0, 1) for _ in range(3)]
        s = math.sqrt(sum(x * x for x in q))
        ball.append(("m", *(k + 7 * x / s for k, x in zip((1, -2, 3), q))))
    b = fitting.sphere_fit(spark.createDataFrame(ball, "mesh_id string, x double, y double, z double"), ["mesh_id"]).first()
    assert [b[c] for c in ("cx", "cy", "cz", "radius")] == [pytest.approx(x) for x in (1, -2, 3, 7)]


def test_sampling_follows_area(spark):
    v, f = tables(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (10, 0, 0), (13, 0, 0), (10, 1, 0)], [(0, 1, 2), (3, 4, 5)])
    s = {r["fid"]: r["n"] for r in mesh.sample_surface(v, f, 1000).groupBy("fid").count().withColumnRenamed("count", "n").collect()}
    assert s[0] == pytest.approx(250, abs=2) and s[1] == pytest.approx(750, abs=2)


@pytest.mark.parametrize("end", ["stl", "obj", "ply"])
def test_files_come_back(spark, tmp_path, end):
    v, f = box(spark, s=2.0)
    path = str(tmp_path / f"box.{end}")
    sinks.write_mesh(v, f, "m", path)
    v2, f2 = meshes.read_mesh(spark, path)
    r = health.report(v2, f2).first()
    assert r["faces"] == 12 and r["vertices_used"] == 8 and r["is_watertight"]
    assert mesh.surface_area(v2, f2).first()["area"] == pytest.approx(24)


@pytest.mark.parametrize(
    "parse,raw",
    [
        (meshes.parse_stl, b"no mesh"),
        (meshes.parse_stl, b"solid\nfacet\nvertex 1 2\nendfacet"),
        (meshes.parse_obj, b"v 0 0 0\nf 1 2 3"),
        (meshes.parse_obj, b"v 0 0 0\n"),
        (meshes.parse_ply, b"ply\nformat binary_big_endian 1.0\nend_header\n"),
        (meshes.parse_ply, b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\nabc"),
    ],
)
def test_bad_files_are_refused(parse, raw):
    with pytest.raises(meshes.MeshError):
        parse(raw)


def test_obj_quads_and_negative_references():
    p, f = meshes.parse_obj(b"v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf -4/1/1 -3 -2//2 -1\n")
    assert len(p) == 4 and f.tolist() == [[0, 1, 2], [0, 2, 3]]


def test_ascii_ply_with_extra_properties():
    p, f = meshes.parse_ply(b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float q\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty uchar flags\nproperty list uchar int vertex_indices\nend_header\n9 0 0 0\n9 1 0 0\n9 0 1 0\n7 3 0 1 -1\n")
    assert p.tolist() == [[0, 0, 0], [1, 0, 0], [0, 1, 0]] and f.tolist() == [[0, 1, 2]]


@pytest.mark.parametrize("small", [0, topology.SMALL])
def test_components_with_and_without_rounds(spark, small):
    rnd = random.Random(1)
    cases = {
        "none": ([1, 2], []),
        "chain": (list(range(300)), [(i, i + 1) for i in range(250)]),
        "star": (list(range(200)), [(199, i) for i in range(150)] + [(3, 3), (199, 0)]),
        "random": (list(range(400)), [(rnd.randrange(400), rnd.randrange(420)) for _ in range(300)]),  # some links lead to no node
    }
    want = {}
    for name, (nodes, links) in cases.items():
        up = {n: n for n in nodes}

        def root(n, up=up):
            while up[n] != n:
                n = up[n]
            return n

        for a, b in links:
            if a in up and b in up:
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        want |= {(name, n): root(n) for n in nodes}
    nodes = spark.createDataFrame([(k, n) for k, (ns, _) in cases.items() for n in ns], "mesh_id string, fid long")
    links = spark.createDataFrame([(k, *x) for k, (_, ls) in cases.items() for x in ls], "mesh_id string, fid long, nb long")
    assert {(r[0], r[1]): r[2] for r in topology.components(nodes, links, small).collect()} == want
    assert topology.components(nodes.limit(0), links.limit(0), small).collect() == []
