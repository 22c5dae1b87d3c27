"""Freeform surfaces, bridges, brushes, crease splits and their small parts."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import bridging, freeform, holes, mesh, picking, shading, topology
from facetry.sources import cad


def sheet(spark, n, name="m", lift=0.0, first=0, fid=0):
    """A square of n x n cells at a height."""
    v = [(name, first + j * (n + 1) + i, float(i), float(j), lift) for j in range(n + 1) for i in range(n + 1)]
    f = []
    for j in range(n):
        for i in range(n):
            a = first + j * (n + 1) + i
            f += [(name, fid + len(f), a, a + 1, a + n + 2), (name, fid + len(f) + 1, a, a + n + 2, a + n + 1)]
    return spark.createDataFrame(v, "mesh_id string, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id string, fid long, v0 long, v1 long, v2 long")


def cloud(spark, fun, n=400, name="m"):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 10, (n, 2))
    return spark.createDataFrame([(name, k, float(x), float(y), float(fun(x, y))) for k, (x, y) in enumerate(xy)], "mesh_id string, pid long, x double, y double, z double")


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0, 1, (60, 2)), rng.uniform(50, 51, (60, 2))])
    q = rng.uniform(-5, 60, (25, 2))
    points = spark.createDataFrame([("m", k, float(a), float(b)) for k, (a, b) in enumerate(p)], "mesh_id string, pid long, x double, y double")
    queries = spark.createDataFrame([("m", k, float(a), float(b)) for k, (a, b) in enumerate(q)], "mesh_id string, qid long, x double, y double")
    sizes = spark.createDataFrame([("m", 0.3, 500.0)], "mesh_id string, size double, most double")
    got = {}
    for r in freeform.nearest(queries, points, sizes, 7).collect():
        got.setdefault(r["qid"], set()).add(r["pid"])
    want = {k: set(np.argsort(((p - a) ** 2).sum(1))[:7].tolist()) for k, a in enumerate(q)}
    assert got == want
    few = {r["qid"] for r in freeform.nearest(queries, points.where("pid < 3"), sizes, 7).collect()}
    assert few == set(range(25))


def test_a_tilted_plane_is_fitted_without_error(spark):
    v, f, stats = freeform.fit_freeform(cloud(spark, lambda x, y: 2 + 0.3 * x - 0.2 * y), resolution=20, overshoot=0.5)
    s = stats.first()
    assert s["points"] > 300 and s["max_dev"] < 1e-6 and s["fold"] < 0.2
    assert v.where(F.abs(F.col("z") - (2 + 0.3 * F.col("x") - 0.2 * F.col("y"))) > 1e-6).count() == 0
    up = mesh.face_geometry(v, f)
    assert up.select("nx", "ny", "nz").distinct().count() >= 1 and up.where("nz < 0.5").count() == 0


def test_curvature_follows_a_bowl_better_than_slope(spark):
    points = cloud(spark, lambda x, y: 0.02 * ((x - 5) ** 2 + (y - 5) ** 2))
    slope, bent = (freeform.fit_freeform(points, resolution=16, overshoot=0.5, extend=e, smoothness=0)[2].first()["rms"] for e in ("slope", "curvature"))
    assert bent < slope


def test_small_selections_give_no_surface(spark):
    v, f, stats = freeform.fit_freeform(cloud(spark, lambda x, y: x, n=8), resolution=16)
    assert v.count() == f.count() == stats.count() == 0


def test_smoothing_keeps_planes_inside_and_skips_invalid_nodes():
    h = np.arange(5)[None, :] * np.ones((5, 1))
    out = freeform.smoothed(h, np.ones((5, 5), bool), 1)
    assert np.allclose(out[:, 1:-1], h[:, 1:-1])
    valid = np.ones((3, 3), bool)
    valid[1, 1] = False
    h = np.zeros((3, 3))
    h[1, 1] = 100
    assert np.array_equal(freeform.smoothed(h, valid, 4), h)


def test_the_net_passes_through_its_nodes_and_is_written(spark):
    grid = freeform.full_grid(cloud(spark, lambda x, y: math.sin(x / 3)), "m", resolution=16, overshoot=0.5)
    net, ku, kv = freeform.control_net(grid)
    rows, columns = grid.shape[:2]
    at = [(i, j) for i in range(0, columns, 3) for j in range(0, rows, 4)]
    got = freeform.on_net(net, ku, kv, [i / (columns - 1) for i, _ in at], [j / (rows - 1) for _, j in at])
    assert np.abs(got - [grid[j, i] for i, j in at]).max() < 1e-8
    text = cad.step_freeform(net, ku, kv, "it's")
    assert text.count("B_SPLINE_CURVE_WITH_KNOTS") == 4 and text.count("EDGE_CURVE") == 4 and "it''s" in text
    m = re.search(r"B_SPLINE_SURFACE_WITH_KNOTS\(.*?\.F\.,\.F\.,\.F\.,\(([\d,]+)\),\(([\d,]+)\)", text)
    assert [sum(map(int, g.split(","))) for g in m.groups()] == [columns + 4, rows + 4]
    named = set(re.findall(r"^(#\d+)=", text, re.M))
    assert set(re.findall(r"#\d+", text)) == named


def test_tiles_smooth_as_the_whole_grid_does(spark):
    r = np.random.default_rng(8)
    rows = []
    want = {}
    for name, (w, h) in {"a": (23, 17), "b": (1, 5), "c": (9, 40)}.items():
        z, ok = r.normal(size=(h, w)), r.random((h, w)) < 0.8
        rows += [(name, i, j, float(z[j, i]), bool(ok[j, i]), i + j) for j in range(h) for i in range(w)]
        for passes in (0, 3, 11):
            out = freeform.smoothed(z, ok, passes)
            want |= {(passes, name, i, j): out[j, i] for j in range(h) for i in range(w)}
    d = spark.createDataFrame(rows + [("d", 0, 0, 1.0, None, 0), ("d", 1, 0, None, True, 0)], "mesh_id string, i int, j int, h double, valid boolean, g int")
    for passes in (0, 3, 11):
        got = freeform.smoothed_nodes(d.withColumnRenamed("g", "mark"), passes, tile=7, halo=4)
        assert got.columns == ["mesh_id", "i", "j", "h", "valid", "mark"]
        rows = got.collect()
        assert len(rows) == len(want) // 3 + 2
        for x in rows:
            if x["mesh_id"] != "d":
                assert x["h"] == pytest.approx(want[passes, x["mesh_id"], x["i"], x["j"]], abs=1e-12)
        assert {(x["i"], x["h"]) for x in rows if x["mesh_id"] == "d"} == {(0, 1.0), (1, None)}


def test_net_by_rows_and_columns(spark):
    r = np.random.default_rng(9)
    sizes, rows, at, want = {"a": (11, 6), "b": (4, 4)}, [], [], {}
    for name, (w, h) in sizes.items():
        p = r.normal(size=(h, w, 3))
        rows += [(name, i, j, *map(float, p[j, i])) for j in range(h) for i in range(w)]
        net, ku, kv = freeform.control_net(p)
        uv = np.concatenate([r.random((60, 2)), [(i / (w - 1), j / (h - 1)) for i in range(w) for j in range(h)]])
        at += [(name, k, float(a), float(b)) for k, (a, b) in enumerate(uv)]
        want |= {(name, k): q for k, q in enumerate(freeform.on_net(net, ku, kv, uv[:, 0], uv[:, 1]))}
    rows += [("hole", i, j, 0.0, 0.0, 0.0) for i in range(5) for j in range(5) if (i, j) != (2, 2)] + [("thin", i, 0, 0.0, 0.0, 0.0) for i in range(9)]
    net = freeform.cubic_net(spark.createDataFrame(rows, "mesh_id string, i int, j int, x double, y double, z double"))
    assert {x["mesh_id"] for x in net.select("mesh_id").distinct().collect()} == set(sizes)
    got = freeform.on_cubic_net(spark.createDataFrame([*at, ("hole", 0, 0.5, 0.5), ("a", -1, None, 0.5)], "mesh_id string, pid long, u double, v double"), net).collect()
    assert len(got) == len(want)
    for x in got:
        assert np.allclose((x["x"], x["y"], x["z"]), want[x["mesh_id"], x["pid"]], rtol=0, atol=1e-9)


def test_knots_are_compressed():
    assert cad.compressed([0, 0, 0, 0, 0.5, 1, 1, 1, 1]) == [(0.0, 4), (0.5, 1), (1.0, 4)]
    assert freeform.basis_values(freeform.knots(6), np.linspace(0, 1, 31)).sum(1) == pytest.approx(np.ones(31))


def test_requests_while_a_refit_runs_are_merged():
    seen = []

    def fit(k):
        seen.append(k)
        if k == 1:
            queue.ask(k=2)
            queue.ask(k=3)
        return k

    queue = freeform.RefitQueue(fit)
    assert queue.ask(k=1) == 3 and seen == [1, 3] and not queue.running


def test_trails_take_paths_before_cycles():
    assert bridging.trails([1, 2, 7, 8, 9], [2, 3, 8, 9, 7]) == [([1, 2, 3], False), ([7, 8, 9], True)]
    assert bridging.trails([], []) == []


@pytest.mark.parametrize("method", ["linear", "hermite", "arc"])
def test_a_bridge_joins_both_rims(method):
    a = np.array([[0.0, y, 0] for y in range(4)])
    b = np.array([[5.0, y, 0] for y in (3, 1.5, 0)])
    up3, up4 = np.tile([0.0, 0, 1], (3, 1)), np.tile([0.0, 0, 1], (4, 1))
    points, faces, turned = bridging.bridge_patch(a, up4, b, up3, method, segments=5, bulge=0.0, fairing=2)
    assert turned and len(points) == 7 + 4 * 4
    use = {}
    for t in faces:
        for k in range(3):
            e = tuple(sorted((t[k], t[(k + 1) % 3])))
            use[e] = use.get(e, 0) + 1
    assert max(use.values()) == 2
    assert all(use[k, k + 1] == 1 for k in (0, 1, 2, 4, 5))  # the rims are open sides of the patch
    n = [np.cross(points[y] - points[x], points[z] - points[x]) for x, y, z in faces]
    assert len({bool(m[2] > 0) for m in n}) == 1
    assert sum(np.linalg.norm(m) for m in n) / 2 == pytest.approx(15.0)
    other = bridging.bridge_patch(a, up4, b, up3, method, segments=5, fairing=2, flip_normals=True)[1]
    assert other == [(x, z, y) for x, y, z in faces]


def test_a_bulge_rises_in_the_middle():
    a, b, up = np.array([[0.0, 0, 0], [0, 1, 0]]), np.array([[4.0, 0, 0], [4, 1, 0]]), np.tile([0.0, 0, 1], (2, 1))
    points = bridging.bridge_patch(a, up, b, up, "arc", segments=4, bulge=0.5, fairing=0)[0]
    assert points[:, 2].max() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        bridging.bridge_patch(a[:1], up[:1], b, up)
    with pytest.raises(ValueError):
        bridging.bridge_patch(a, up, b, up, "straight")


def test_bridged_sheets_hang_together(spark):
    v1, f1 = sheet(spark, 3)
    v2, f2 = sheet(spark, 3, lift=0.0, first=100, fid=100)
    v2 = v2.withColumn("x", F.col("x") + 6)
    v, f = v1.union(v2), f1.union(f2)
    clusters = f.select("mesh_id", "fid", (F.col("fid") >= 100).cast("long").alias("cluster"))
    adj, g, n = topology.face_adjacency(f), mesh.face_geometry(v, f), mesh.vertex_normals(v, f)
    _, rows = bridging.rims(f, adj, g, clusters)
    assert sorted((r["cluster"], r["open"], r["faces"], r["nz"]) for r in rows.collect()) == [(0, True, 18, 1.0), (1, True, 18, 1.0)]
    nv, nf = holes.filled(v, f, bridging.bridges(v, f, adj, g, n, clusters, 1.0, segments=3))
    assert topology.face_components(nf).select("root").distinct().count() == 1
    assert nv.select("vid").distinct().count() == nv.count()
    with pytest.raises(ValueError, match="has 1"):
        bridging.bridges(v, f, adj, g, n, clusters.where("cluster = 0"), 1.0)


def test_connected_brush_stays_on_its_sheet(spark):
    v1, f1 = sheet(spark, 6)
    v2, f2 = sheet(spark, 6, lift=-0.2, first=100, fid=100)
    v, f = v1.union(v2), f1.union(f2)
    hits = spark.createDataFrame([("m", 1, 30, 3.0, 3.0, 0.0, 1.6)], "mesh_id string, pid long, fid long, x double, y double, z double, radius double")
    wide = {r["fid"] for r in picking.brush(hits, v, f, (3.0, 3.0, 50.0)).collect()}
    own = {r["fid"] for r in picking.connected_brush(hits, v, f, topology.face_adjacency(f), (3.0, 3.0, 50.0)).collect()}
    assert own == {x for x in wide if x < 100} and len(own) < len(wide)
    assert {r["fid"] for r in picking.brush(hits, v, f, (3.0, 3.0, -50.0)).collect()} == {30}
    hidden = f.where("fid = 30").select("mesh_id", "fid")
    assert 30 not in {r["fid"] for r in picking.brush(hits, v, f, (3.0, 3.0, 50.0), hidden).collect()}


def test_what_is_projected_is_picked(spark):
    v, f = sheet(spark, 4)
    camera = picking.Camera.view("top", (0.0, 0.0, 0.0), (4.0, 4.0, 0.0), 4 / 3)
    points = spark.createDataFrame([("m", 0, 1.3, 2.6, 0.0), ("m", 1, 1.0, 1.0, 1000.0)], "mesh_id string, pid long, x double, y double, z double")
    seen = camera.project(points, 640, 480).orderBy("pid").collect()
    assert seen[1]["sx"] is None and 0 < seen[0]["sx"] < 640
    pixels = spark.createDataFrame([("m", 0, seen[0]["sx"], seen[0]["sy"]), ("m", 2, 1.0, 1.0)], "mesh_id string, pid long, sx double, sy double")
    (hit,) = picking.pick(camera, pixels, 640, 480, v, f, 1.0, 50.0).collect()
    assert (hit["x"], hit["y"], hit["z"]) == pytest.approx((1.3, 2.6, 0.0), abs=1e-9)
    assert camera.brush_radius(points.limit(1), 10.0, 480).first()["radius"] > 0


def test_creases_split_vertices(spark):
    v = spark.createDataFrame([("m", k, x, y, z) for k, (x, y, z) in enumerate([(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0)])], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 2, 1), ("m", 1, 2, 4, 1), ("m", 2, 0, 1, 3)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    rows, faces = shading.crease_split(v, f)
    assert rows.groupBy("vid").count().orderBy("vid").collect() == [(0, 2), (1, 2), (2, 1), (3, 1), (4, 1)]
    assert faces.count() == 3 and faces.where("r0 IS NULL OR r1 IS NULL OR r2 IS NULL").count() == 0
    keyed, _ = shading.crease_split(v, f, f.selectExpr("mesh_id", "fid", "fid AS key"))
    assert keyed.count() == 9 and keyed.where("vid = 2").select("nz").distinct().count() == 1


def test_overlay_lines(spark):
    v, _ = sheet(spark, 2)
    assert shading.box_segments(mesh.bounding_box(v)).count() == 12
    assert shading.triad_segments(v.limit(1), 2.0).count() == 3
    feature = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0, 0.0, 1.0, 2.0)], "feature_id long, px double, py double, pz double, nx double, ny double, nz double, radius double")
    assert shading.plane_segments(feature, 10.0, 4).count() == 10
    ring = shading.circle_segments(feature, 8).collect()
    assert all(math.hypot(r["ax"], r["ay"]) == pytest.approx(2.0) and r["bz"] == 5.0 for r in ring) and len(ring) == 8
