"""Decimation, CAD text, writers of sparse ids and colours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import color
from facetry.operators import decimation, health
from facetry.sources import cad, meshes, sinks
from facetry.tables import cut

from .test_operators import BOX, box_points, tables


def sphere(r=10.0, rings=16, sectors=32):
    points = [(0.0, 0.0, r)] + [(r * math.sin(a) * math.cos(b), r * math.sin(a) * math.sin(b), r * math.cos(a)) for a in np.linspace(0, math.pi, rings + 1)[1:-1] for b in np.linspace(0, 2 * math.pi, sectors, endpoint=False)] + [(0.0, 0.0, -r)]
    at = lambda i, j: 1 + i * sectors + j % sectors
    faces = [(0, at(0, j), at(0, j + 1)) for j in range(sectors)] + [(len(points) - 1, at(rings - 2, j + 1), at(rings - 2, j)) for j in range(sectors)]
    for i in range(rings - 2):
        for j in range(sectors):
            faces += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    return points, faces


def sheet(n, step=1.0):
    points = [(step * x, step * y, 0.0) for y in range(n) for x in range(n)]
    return points, [t for y in range(n - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n + 1), (a, a + n + 1, a + n))]


TETRAHEDRON = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]
SHARE = 0.7


def named(spark, meshes):
    """One table each of vertices and faces of several meshes."""
    made = [[t.withColumn("mesh_id", F.lit(n)) for t in tables(spark, *m)] for n, m in meshes.items()]
    v, f = made[0]
    for x, y in made[1:]:
        v, f = v.unionByName(x), f.unionByName(y)
    return v, f


@pytest.fixture(scope="module")
def decimated(spark):
    """Meshes of very different sizes in one call: name -> (points and faces before, corners of the faces left, report, error)."""
    waves = [(x, y, 0.3 * math.sin(x * 2.1 + y * 1.3)) for x, y, _ in sheet(6)[0]], sheet(6)[1]
    meshes = {"large": sphere(1000.0, 8, 16), "small": sphere(0.01, 6, 10), "tetrahedron": TETRAHEDRON, "flat": sheet(6), "waves": waves, "no limit given": sheet(3)}
    v, f = (cut(t) for t in named(spark, meshes))
    limits = spark.createDataFrame([(n, 0.01 if n == "waves" else math.inf) for n in meshes if n != "no limit given"], "mesh_id string, limit double")
    nv, nf, error = (cut(t) for t in decimation.decimate(v, f, SHARE, limits))
    report = {r["mesh_id"]: r for r in health.report(nv, nf, loops=False).collect()}
    errors = {r["mesh_id"]: r["error"] for r in error.collect()}
    at = {(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in nv.collect()}
    left = {n: [] for n in meshes}
    for r in nf.collect():
        left[r["mesh_id"]].append([at[r["mesh_id"], r[f"v{k}"]] for k in range(3)])
    return {n: (*m, np.array(left[n]), report[n], errors[n]) for n, m in meshes.items()}


def test_flat_sheets_collapse_without_error(decimated):
    _, faces, t, _, error = decimated["flat"]
    assert abs(len(t) - math.floor(SHARE * len(faces))) <= 1 and error < 1e-6
    area = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])[:, 2]
    assert (area > 0).all() and area.sum() / 2 == pytest.approx(25)


def test_meshes_of_very_different_size_have_their_own_targets_and_stay_closed(decimated):
    for n in ("large", "small"):
        _, faces, t, r, error = decimated[n]
        assert abs(len(t) - math.floor(SHARE * len(faces))) <= 1
        assert r["boundary_edges"] == 0 and r["non_manifold_edges"] == 0 and r["euler_characteristic"] == 2
        assert 0 < error < (200 if n == "large" else 0.005)
    assert len(decimated["tetrahedron"][2]) == 4 and decimated["tetrahedron"][4] == 0


def test_vertices_left_are_old_ones(decimated):
    for points, _, t, _, _ in decimated.values():
        assert {tuple(p) for p in t.reshape(-1, 3)} <= {tuple(map(float, p)) for p in points}


def test_limits_hold_by_mesh(decimated):
    assert decimated["waves"][4] <= 0.01 and decimated["waves"][3]["euler_characteristic"] == 1
    assert len(decimated["no limit given"][2]) == 8


def test_borders_can_be_locked(spark):
    points, faces = sheet(4)
    nv, nf, _ = decimation.decimate(*tables(spark, points, faces), 1e-4, lock_border=True)
    rim = {p for p in points if p[0] in (0, 3) or p[1] in (0, 3)}
    assert rim == {(p["x"], p["y"], p["z"]) for p in nv.collect()} and nf.count() == 10


def test_decimation_of_awkward_rows(spark):
    v, f = tables(spark, *sheet(4))
    none = decimation.decimate(v.limit(0), f.limit(0), 0.5)
    assert [t.count() for t in none] == [0, 0, 0]
    bad = spark.createDataFrame([(f.first()["mesh_id"], 900, 0, 0, 1), (f.first()["mesh_id"], 901, 0, 1, 777)], f.select("mesh_id", "fid", "v0", "v1", "v2").schema)
    nv, nf, _ = decimation.decimate(v.withColumn("w", F.lit(1)).withColumn("q00", F.lit(1)), f.select("mesh_id", "fid", "v0", "v1", "v2").union(bad), 1.0)
    assert nf.count() == 18 and nv.count() == 16


def test_most_collapses_go_in_tiles_and_few_rounds_join(spark, monkeypatch):
    points, faces = [(x, y, math.sin(x * 1.7) + math.sin(y * 1.1 + x)) for x, y, _ in sheet(26)[0]], sheet(26)[1]
    rounds, sound = [], decimation._sound
    monkeypatch.setattr(decimation, "_sound", lambda *a: rounds.append(1) or sound(*a))
    nv, nf, error = (cut(t) for t in decimation.decimate(*tables(spark, points, faces), 0.6, tile=150))
    r = health.report(nv, nf, loops=False).first()
    assert not rounds and abs(r["faces"] - math.floor(0.6 * len(faces))) <= 1
    assert r["euler_characteristic"] == 1 and r["non_manifold_edges"] == 0 and r["isolated_verts"] == 0 and 0 < error.first()["error"] < 1
    assert {(p["x"], p["y"], p["z"]) for p in nv.collect()} <= set(points)


def test_vertices_of_too_full_tiles_wait_for_the_rounds(spark):
    points, faces = sphere(10.0, 5, 8)
    nv, nf, _ = (cut(t) for t in decimation.decimate(*tables(spark, points, faces), 0.97, most=0))
    r = health.report(nv, nf, loops=False).first()
    assert abs(r["faces"] - math.floor(0.97 * len(faces))) <= 1 and r["euler_characteristic"] == 2 and r["boundary_edges"] == 0


def test_automatic_decimation_by_mesh(spark):
    meshes = {"ball": sphere(10.0, 5, 8), "sheet": sheet(3)}
    v, f = named(spark, meshes)
    nv, nf = decimation.auto_decimate(v, f, 4.0, 5.0, passes=2)
    n = {r["mesh_id"]: r["count"] for r in nf.groupBy("mesh_id").count().collect()}
    assert n["ball"] < 0.8 * len(meshes["ball"][1]) and n["sheet"] < 8
    most = {r["mesh_id"]: r["max_dev"] for r in decimation.measure(v, nv, nf, 5.0)[0].collect()}
    assert most["ball"] <= 4.0 * 1.6 and most["sheet"] <= 4.0 * 1.6


def test_deviation_figures():
    assert decimation.contour_match(0.5, 20.0) == pytest.approx(97.5) and decimation.contour_match(1.0, 0.0) == 0.0
    assert decimation.target_deviation(99, 20.0) == pytest.approx(0.2)


FEATURES = [{"kind": "plane", "point": (0, 0, 5), "normal": (0, 0, 1), "name": "Plane 1"}, {"kind": "circle", "point": (1, 2, 3), "normal": (0, 0, 1), "radius": 4.0, "name": "it's"}, {"kind": "plane", "point": (0, 0, 0), "normal": (1, 0, 0), "visible": False}]


def test_step_refers_only_to_what_it_defines():
    import re

    text = cad.write(FEATURES, "/x/a b.step", 100.0)
    defined = set(re.findall(r"^(#\d+)=", text, re.M))
    assert set(re.findall(r"#\d+", text)) == defined and text.count("ADVANCED_FACE") == 2 and text.count("EDGE_CURVE") == 6 and text.endswith("END-ISO-10303-21;\n")
    assert cad.step([], 20.0).endswith("END-ISO-10303-21;\n")


def test_dxf_and_script():
    text = cad.write(FEATURES, "a.dxf", 100.0).split("\n")
    assert text.count("LINE") == 4 + 64 and text.count("3DFACE") == text.count("POINT") == text.count("CIRCLE") == 1 and text[-2] == "EOF"
    made = []
    space: dict = {}
    exec(compile(cad.write(FEATURES, "a.py", 100.0), "a.py", "exec"), space)  # noqa: S102
    space["build"](lambda *a: made.append(a), lambda *a: made.append(a))
    assert made == [("Plane 1", [0.0, 0.0, 0.5], [0.0, 0.0, 1.0]), ("it's", [0.1, 0.2, 0.3], [0.0, 0.0, 1.0], 0.4)]


@pytest.mark.parametrize("end", ["ply", "obj"])
def test_sparse_ids_are_written_dense(spark, tmp_path, end):
    v, f = tables(spark, box_points(), BOX)
    f = f.select("mesh_id", "fid", *[(F.col(f"v{k}") * 10 + 5).alias(f"v{k}") for k in range(3)])
    sinks.write_mesh(v.withColumn("vid", F.col("vid") * 10 + 5), f, "m", f"{tmp_path}/a.{end}")
    back = meshes.read_mesh(spark, f"{tmp_path}/a.{end}")
    assert health.report(*back).first()["is_watertight"] and back[0].count() == 8
    with pytest.raises(ValueError):
        sinks.write_mesh(v, f, "m", "a.xyz")


def test_colours(spark):
    import colorsys

    r = spark.range(5).select(color.group_color(F.col("id")).alias("g"), color.heat(F.col("id") / 4).alias("h"), color.vertex_color(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(None).cast("array<double>"), color.heat(F.lit(0.5)), F.lit(None).cast("array<double>"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("c")).collect()
    for i, x in enumerate(r):
        assert x["g"] == pytest.approx(colorsys.hsv_to_rgb(i * 0.618033988749895 % 1, 0.6, 0.95)) and x["h"] == pytest.approx(color.HEAT[i][1])
        assert x["c"] == pytest.approx([0.6, 0.4, 0.0])
