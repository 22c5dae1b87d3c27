"""Places on cubic nets by blocks of control points."""

import random

import pytest

from facetry.operators import freeform


@pytest.mark.parametrize("most", [5, 1 << 16])
def test_places_travel_once_to_blocks(spark, monkeypatch, most):
    r = random.Random(1)
    points = [("m", i, j, float(i), float(j), r.random()) for i in range(13) for j in range(8)]
    net = freeform.cubic_net(spark.createDataFrame(points, "mesh_id string, i long, j long, x double, y double, z double"))
    monkeypatch.setattr(freeform, "NET_BLOCK", 4)
    at = spark.createDataFrame([("m", i * 8 + j, i / 12, j / 7) for i in range(13) for j in range(8)], "mesh_id string, pid long, u double, v double")
    got = {x["pid"]: (x["x"], x["y"], x["z"]) for x in freeform.on_cubic_net(at, net, most).collect()}
    assert len(got) == 104
    for _, i, j, *p in points:
        assert got[i * 8 + j] == pytest.approx(p, abs=1e-9)
