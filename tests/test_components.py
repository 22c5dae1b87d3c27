"""Components and fans against sequential forms, and how much they shuffle and write."""

import random

import pytest

from facetry import tables
from facetry.operators import health, topology


def smallest(nodes, links):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for m, a, b in links:
        if (m, a) in top and (m, b) in top:
            a, b = find((m, a)), find((m, b))
            top[max(a, b)] = min(a, b)
    return {(m, x): find((m, x))[1] for m, x in nodes}


@pytest.mark.parametrize("spread", [1, 50_000])
@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components_of_chains_and_hubs(spark, monkeypatch, spread, small):
    """Ids near and far apart, chunks of a few links, several meshes, links to what is no node, lone and repeated nodes."""
    monkeypatch.setattr(topology, "AT_ONCE", 16)
    r = random.Random(spread + small)
    nodes = [(m, x * spread) for m in ("a", "b", "c") for x in range(120)]
    links = [("a", x * spread, (x + 1) * spread) for x in range(0, 90) if x % 31]
    links += [("b", r.randrange(120) * spread, r.randrange(120) * spread) for _ in range(70)]
    links += [("c", 119 * spread, x * spread) for x in range(0, 119, 2)] + [("c", 1 * spread, 7_777_777_777), ("c", 3 * spread, 7_777_777_777)]
    n = spark.createDataFrame(nodes + nodes[:5], "mesh_id string, fid long")
    e = spark.createDataFrame(links, "mesh_id string, fid long, nb long")
    got = topology.components(n, e, small=small).collect()
    assert {(x["mesh_id"], x["fid"]): x["root"] for x in got} == smallest(nodes, links) and len(got) == len(nodes)
    inner = e.where("nb < 7777777777")
    got = topology.components(n, inner, small=small, within=True).collect()
    assert {(x["mesh_id"], x["fid"]): x["root"] for x in got} == smallest(nodes, links) and len(got) == len(nodes)


def test_components_of_near_ids_leave_few_links(spark, monkeypatch):
    sizes = []
    real = tables.cut
    monkeypatch.setattr(topology, "cut", lambda df: sizes.append((df.columns, real(df).count())) or real(df))
    n = spark.range(20_000).selectExpr("'m' AS mesh_id", "id AS fid")
    e = spark.range(19_999).selectExpr("'m' AS mesh_id", "id AS fid", "id + 1 AS nb")
    assert topology.components(n, e, within=True).select("root").distinct().count() == 1
    assert [k for c, k in sizes if "top" not in c] == [0]  # all links met in one block


def test_fans_of_hubs_equal_those_of_rows(spark):
    r = random.Random(5)
    rows = [("m", i, *r.sample(range(14), 3)) for i in range(60)] + [("m", 60, 3, 3, 4), ("m", 61, 20, 21, 22), ("m", 62, 20, 23, 24)]
    f = spark.createDataFrame(rows, "mesh_id string, fid long, v0 long, v1 long, v2 long")
    got = {hub: {x["vid"]: x["fans"] for x in health.fans(f, hub).collect()} for hub in (0, 12, 1024)}
    assert got[0] == got[12] == got[1024] and got[0][20] == 2
    for vid, n in got[0].items():
        mine = [t for t in rows if vid in t[2:]]
        groups = [({t[1]}, set(t[2:]) - {vid} | ({vid} if t[2:].count(vid) > 1 else set())) for t in mine]
        while True:
            pair = next(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :] if a[1] & b[1]), None)
            if not pair:
                break
            groups = [g for g in groups if g is not pair[0] and g is not pair[1]] + [(pair[0][0] | pair[1][0], pair[0][1] | pair[1][1])]
        assert len(groups) == n
