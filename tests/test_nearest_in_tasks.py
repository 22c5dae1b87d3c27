"""Nearest faces chosen in tasks, with numpy's distances."""

import random

import numpy as np

from facetry.operators import spatial
from facetry.operators.mesh import AXES
from facetry.operators.pyramid import CORNERS


def test_distances_in_tasks_are_those_of_the_expressions(spark):
    """Bit by bit, over flat, slim and degenerate triangles and points on them; equal distances go to the least fid of their mark."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        c = [[float(r.randint(0, 3)) if i % 3 else r.uniform(-9, 9) for _ in AXES] for _ in range(3)]
        c[2] = c[i % 2] if i % 7 == 0 else c[2]
        p = c[0] if i % 11 == 0 else [r.uniform(-5, 5) for _ in AXES]
        rows.append(("m", i // 4, 500 - i, i % 2 == 0, *p, *sum(c, [])))
    kinds = "mesh_id string, pid long, fid long, out boolean, " + ", ".join(f"{c} double" for c in (*AXES, *CORNERS))
    near = spark.createDataFrame(rows, kinds).coalesce(1)
    want = {x["fid"]: x["d"] for x in spatial.with_distance(near).collect()}
    at = np.array([x[4:] for x in rows]).T
    got = spatial.square_distances(list(at[:3]), [list(at[3 * k + 3 : 3 * k + 6]) for k in range(3)])
    assert [want[x[2]] for x in rows] == got.tolist()
    one = near.withColumn("·run", spatial.F.col("pid"))
    least = {(x["pid"], x["out"]): (x["d"], x["fid"]) for x in spatial.least_in_tasks(one, "out").collect()}
    brute = {}
    for x in rows:
        brute[x[1], x[3]] = min(brute.get((x[1], x[3]), (float("inf"), 0)), (want[x[2]], x[2]))
    assert least == brute and len(brute) == 200
