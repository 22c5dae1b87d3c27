"""Stream samples against the sequential generator and a sequential running sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import stream
from facetry.operators import sampling
from facetry.tables import carried, running


def words(seed, n):
    """The stream one number after another, in Python's whole numbers."""
    all_ = (1 << 64) - 1
    s0, s1 = (int(x) for x in stream.seeded(seed))
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & all_
    for _ in range(n):
        yield turn(s0 * 5 & all_, 7) * 9 & all_
        s1 ^= s0
        s0, s1 = (turn(s0, 24) ^ s1 ^ (s1 << 16)) & all_, turn(s1, 37)


def test_jumps_land_where_steps_lead():
    start = np.repeat(stream.seeded(5)[None], 4, axis=0)
    far = stream.jump(start, np.array([0, 1, 777, 3000]))
    want = list(words(5, 3001))
    assert [int(x) for x in stream.output(far)] == [want[k] for k in (0, 1, 777, 3000)]
    assert (stream.jump(start[:1], np.array([2**62 + 2**61]))  == stream.jump(stream.jump(start[:1], np.array([2**62])), np.array([2**61]))).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_are_those_of_one_stream(spark, parts):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 3)).astype(float)
    f = r.integers(0, 60, size=(200, 3))
    f[:40, 1] = f[:40, 0]  # slivers of no area, the first face among them
    big = np.array([[0.0, 0, 0], [500, 0, 0], [0, 500, 0]])  # a face with almost all of the area
    v = np.concatenate([v, big])
    f = np.concatenate([f, [[60, 61, 62]], f[-20:]])
    vs = spark.createDataFrame([(m, i, *map(float, p)) for m in ("a", "b") for i, p in enumerate(v)], "mesh_id string, vid long, x double, y double, z double")
    fs = spark.createDataFrame([(m, 3 * i, *map(int, t)) for m in ("a", "b") for i, t in enumerate(f)] + [("none", 0, 0, 0, 0)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    masked = fs.where("mesh_id = 'a' AND fid = 600 OR mesh_id = 'b'").select("mesh_id", "fid")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 2500
        for mask in (None, masked):
            rows = sampling.stream_sample(vs, fs, n, 11, mask).collect()
            assert {x["mesh_id"] for x in rows} == ({"a", "b"} if mask is None else {"a"})
            for m in {x["mesh_id"] for x in rows}:
                keep = np.array([k for k in range(len(f)) if mask is None or k != 200])
                t = v[f[keep]]
                area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2
                cum = np.concatenate([[0.0], np.cumsum(np.maximum(area, 1e-20) if mask is None else area)])
                w = np.array(list(words(11, 3 * n)), np.uint64).reshape(n, 3)
                at = (w[:, 0] >> np.uint64(11)).astype(float) / 2**53 * cum[-1]
                a, b = ((w[:, k] >> np.uint64(40)).astype(float) / 2**24 for k in (1, 2))
                a, b = np.where(a + b > 1, 1 - a, a), np.where(a + b > 1, 1 - b, b)
                k = np.clip(np.searchsorted(cum, at) - 1, 0, None)
                got = sorted((x for x in rows if x["mesh_id"] == m), key=lambda x: x["i"])
                assert [x["i"] for x in got] == list(range(n)) and [x["fid"] for x in got] == (3 * keep[k]).tolist()
                want = t[k, 0] + (t[k, 1] - t[k, 0]) * a[:, None] + (t[k, 2] - t[k, 0]) * b[:, None]
                assert np.allclose([(x["x"], x["y"], x["z"]) for x in got], want, rtol=0, atol=1e-9)
        assert sampling.stream_sample(vs, fs, 0, 11).count() == 0 and sampling.stream_sample(vs, fs.where("false"), 9, 11).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_running_sums_and_carried_values(spark):
    r = np.random.default_rng(4)
    rows = [(int(m), i, int(x), int(x) if x % 3 == 0 else None) for i, (m, x) in enumerate(r.integers(0, 50, size=(500, 2)) % [2, 50])]
    d = spark.createDataFrame(rows, "mesh_id long, k long, x long, y long")
    got = {x["k"]: x for x in carried(running(d, ["k"], "x", "sum"), ["k"], "y", "last").collect()}
    for m in (0, 1):
        total, last = 0, None
        for _, k, x, y in (x for x in rows if x[0] == m):
            last = y if y is not None else last
            assert (got[k]["sum"], got[k]["last"]) == (total, last)
            total += x
    assert len(got) == 500 and carried(d.where(F.lit(False)), ["k"], "y", "last").count() == 0


def test_no_join_puts_a_mesh_into_one_task(spark, monkeypatch):
    """Joins by mesh_id alone hold a row a mesh on one side, and don't rest on the planner's own choice of a broadcast."""
    import re

    plans = []
    for name in ("running", "carried"):
        real = getattr(sampling, name)
        monkeypatch.setattr(sampling, name, lambda df, *a, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sampling.stream_sample(v, f, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any(re.search(r"(SortMerge|ShuffledHash)Join \[mesh_id#\d+\]", p) for p in plans)
