import math
import random
from collections import Counter

import numpy as np
import pytest

from facetry.llm import permutation

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, query_id int, block long"


def table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, "x", 2, 3) for i, v in rows], SCHEMA)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def product(a, b):
    return float((np.array(a, np.float32).astype(float) * np.array(b, np.float32).astype(float)).sum())


def brute(rows, every=20, k=20):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and fine(v)})
    sizes = Counter(len(v) for _, v in rows)
    size = max(sizes, key=lambda n: (sizes[n], n), default=0)
    rows = [r for r in rows if len(r[1]) == size]
    out = []
    for q in {i for i, _ in rows if i % every == 0}:
        found = sorted((-product(v, w), j) for i, v in rows if i == q for j, w in rows if j != q)
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def vectors(n, size=6, seed=1):
    r = random.Random(seed)
    return [(k * 7 % 1009, [float(np.float32(r.gauss(0, 1) * r.choice([1, 3]))) for _ in range(size)]) for k in range(n)]


AWKWARD = [(20, None), (40, []), (60, [0.0] * 6), (80, [1.0, None, 0, 0, 0, 0]), (100, [float("nan")] * 6), (120, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (140, [1.0, 2.0]), (-20, [1.0, -0.0, 0, 0, 0, 0]), (160, [1.0, 0.0, 0, 0, 0, 0])]


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(math.isclose(x[3], y[3], rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_awkward_rows_against_brute_force(spark):
    rows = vectors(180) + AWKWARD
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (0, rows[5][1])]  # repeated, ids with two vectors
    close(got(permutation.nearest(table(spark, rows))), brute(rows))


def test_copies_and_ties(spark):
    """A third of the rows are one vector; their smallest ids are the answer, the query's own left out."""
    hot = [float(x) for x in range(1, 7)]
    rows = [(k, hot if k % 3 else v) for k, (_, v) in enumerate(vectors(600))]
    assert len(brute(rows)) == 600
    close(got(permutation.nearest(table(spark, rows), block=64)), brute(rows))


def test_few_rows(spark):
    assert got(permutation.nearest(table(spark, []))) == got(permutation.nearest(table(spark, [(20, [1.0])]))) == got(permutation.nearest(table(spark, [(20, [0.0]), (40, None)]))) == []
    rows = [(20, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [-1.0, 0.5])]
    assert got(permutation.nearest(table(spark, rows))) == [(20, 1, 1, 1.0), (20, 2, 2, 0.0)]
    huge = [(20, [1e30, 1.0]), (1, [3e38, 1.0]), (2, [-1.0, 0.5])]
    assert [r[2] for r in got(permutation.nearest(table(spark, huge)))] == [1, 2]


def test_footrule_of_posting_lists():
    rng = np.random.default_rng(3)
    n, pivots, prefix = 50, 20, 7
    near = np.array([rng.permutation(pivots)[:prefix] for _ in range(n)])
    order = np.argsort(near.ravel(), kind="stable")
    starts = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))
    row = {"v": np.zeros((n, 2)).tobytes(), "ids": np.arange(n), "counts": np.ones(n, np.int32).tobytes(), "starts": starts.astype(np.int32).tobytes(), "slots": (order // prefix).astype(np.int32).tobytes(), "ranks": (order % prefix).astype(np.int16).tobytes()}
    block = permutation.Block(row, 2, pivots, prefix)
    for q in near[:10]:
        rank = lambda x, p: list(x).index(p) if p in x else prefix
        assert block.footrule(q).tolist() == [sum(abs(rank(q, p) - rank(x, p)) for p in range(pivots)) for x in near]


@pytest.mark.parametrize("sf, groups", [("sf0.01", 32768), ("sf0.1", 32768), ("sf0.1", 30)])
def test_recall(spark, sf, groups):
    """With production parameters; more groups of queries give the same rows."""
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    found = {}
    for q, _, i, s in got(permutation.nearest(e, group=groups)):
        found.setdefault(q, []).append((i, s))
    rows = e.collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = (v * v[at]).sum(1)
        best = [k for k in np.lexsort((ids, -score)) if k != at][:20]
        hits += len({ids[k] for k in best} & {i for i, _ in found[ids[at]]})
        scores = dict(zip(ids.tolist(), score.tolist(), strict=True))
        assert len(found[ids[at]]) == 20 and all(math.isclose(s, scores[i], rel_tol=1e-12) for i, s in found[ids[at]])
    assert len(found) == sum(ids % 20 == 0) and hits >= 0.95 * 20 * len(found)


def test_uneven_lengths(spark):
    """Inner products of vectors of very different lengths are searched as well."""
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 16)) * r.lognormal(0, 0.7, (3000, 1))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    want, have = brute(rows, 100), got(permutation.nearest(table(spark, rows), every=100))
    assert len(have) == len(want) and len({x[:1] + x[2:3] for x in have} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)
