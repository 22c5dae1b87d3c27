"""Groups of normals of many vertices at once."""

import numpy as np

from facetry.operators import shading


def test_many_vertices_equal_each(monkeypatch):
    """Random, equal, zero and chained normals, of vertices of one to forty corners."""
    r = np.random.default_rng(2)
    size = r.integers(1, 41, 300)
    n = r.normal(size=(size.sum(), 3)) * [0.6, 0.6, 0.2] + [0, 0, 1]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    n[::7], n[1::11] = n[0], 0.0
    want = np.concatenate([shading.smooth_groups(x) for x in np.split(n, np.cumsum(size)[:-1])])
    assert np.array_equal(shading.smooth_groups_of(n, size), want) and want.max() > 2
    monkeypatch.setattr(shading, "smooth_groups", None)
    few = size <= shading.WIDE
    assert len(shading.smooth_groups_of(n[np.repeat(few, size)], size[few])) == size[few].sum()
