"""Removal of degenerate faces judges them once."""

from facetry.operators import health

from .test_operators import box


def test_kept_faces_are_judged_once(spark, monkeypatch):
    v, f = box(spark)
    made = []
    monkeypatch.setattr(health, "cut", lambda t: made.append(t.columns) or t.localCheckpoint())
    assert health.remove_degenerate(v, f)[1].count() == f.count() and made
