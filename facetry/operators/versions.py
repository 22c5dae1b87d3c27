"""Histories: snapshots with undo and redo, rings of a selection that shrink exactly as they grew, strokes. Tables are immutable, so a version is a pointer."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame

from .topology import KEY, grow, shrink

STEPS = 25


class History:
    """Snapshots of any state (a dict of tables and values), at most STEPS to go back; a new one forgets what was undone."""

    def __init__(self, state: dict, steps: int = STEPS):
        self.now, self.steps = state, steps
        self.before: list[dict] = []
        self.after: list[dict] = []

    def do(self, **changes) -> dict:
        self.before = [*self.before, self.now][-self.steps :]
        self.now, self.after = self.now | changes, []
        return self.now

    def undo(self) -> dict:
        if self.before:
            self.after.append(self.now)
            self.now = self.before.pop()
        return self.now

    def redo(self) -> dict:
        if self.after:
            self.before.append(self.now)
            self.now = self.after.pop()
        return self.now

    def replace_mesh(self, vertices: DataFrame, faces: DataFrame) -> dict:
        """A new mesh: what was derived from the old one (selection, groups, holes, hidden regions, heat) goes."""
        gone = dict.fromkeys([k for k in ("selection", "groups", "holes", "hidden", "heat") if k in self.now])
        return self.do(vertices=vertices, faces=faces, **gone)


class Rings:
    """A selection that grows ring by ring; shrinking first takes back the rings that it grew by, then shrinks by topology."""

    def __init__(self, selected: DataFrame, adjacency: DataFrame, geometry: DataFrame, degrees: float = 45.0):
        self.adjacency, self.geometry, self.degrees = adjacency, geometry, degrees
        self.rings = [selected.select(*KEY).distinct()]

    @property
    def selected(self) -> DataFrame:
        return self.rings[-1]

    def grow(self) -> DataFrame:
        self.rings.append(grow(self.adjacency, self.geometry, self.selected, self.degrees))
        return self.selected

    def shrink(self) -> DataFrame:
        if len(self.rings) > 1:
            self.rings.pop()
        else:
            self.rings = [shrink(self.adjacency, self.selected)]
        return self.selected


def stroke(selected: DataFrame, touched: DataFrame, erase: bool = False) -> DataFrame:
    """A selection after a brush passed over faces; passing twice changes nothing more."""
    if erase:
        return selected.select(*KEY).join(touched, KEY, "left_anti")
    return selected.select(*KEY).union(touched.select(*KEY)).distinct()


def select(selected: DataFrame, other: DataFrame, add: bool) -> DataFrame:
    """Another selection in place of this one, or added to it."""
    return stroke(selected, other) if add else other.select(*KEY).distinct()


def region(faces: DataFrame, name: str, regions: DataFrame) -> DataFrame:
    """A named hidden region's faces as a selection. regions: mesh_id, name, faces."""
    from pyspark.sql import functions as F

    return faces.select(*KEY).join(regions.where(F.col("name") == name).select("mesh_id", F.explode("faces").alias("fid")), KEY, "left_semi").distinct()


@dataclass
class Settings:
    """Parameters with their bounds; unknown ones in a stored form are passed over, missing ones have defaults."""

    angle: float = 45.0
    min_faces: int = 2
    fit_tolerance: float = 0.0015
    feature: float = 0.04
    accuracy: float = 99.0

    LIMITS = {"angle": (1.0, 180.0), "min_faces": (1, 1_000_000), "fit_tolerance": (0.0, 1.0), "feature": (0.0, 1.0), "accuracy": (0.0, 100.0)}

    @classmethod
    def load(cls, stored: dict) -> Settings:
        known = {f.name: stored[f.name] for f in fields(cls) if f.name in stored}
        return cls(**{k: min(max(v, cls.LIMITS[k][0]), cls.LIMITS[k][1]) for k, v in known.items()})

    def store(self) -> dict:
        return asdict(self)
