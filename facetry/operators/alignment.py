"""Datum alignment, and the parameters of a plane. Few features are worked on by the driver; meshes are not."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from . import mesh

AXIS = {"x": np.array([1.0, 0, 0]), "y": np.array([0, 1.0, 0]), "z": np.array([0, 0, 1.0])}


def turn_between(a, b) -> np.ndarray:
    """The unit quaternion (x, y, z, w) of the least rotation that takes direction a to b; half a turn about any normal if they are opposite."""
    a, b = (np.asarray(v, float) / np.linalg.norm(v) for v in (a, b))
    w = 1 + float(a @ b)
    if w < 1e-9:
        axis = np.cross(a, AXIS["x"] if abs(a[0]) < 0.9 else AXIS["y"])
        return np.append(axis / np.linalg.norm(axis), 0.0)
    q = np.append(np.cross(a, b), w)
    return q / np.linalg.norm(q)


def times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The rotation q, then p."""
    v = p[3] * q[:3] + q[3] * p[:3] + np.cross(p[:3], q[:3])
    return np.append(v, p[3] * q[3] - p[:3] @ q[:3])


def rotate(q: np.ndarray, v) -> np.ndarray:
    return np.asarray(mesh.rotation(tuple(q))) @ np.asarray(v, float)


def align(slots: dict[str, dict], origin: dict | None = None, centre=(0.0, 0.0, 0.0), primary: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Quaternion, translation and residual (degrees) of a 3-2-1 alignment.

    slots: axis -> feature (point, normal). The primary one's normal is turned onto its axis (either way, whichever is nearer),
    the next about it; what is left of the others' angles is the residual. The origin is a feature's point, or per axis the
    point of its own feature, and the centre for axes without one.
    """
    order = sorted(slots, key=lambda a: (a != primary, a))
    q, worst = np.array([0.0, 0, 0, 1.0]), 0.0
    for k, a in enumerate(order):
        n = rotate(q, slots[a]["normal"])
        n = n if n @ AXIS[a] >= 0 else -n
        if k == 0:
            q = times(turn_between(n, AXIS[a]), q)
            continue
        if k == 1:
            first = AXIS[order[0]]
            flat = n - first * float(n @ first)
            if np.linalg.norm(flat) > 1e-9:
                flat /= np.linalg.norm(flat)
                angle = math.atan2(float(np.cross(flat, AXIS[a]) @ first), float(flat @ AXIS[a]))
                q = times(np.append(first * math.sin(angle / 2), math.cos(angle / 2)), q)
                n = rotate(q, slots[a]["normal"])
        worst = max(worst, math.degrees(math.acos(min(1.0, abs(float(n @ AXIS[a]) / float(np.linalg.norm(n)))))))
    if origin is not None:
        return q, -rotate(q, origin["point"]), worst
    at = rotate(q, centre)
    for a, f in slots.items():
        k = "xyz".index(a)
        at[k] = rotate(q, f["point"])[k]
    return q, -at, worst


def auto_slots(features: list[dict]) -> tuple[dict[str, dict], dict | None]:
    """A symmetry plane goes to X, a circle to Z and the origin, a plane to Y (X if that is free and Y is not)."""
    slots: dict[str, dict] = {}
    origin = None
    for f in features:
        if f["kind"] == "symmetry":
            slots.setdefault("x", f)
        elif f["kind"] in ("circle", "cylinder"):
            if "z" not in slots:
                slots["z"], origin = f, f
        elif f["kind"] == "plane":
            slots.setdefault("y" if "y" not in slots else "x", f)
    return slots, origin


def without(slots: dict[str, dict], origin: dict | None, feature_id) -> tuple[dict[str, dict], dict | None]:
    """Slots and origin after a feature is deleted."""
    return {a: f for a, f in slots.items() if f.get("feature_id") != feature_id}, None if origin and origin.get("feature_id") == feature_id else origin


def apply(q, t, vertices: list[DataFrame], features: list[dict]) -> tuple[list[DataFrame], list[dict]]:
    """All vertex tables and features (point, normal) moved alike."""
    moved = [f | {"point": tuple((rotate(q, f["point"]) + t).tolist()), "normal": tuple(rotate(q, f["normal"]).tolist())} for f in features]
    return [mesh.transform(v, tuple(q), tuple(t)) for v in vertices], moved


def moved_box(low, high, q, t) -> tuple[np.ndarray, np.ndarray]:
    """The box of a box's eight moved corners."""
    corners = np.array([[(low, high)[(k >> i) & 1][i] for i in range(3)] for k in range(8)])
    p = corners @ np.asarray(mesh.rotation(tuple(q))).T + np.asarray(t)
    return p.min(axis=0), p.max(axis=0)


def centred_on(axes: str, low, high) -> np.ndarray:
    """The translation that puts a box's middle at 0 on the chosen axes."""
    return np.array([-(a + b) / 2 if c in axes else 0.0 for c, a, b in zip("xyz", low, high, strict=True)])


# mirror planes: point, unit normal


def to_parameters(normal, offset: float) -> tuple[float, float, float]:
    """Elevation from the XZ plane, azimuth (0 near the poles) and offset along the normal."""
    n = np.asarray(normal, float)
    elevation = math.asin(max(-1.0, min(1.0, float(n[1]))))
    return elevation, 0.0 if abs(elevation) > 1.56 else math.atan2(float(n[2]), float(n[0])), offset


def from_parameters(elevation: float, azimuth: float, offset: float) -> tuple[np.ndarray, float]:
    c = math.cos(elevation)
    return np.array([c * math.cos(azimuth), math.sin(elevation), c * math.sin(azimuth)]), offset
