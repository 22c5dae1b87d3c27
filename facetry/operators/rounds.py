"""Circles with recognised cylinder walls of one small set of points: a helper. moments.circles does groups of any size."""

from __future__ import annotations

import math

import numpy as np

#: Directions tried, and a share of the planar error that a cylinder must beat.
DIRECTIONS, GAIN = 256, 0.7


def frame(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    helper = np.array([1.0, 0, 0]) if abs(n[0]) < 0.9 else np.array([0, 1.0, 0])
    u = np.cross(n, helper)
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def algebraic_circle(p: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Centre and radius of least squares over x^2 + y^2, centred sums; None if the points lie on a line."""
    m = p.mean(axis=0)
    d = p - m
    s, q = d.T @ d, (d * d).sum(axis=1)
    if abs(np.linalg.det(s)) < 1e-14 * max(1.0, float(np.trace(s)) ** 2):
        return None
    c = np.linalg.solve(s, d.T @ q) / 2
    r2 = float(c @ c + q.mean())
    return (m + c, math.sqrt(r2)) if r2 > 1e-12 else None


def refined_circle(p: np.ndarray, centre: np.ndarray, radius: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton on the distances to the circle, as long as they shrink."""
    x, damp = np.append(centre, radius), 1e-3
    miss = lambda y: np.linalg.norm(p - y[:2], axis=1) - y[2]
    best = float((miss(x) ** 2).sum())
    for _ in range(steps):
        d = p - x[:2]
        far = np.maximum(np.linalg.norm(d, axis=1), 1e-12)
        j = np.column_stack([-d / far[:, None], -np.ones(len(p))])
        a = j.T @ j
        new = x - np.linalg.solve(a + damp * np.diag(np.diag(a)) + 1e-15 * np.eye(3), j.T @ miss(x))
        loss = float((miss(new) ** 2).sum())
        if loss >= best * (1 - 1e-12):
            damp *= 10
            if damp > 1e3:
                break
            continue
        x, best, damp = new, loss, damp / 3
    return x[:2], float(x[2])


def arc(p: np.ndarray, centre: np.ndarray) -> float:
    """Radians covered about the centre: a turn less the largest gap."""
    a = np.sort(np.arctan2(*(p - centre).T[::-1]))
    return 2 * math.pi - float(np.max(np.append(np.diff(a), a[0] + 2 * math.pi - a[-1])))


def across(points: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, float] | None:
    """Mean square, centre (3D, at the points' mean height) and radius of the circle that the points make seen along n."""
    u, w = frame(n)
    flat = np.column_stack([points @ u, points @ w])
    fit = algebraic_circle(flat)
    if fit is None:
        return None
    c, r = fit
    scale = float(np.linalg.norm(np.ptp(points, axis=0)))
    if r > 4 * scale or arc(flat, c) < math.radians(10):
        return None
    ms = float(((np.linalg.norm(flat - c, axis=1) - r) ** 2).mean())
    return ms, c[0] * u + c[1] * w + n * float((points @ n).mean()), r


def directions(k: int = DIRECTIONS) -> np.ndarray:
    """Even directions of a half sphere, by golden angles."""
    i = np.arange(k)
    z = 1 - (i + 0.5) / k
    a = i * math.pi * (3 - math.sqrt(5))
    s = np.sqrt(1 - z * z)
    return np.column_stack([s * np.cos(a), s * np.sin(a), z])


def axis_search(points: np.ndarray, plane_normal: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The direction along which the points make the best circle: the three best of a table, refined by turning them a little."""
    tried = [(f[0], tuple(n)) for n in [plane_normal, *directions()] if (f := across(points, np.asarray(n)))]
    best = None
    for ms, n in sorted(tried)[:3]:
        n, step = np.array(n), math.radians(5)
        while step > math.radians(0.002):
            u, w = frame(n)
            around = [n + math.tan(step) * (math.cos(t) * u + math.sin(t) * w) for t in np.linspace(0, 2 * math.pi, 8, endpoint=False)]
            found = [(f[0], tuple(m)) for m in (x / np.linalg.norm(x) for x in around) if (f := across(points, m))]
            if found and min(found)[0] < ms:
                ms, n = min(found)[0], np.array(min(found)[1])
            else:
                step /= 2
        if best is None or ms < best[1]:
            best = n, ms
    return best


def fit_circle(points: np.ndarray) -> dict | None:
    """centre, normal, radius, ms and is_cylinder; a cylinder is taken where it beats the planar circle clearly. None for under three points."""
    if len(points) < 3:
        return None
    m = points.mean(axis=0)
    normal = np.linalg.eigh((points - m).T @ (points - m))[1][:, 0]
    planar = across(points, normal)
    height = (points - m) @ normal
    planar_ms = planar[0] + float((height * height).mean()) if planar else math.inf
    found = axis_search(points, normal)
    scale = float(np.linalg.norm(np.ptp(points, axis=0)))
    tube = found is not None and found[1] <= GAIN * planar_ms and planar_ms - found[1] >= (1e-4 * scale) ** 2
    if not tube and planar is None:
        return None
    n = found[0] if tube else normal
    u, w = frame(n)
    flat = np.column_stack([points @ u, points @ w])
    c, r = refined_circle(flat, *algebraic_circle(flat))
    miss = np.linalg.norm(flat - c, axis=1) - r
    return {"center": c[0] * u + c[1] * w + n * float((points @ n).mean()), "normal": n, "radius": r, "ms": float((miss * miss).mean()) + (0.0 if tube else float((height * height).mean())), "is_cylinder": bool(tube)}
