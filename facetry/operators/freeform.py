"""Freeform surfaces: a moving least squares height field over a selection's plane, its grid, mesh, statistics and cubic net.

Points are searched through grid cells on the cluster. Grids are smoothed by tiles with the nodes around them, and control nets are
solved a row and then a column at a time, so neither is one group a mesh. A fitted grid has at most 321 x 321 nodes a mesh (MOST_CELLS).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, forget
from .fitting import basis, plane_fit
from .mesh import AXES

NEIGHBOURS, FEWEST, GAP = 24, 12, 3.0
LEAST_CELLS, MOST_CELLS = 16, 320


def defaults(extent: float) -> dict:
    """overshoot, extend, resolution and smoothness for a selection whose box has this longest side."""
    return {"overshoot": min(10.0, max(0.2, 0.03 * extent)), "extend": "slope", "resolution": 120, "smoothness": 2}


def nearest(queries: DataFrame, points: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """mesh_id, qid, d2, pid and the points' other columns but x, y: the k nearest points in the plane, exactly.

    queries(mesh_id, qid, x, y), points(mesh_id, pid, x, y, ..), sizes(mesh_id, size, most): cells to begin with, and a length
    that no distance passes. What lies within a cell's length is final; other queries go on with cells of twice the size. Of
    points at the same distance the least pid comes first. A mesh of fewer than k points gives all of them.
    """
    more = [c for c in points.columns if c not in ("mesh_id", "pid", "x", "y")]
    w = Window.partitionBy("mesh_id", "qid").orderBy("d2", "pid")
    left, done, scale = cut(queries.select("mesh_id", "qid", "x", "y").join(sizes, "mesh_id")), [], 1.0
    first = True
    while first or left.take(1):
        first = False
        size = F.col("size") * scale
        cell = lambda c: F.floor(F.col(c) / size).cast("long")
        around = left
        for a in "xy":
            around = around.withColumn(f"c{a}", F.explode(F.sequence(cell(a) - 1, cell(a) + 1)))
        around = around.select("mesh_id", "qid", "cx", "cy", F.col("x").alias("qx"), F.col("y").alias("qy"))
        held = points.join(sizes, "mesh_id").select("mesh_id", "pid", "x", "y", *more, cell("x").alias("cx"), cell("y").alias("cy"))
        d2 = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2
        near = around.join(held, ["mesh_id", "cx", "cy"]).select("mesh_id", "qid", d2.alias("d2"), "pid", *more)
        best = cut(near.withColumn("at", F.row_number().over(w)).where(f"at <= {k}"))
        enough = best.groupBy("mesh_id", "qid").agg(F.max(F.when(F.col("at") == k, F.col("d2"))).alias("far"))
        state = cut(left.join(enough, ["mesh_id", "qid"], "left").withColumn("final", F.coalesce(F.col("far") <= size * size, F.lit(False)) | (size >= F.col("most"))))
        done.append(best.join(state.where("final"), ["mesh_id", "qid"], "left_semi").drop("at"))
        left = state.where("NOT final").select("mesh_id", "qid", "x", "y", "size", "most")
        scale *= 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def flattened(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points in their plane's frame (mesh_id, pid, x, y, h), and the frames, a row a mesh of at least FEWEST points.

    A frame: origin px.., unit axes ux.., vx.., nx.., and n, low_x.. high_y, h_range, extent (the longer side in the plane).
    Points of no extent have no frame.
    """
    fit = plane_fit(points, ["mesh_id"]).where(F.col("n") >= FEWEST)
    u, v = basis([F.col(f"n{a}") for a in AXES])
    axes = [x.alias(f"{name}{a}") for name, vector in (("u", u), ("v", v)) for a, x in zip(AXES, vector, strict=True)]
    frame = cut(fit.select("mesh_id", "n", *[f"p{a}" for a in AXES], *[f"n{a}" for a in AXES], *axes))
    along = lambda name: sum(((F.col(a) - F.col(f"p{a}")) * F.col(f"{name}{a}") for a in AXES), F.lit(0.0))
    flat = cut(points.join(frame, "mesh_id").select("mesh_id", "pid", along("u").alias("x"), along("v").alias("y"), along("n").alias("h")))
    ends = [g(c).alias(f"{n}_{c}") for c in "xy" for n, g in (("low", F.min), ("high", F.max))]
    box = flat.groupBy("mesh_id").agg(*ends, F.greatest(F.max("h") - F.min("h"), F.lit(1e-9)).alias("h_range"))
    box = box.withColumn("extent", F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))).where("extent >= 1e-9")
    return flat, cut(frame.join(box, "mesh_id"))


def upper_median(rows: DataFrame, c: str) -> DataFrame:
    """mesh_id and the element at place n / 2 of a bounded sample."""
    s = F.sort_array(F.collect_list(c))
    return rows.groupBy("mesh_id").agg(s.alias("s")).select("mesh_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias(c))


def _sizes(frames: DataFrame, k: int) -> DataFrame:
    """Cells of about k points each to begin a search with."""
    return frames.select("mesh_id", (F.col("extent") * F.sqrt(F.lit(float(k)) / F.col("n"))).alias("size"), (F.col("extent") * 16).alias("most"))


def _sampled(flat: DataFrame, frames: DataFrame, about: int) -> DataFrame:
    step = F.greatest(F.lit(1), F.floor(F.col("n") / about)).cast("long")
    return flat.join(frames.select("mesh_id", "n"), "mesh_id").where(F.pmod(F.xxhash64("pid"), step) == 0).select("mesh_id", F.col("pid").alias("qid"), "x", "y")


def median_spacing(flat: DataFrame, frames: DataFrame, about: int = 1024) -> DataFrame:
    """mesh_id, spacing: the upper median, over about so many points, of the distance to the nearest point elsewhere in the plane."""
    places = flat.groupBy("mesh_id", "x", "y").agg(F.min("pid").alias("pid"))  # coincident points count once
    near = nearest(_sampled(flat, frames, about), places, _sizes(frames, 4), 2)
    apart = near.join(frames.select("mesh_id", (F.greatest(F.col("extent") * 1e-7, F.lit(1e-12)) ** 2).alias("eps")), "mesh_id").where("d2 > eps")
    one = apart.groupBy("mesh_id", "qid").agg(F.sqrt(F.min("d2")).alias("spacing"))
    return upper_median(one, "spacing").withColumn("spacing", F.greatest("spacing", F.lit(1e-9)))


def evaluate(d2: np.ndarray, dx: np.ndarray, dy: np.ndarray, h: np.ndarray, held: np.ndarray, curved: bool, h_range: np.ndarray, extent: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Heights at nodes from their neighbours (rows of equal length; held marks those that exist), by weighted least squares.

    Weights fall as a Gaussian of 0.65 times the farthest neighbour's distance. The linear fit's value is taken, or the
    quadratic one's if that is asked for, has eight neighbours, stays in the limit and bends away from the linear one by no more
    than the data's own curvature allows; the weighted mean where neither is within the limit.
    """
    d = np.sqrt(np.where(held, d2, 0.0))
    far, near = d.max(1), np.where(held, d, np.inf).min(1)
    sigma = np.maximum(0.65 * far, 1e-7)[:, None]
    w = np.where(held, np.exp(-np.where(held, d2, 0.0) / (2 * sigma**2)), 0.0)
    h = np.where(held, h, 0.0)
    mean = (w * h).sum(1) / np.maximum(w.sum(1), 1e-12)
    unit = np.maximum(far, 1e-12)[:, None]  # the value at the node does not depend on the unit, the condition does
    x, y = np.where(held, dx, 0.0) / unit, np.where(held, dy, 0.0) / unit

    def value(terms: list[np.ndarray]) -> np.ndarray:
        p = np.stack(terms, 2)
        a, b = np.einsum("nk,nki,nkj->nij", w, p, p), np.einsum("nk,nki,nk->ni", w, p, h)
        return (np.linalg.pinv(a, hermitian=True) @ b[:, :, None])[:, 0, 0]

    linear = value([np.ones_like(x), x, y])
    fine = np.abs(linear) <= limit
    out = np.where(fine, linear, np.clip(mean, -limit, limit))
    if curved:
        bent = value([np.ones_like(x), x, y, x * x, x * y, y * y])
        budget = 8 * h_range * (np.maximum(np.maximum(near, 0.35 * far), 1e-9) / extent) ** 2 + 0.01 * h_range + 1e-6
        out = np.where((held.sum(1) >= 8) & (np.abs(bent) <= limit) & (np.abs(bent - np.where(fine, linear, mean)) <= budget), bent, out)
    return out


def smoothed(heights: np.ndarray, valid: np.ndarray, passes: int) -> np.ndarray:
    """Each pass moves valid nodes half-way to the mean of their valid neighbours, all at once."""
    h = np.where(valid, heights, 0.0)
    m = np.pad(valid, 1).astype(float)
    count = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:]
    for _ in range(passes):
        p = np.pad(h, 1)
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / np.maximum(count, 1)
        h = np.where(valid & (count > 0), (h + mean) / 2, h)
    return np.where(valid, h, heights)


def grid(flat: DataFrame, frames: DataFrame, overshoot: float = 1.0, extend: str = "slope", resolution: int = 120, smoothness: int = 2, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (mesh_id, i, j, x, y, h, valid) and the frames with spacing, columns, rows, x0, y0, gw, gh.

    Nodes further from all points than the overshoot, or three spacings where that is more, are not valid; with `whole` all are.
    """
    over, res = max(0.0, float(overshoot)), max(LEAST_CELLS, min(MOST_CELLS, resolution))
    side = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}")
    cells = lambda c: F.greatest(F.lit(4), F.round(F.greatest(side(c) / F.col("extent"), F.lit(1e-3)) * res)).cast("int")
    frames = frames.join(median_spacing(flat, frames), "mesh_id").withColumns({"columns": cells("x"), "rows": cells("y"), "x0": F.col("low_x") - over, "y0": F.col("low_y") - over})
    frames = cut(frames.withColumns({"gw": (side("x") + 2 * over) / F.col("columns"), "gh": (side("y") + 2 * over) / F.col("rows")}))
    nodes = frames.select("*", F.explode(F.sequence(F.lit(0), "rows")).alias("j")).select("*", F.explode(F.sequence(F.lit(0), "columns")).alias("i"))
    nodes = nodes.select("mesh_id", "i", "j", (F.col("j") * (F.col("columns") + 1) + F.col("i")).cast("long").alias("qid"), (F.col("x0") + F.col("i") * F.col("gw")).alias("x"), (F.col("y0") + F.col("j") * F.col("gh")).alias("y"))
    nodes = cut(nodes)
    sizes = _sizes(frames, NEIGHBOURS).withColumn("most", F.col("most") + 4 * over)
    near = nearest(nodes, flat.select("mesh_id", "pid", "x", "y", F.col("x").alias("px"), F.col("y").alias("py"), "h"), sizes, NEIGHBOURS)
    lists = near.groupBy("mesh_id", "qid").agg(F.collect_list(F.struct("d2", "px", "py", "h")).alias("near"))
    about = frames.select("mesh_id", "h_range", "extent", F.greatest(F.col("spacing") * GAP, F.lit(over)).alias("reach"))
    rows = nodes.join(lists, ["mesh_id", "qid"]).join(about, "mesh_id")

    def fit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("near")
            n = column.value_lengths().to_numpy()
            held = np.arange(int(n.max()))[None, :] < n[:, None]
            inner = column.flatten()

            def field(name):
                out = np.zeros(held.shape)
                out[held] = inner.field(name).to_numpy()
                return out

            x, y, h_range, extent, reach = (b.column(c).to_numpy() for c in ("x", "y", "h_range", "extent", "reach"))
            d2 = field("d2")
            h = evaluate(d2, field("px") - x[:, None], field("py") - y[:, None], field("h"), held, extend == "curvature", h_range, extent, 2 * h_range + 2 * over + 1e-6)
            valid = np.ones(len(x), bool) if whole else np.where(held, d2, np.inf).min(1) <= reach**2
            yield pa.RecordBatch.from_arrays([b.column("mesh_id"), b.column("i"), b.column("j"), b.column("x"), b.column("y"), pa.array(h), pa.array(valid)], names=["mesh_id", "i", "j", "x", "y", "h", "valid"])

    form = "mesh_id string, i int, j int, x double, y double, h double, valid boolean"
    made = cut(rows.select("mesh_id", "i", "j", "x", "y", "near", "h_range", "extent", "reach").mapInArrow(fit, form))
    return (smoothed_nodes(made, smoothness) if smoothness else made), frames


def smoothed_nodes(nodes: DataFrame, passes: int, tile: int = 256, halo: int = 32) -> DataFrame:
    """nodes(mesh_id, i, j, h, valid; other columns stay) after so many passes of smoothed().

    A grid is cut into tiles, and a tile gets the nodes around it as well, as far as its passes reach: up to `halo` passes need one
    exchange, and no grid is one group. Invalid nodes, null ones among them, keep their h; a valid node with a null h counts as invalid. Of nodes
    at the same place one is used, and each keeps its row.
    """
    core = ["i", "j", "h", "valid"]

    def run(reach):
        def pass_over(key, rows: pd.DataFrame) -> pd.DataFrame:
            i, j = (rows[c].to_numpy(np.int64) for c in "ij")
            i0, j0 = i.min(), j.min()
            h, valid = np.zeros((j.max() - j0 + 1, i.max() - i0 + 1)), np.zeros((j.max() - j0 + 1, i.max() - i0 + 1), bool)
            h[j - j0, i - i0], valid[j - j0, i - i0] = rows["h"], rows["valid"]
            own = (i // tile == key[1]) & (j // tile == key[2])
            return pd.DataFrame({"mesh_id": key[0], "i": i[own], "j": j[own], "g": smoothed(h, valid, reach)[(j - j0)[own], (i - i0)[own]]})

        return pass_over

    form = f"mesh_id {nodes.schema['mesh_id'].dataType.simpleString()}, i long, j long, g double"
    one = nodes.where("valid AND h IS NOT NULL").select("mesh_id", *core).dropDuplicates(["mesh_id", "i", "j"])
    one = cut(one.select("mesh_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("h").cast("double").alias("h"), "valid"))
    while passes > 0:
        reach = min(passes, halo)
        ways = {f"t{c}": F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))) for c in "ij"}
        dealt = one.withColumn("ti", ways["ti"]).withColumn("tj", ways["tj"])
        done = cut(dealt.groupBy("mesh_id", "ti", "tj").applyInPandas(run(reach), form).select("mesh_id", "i", "j", F.col("g").alias("h"), F.lit(True).alias("valid")))
        forget(one)
        one, passes = done, passes - reach
    new = one.select("mesh_id", "i", "j", F.col("h").alias("g"))
    at = nodes.join(new, ["mesh_id", "i", "j"], "left")
    return at.select(*[F.when(F.col("valid"), F.coalesce("g", "h")).otherwise(F.col("h")).cast(nodes.schema["h"].dataType).alias("h") if c == "h" else F.col(c) for c in nodes.columns])


def corners(nodes: DataFrame) -> DataFrame:
    """mesh_id, i, j, h00, h10, h01, h11 of cells whose four corners are valid."""
    to = F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(f"h{a}{b}").alias("k")) for a in (0, 1) for b in (0, 1)]))
    one = nodes.where("valid").select("mesh_id", "h", to.alias("c")).select("mesh_id", "h", "c.*")
    return one.groupBy("mesh_id", "i", "j").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("k") == k, F.col("h"))).alias(k) for k in ("h00", "h10", "h01", "h11")]).where("n = 4").drop("n")


def tessellate(nodes: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of valid nodes and two faces for each cell of four, wound along the plane's normal. Ids are places in the grid."""
    axes = frames.select("mesh_id", "columns", *[f"{k}{a}" for k in "puvn" for a in AXES])
    at = nodes.where("valid").join(axes, "mesh_id")
    place = F.col("j").cast("long") * (F.col("columns") + 1) + F.col("i")
    v = at.select("mesh_id", place.alias("vid"), *[(F.col(f"p{a}") + F.col("x") * F.col(f"u{a}") + F.col("y") * F.col(f"v{a}") + F.col("h") * F.col(f"n{a}")).alias(a) for a in AXES])
    wide = F.col("columns") + 1
    a = F.col("a")
    faces = F.array(*[F.struct((2 * a + k).alias("fid"), a.alias("v0"), x.alias("v1"), y.alias("v2")) for k, (x, y) in enumerate([(a + 1, a + wide + 1), (a + wide + 1, a + wide)])])
    f = corners(nodes).join(frames.select("mesh_id", "columns"), "mesh_id").withColumn("a", place).select("mesh_id", F.explode(faces).alias("f")).select("mesh_id", "f.*")
    return v, f


def grid_deviation(flat: DataFrame, nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """mesh_id, rms, max_dev, points: all points against the grid, bilinear in their cell. Points over an invalid corner are left out."""
    p = flat.join(frames.select("mesh_id", "x0", "y0", "gw", "gh", "columns", "rows"), "mesh_id")
    p = p.withColumns({"fx": (F.col("x") - F.col("x0")) / F.col("gw"), "fy": (F.col("y") - F.col("y0")) / F.col("gh")})
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), F.col(n) - 1)).cast("int")
    p = p.withColumns({"i": clamp("fx", "columns"), "j": clamp("fy", "rows")})
    inside = lambda c, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) - F.col(k)))
    tx, ty = inside("fx", "i"), inside("fy", "j")
    low, high = (F.col(f"h0{k}") + tx * (F.col(f"h1{k}") - F.col(f"h0{k}")) for k in (0, 1))
    d = F.col("h") - (low + ty * (high - low))
    return p.join(corners(nodes), ["mesh_id", "i", "j"]).groupBy("mesh_id").agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_dev"), F.count(F.lit(1)).alias("points"))


def fold_ratio(flat: DataFrame, frames: DataFrame, about: int = 512) -> DataFrame:
    """mesh_id, fold: the median spread of heights near about so many points, over all heights' range; near 1 if the selection wraps around."""
    near = nearest(_sampled(flat, frames, about), flat, _sizes(frames, NEIGHBOURS), NEIGHBOURS).join(frames.select("mesh_id", "spacing", "h_range"), "mesh_id")
    close = near.where(F.sqrt("d2") <= 2.5 * F.col("spacing")).groupBy("mesh_id", "qid").agg((F.max("h") - F.min("h")).alias("spread"))
    return upper_median(close, "spread").join(frames.select("mesh_id", "h_range"), "mesh_id").select("mesh_id", F.least(F.lit(1.0), F.col("spread") / F.col("h_range")).alias("fold"))


def fit_freeform(points: DataFrame, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and statistics (mesh_id, rms, max_dev, points, fold) of points(mesh_id, pid, x, y, z); settings are grid()'s.

    Selections of fewer than twelve points, of no extent, or whose grid has no whole cell give no surface.
    """
    flat, frames = flattened(points)
    nodes, frames = grid(flat, frames, **settings)
    v, f = tessellate(nodes, frames)
    return v, f, grid_deviation(flat, nodes, frames).join(fold_ratio(flat, frames), "mesh_id")


def surface_deviation(found: DataFrame) -> DataFrame:
    """mesh_id, mean_dev, max_dev of closest()'s rows for a surface's vertices against the scan."""
    return found.groupBy("mesh_id").agg(F.avg("distance").alias("mean_dev"), F.max("distance").alias("max_dev"))


def knots(n: int, degree: int = 3) -> np.ndarray:
    """The clamped knots of n + 1 uniform parameters, inner ones averaged."""
    inner = np.convolve(np.arange(1, n) / n, np.ones(degree) / degree, "valid") if n > degree else []
    return np.concatenate([np.zeros(degree + 1), inner, np.ones(degree + 1)])


def basis_values(k: np.ndarray, at: np.ndarray, degree: int = 3) -> np.ndarray:
    """All basis functions at parameters from 0 to 1: a row a parameter."""
    at = np.clip(at, 0.0, 1.0)[:, None]
    last = np.searchsorted(k, k[-1]) - 1  # the last span that is not empty holds the end too
    out = ((at >= k[:-1]) & (at < k[1:])).astype(float)
    out[at[:, 0] >= k[-1], last] = 1.0
    for p in range(1, degree + 1):
        wide = k[p:] - k[:-p]
        part = np.where(wide > 0, 1 / np.where(wide > 0, wide, 1), 0.0)
        out = (at - k[: -p - 1]) * part[:-1] * out[:, :-1] + (k[p + 1 :] - at) * part[1:] * out[:, 1:]
    return out


def control_net(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bicubic net through points[row, column, axis] at uniform parameters, and its knots along columns and rows."""
    rows, columns = points.shape[0] - 1, points.shape[1] - 1
    if min(rows, columns) < 3:
        raise ValueError("a cubic net needs four nodes on each side")
    ku, kv = knots(columns), knots(rows)
    along_u = basis_values(ku, np.arange(columns + 1) / columns)
    along_v = basis_values(kv, np.arange(rows + 1) / rows)
    half = np.linalg.solve(along_u, points.transpose(1, 0, 2).reshape(columns + 1, -1)).reshape(columns + 1, rows + 1, 3)
    return np.linalg.solve(along_v, half.transpose(1, 0, 2).reshape(rows + 1, -1)).reshape(rows + 1, columns + 1, 3), ku, kv


def on_net(net: np.ndarray, ku: np.ndarray, kv: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Points of the surface at parameters u, v."""
    return np.einsum("ni,nj,jia->na", basis_values(ku, np.asarray(u, float)), basis_values(kv, np.asarray(v, float)), net)


def local_basis(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four cubic basis functions of knots(n) that are not 0 at each parameter: the first one's number, and their values."""
    k, at = knots(n), np.clip(np.asarray(at, float), 0.0, 1.0)
    span = np.clip(np.searchsorted(k, at, "right") - 1, 3, n)
    out = np.ones((len(at), 1))
    for p in range(1, 4):
        grown = np.zeros((len(at), p + 1))
        for m in range(p):
            low, high = k[span - p + 1 + m], k[span + 1 + m]
            part = out[:, m] / (high - low)
            grown[:, m] += (high - at) * part
            grown[:, m + 1] += (at - low) * part
        out = grown
    return span - 3, out


@lru_cache(maxsize=4)
def _eliminated(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The banded matrix of the basis at uniform parameters (row r: columns r - 3 to r + 3) as multipliers below and rows above; it needs no pivots."""
    first, values = local_basis(n, np.arange(n + 1) / n)
    band = np.zeros((n + 1, 7))
    for m in range(4):
        place = first + m - np.arange(n + 1) + 3
        held = (place >= 0) & (place < 7)
        band[np.flatnonzero(held), place[held]] += values[held, m]
    for r in range(n + 1):
        for d in range(1, min(3, n - r) + 1):
            by = band[r + d, 3 - d] / band[r, 3]
            band[r + d, 4 - d : 7 - d] -= by * band[r, 4:]
            band[r + d, 3 - d] = by
    return band[:, :3], band[:, 3:]


def along_line(points: np.ndarray) -> np.ndarray:
    """The control points of the cubic through points[node, axis] at uniform parameters, by a banded elimination."""
    n = len(points) - 1
    low, high = _eliminated(n)
    x = np.zeros((n + 7, points.shape[1]))
    x[3 : n + 4] = points
    for r in range(n + 1):
        x[r + 3] -= low[r] @ x[r : r + 3]
    for r in range(n, -1, -1):
        x[r + 3] = (x[r + 3] - high[r, 1:] @ x[r + 4 : r + 7]) / high[r, 0]
    return x[3 : n + 4]


def cubic_net(nodes: DataFrame) -> DataFrame:
    """mesh_id, i, j, x, y, z: the control points of each mesh's bicubic surface through nodes(mesh_id, i, j, x, y, z) at uniform parameters.

    Each row of nodes, then each column of what comes out, is a group of its own. A mesh has a net if its places are those of a whole
    rectangle from 0 on, each once, of four nodes or more on each side, and none of its coordinates is null.
    """
    n = nodes.select("mesh_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[F.col(a).cast("double").alias(a) for a in AXES])
    places = n.groupBy("mesh_id", "i", "j").agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest(*[F.col(a).isNull().cast("int") for a in AXES])).alias("gone"))
    good = places.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"), F.max("gone").alias("gone"), *[g(c).alias(f"{k}{c}") for c in "ij" for k, g in (("lo", F.min), ("hi", F.max))])
    good = good.where("c = 1 AND gone = 0 AND loi = 0 AND loj = 0 AND hii >= 3 AND hij >= 3 AND n = (hii + 1) * (hij + 1)").select("mesh_id")
    form = f"mesh_id {nodes.schema['mesh_id'].dataType.simpleString()}, i long, j long, x double, y double, z double"

    def solve(along):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(along)
            rows[list(AXES)] = along_line(rows[list(AXES)].to_numpy(float))
            return rows

        return run

    half = n.join(good, "mesh_id", "left_semi").groupBy("mesh_id", "j").applyInPandas(solve("i"), form)
    return cut(half.groupBy("mesh_id", "i").applyInPandas(solve("j"), form))


#: Control points along each side of a block in on_cubic_net(), and the places that a task takes at once: fuller blocks are dealt over several.
NET_BLOCK, NET_PLACES = 64, 1 << 16


def on_cubic_net(at: DataFrame, net: DataFrame, most: int = NET_PLACES) -> DataFrame:
    """at(mesh_id, pid, u, v) with x, y, z of the surface of cubic_net() there; parameters are moved into 0 to 1, those that are null or of a mesh without a net have no row.

    Places meet the blocks of control points that their sixteen begin in; blocks reach three further, so no place travels more than once.
    """
    size = net.groupBy("mesh_id").agg(F.max("i").alias("columns"), F.max("j").alias("rows"))
    kinds = {c: at.schema[c].dataType.simpleString() for c in ("mesh_id", "pid")}

    def located(batches):
        for rows in batches:
            for (columns, lines), some in rows.groupby(["columns", "rows"]):
                (i, _), (j, _) = local_basis(columns, some["u"]), local_basis(lines, some["v"])
                yield some.assign(bi=i // NET_BLOCK, bj=j // NET_BLOCK)

    p = at.where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)").select("mesh_id", "pid", "u", "v").join(F.broadcast(size), "mesh_id")
    p = cut(p.mapInPandas(located, f"mesh_id {kinds['mesh_id']}, pid {kinds['pid']}, u double, v double, columns long, rows long, bi long, bj long"))
    block = ["mesh_id", "bi", "bj"]
    full = F.broadcast(cut(p.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1")))
    p = p.join(full, block, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("pid", "u", "v"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    # a block's sixteens begin in it, and end up to three control points beyond
    n = net
    for c in "ij":
        n = n.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(F.floor((F.greatest(F.col(c), F.lit(3)) - 3) / NET_BLOCK), F.floor(F.col(c) / NET_BLOCK)))))
    n = n.join(full, block, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")

    def run(places: pa.Table, held: pa.Table) -> pa.Table:
        out = np.zeros((len(places), 3))
        if len(places):
            first = places.slice(0, 1).to_pylist()[0]
            (i, a), (j, b) = (local_basis(first[n], places.column(t).to_numpy()) for n, t in (("columns", "u"), ("rows", "v")))
            low = first["bi"] * NET_BLOCK, first["bj"] * NET_BLOCK
            points = np.full((NET_BLOCK + 3, NET_BLOCK + 3, 3), np.nan)
            points[held.column("i").to_numpy() - low[0], held.column("j").to_numpy() - low[1]] = np.stack([held.column(c).to_numpy() for c in AXES], 1)
            for k in range(4):
                for m in range(4):
                    out += (a[:, k] * b[:, m])[:, None] * points[i + k - low[0], j + m - low[1]]
        return pa.table({"mesh_id": places.column("mesh_id"), "pid": places.column("pid")} | {c: pa.array(out[:, k]) for k, c in enumerate(AXES)})

    by = [*block, "part"]
    return p.groupBy(*by).cogroup(n.groupBy(*by)).applyInArrow(run, f"mesh_id {kinds['mesh_id']}, pid {kinds['pid']}, x double, y double, z double")


def full_grid(points: DataFrame, mesh_id: str, **settings) -> np.ndarray:
    """The nodes [row, column, axis] of one mesh's whole rectangle, for control_net(): at most 321 x 321, on the driver."""
    flat, frames = flattened(points.where(F.col("mesh_id") == mesh_id))
    nodes, frames = grid(flat, frames, whole=True, **settings)
    rows = tessellate(nodes, frames)[0].orderBy("vid").toPandas()
    at = frames.first()
    return rows[["x", "y", "z"]].to_numpy().reshape(at["rows"] + 1, at["columns"] + 1, 3)


class RefitQueue:
    """Refits one at a time: a request that comes in while one runs replaces the one that waits."""

    def __init__(self, fit):
        self.fit, self.running, self.waiting, self.result = fit, False, None, None

    def ask(self, **settings):
        self.waiting = settings
        if self.running:
            return None
        self.running = True
        try:
            while self.waiting is not None:
                now, self.waiting = self.waiting, None
                self.result = self.fit(**now)
        finally:
            self.running = False
        return self.result
