"""Bridges between two selected patches: rims, chains, the pair that is nearest, and a surface between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .mesh import AXES
from .spatial import _cell, point_cells
from .topology import components, half_edges

KEY = ["mesh_id", "fid"]


def rims(f: DataFrame, adj: DataFrame, geometry: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed rim edges (mesh_id, cluster, u, v) of clusters(mesh_id, fid, cluster), and cluster rows (open, faces, mx.., nx..).

    A cluster's open edges, or those to faces outside of it where it has none; mean of the centroids, and unit mean normal.
    """
    other = clusters.select("mesh_id", F.col("fid").alias("nb"), F.col("cluster").alias("theirs"))
    sides = adj.join(clusters, KEY).join(other, ["mesh_id", "nb"], "left").where("theirs IS NULL OR theirs != cluster")
    edges = half_edges(f).select(*KEY, "k", "u", "v").join(sides.select(*KEY, "k", "cluster", F.col("nb").isNull().alias("open")), [*KEY, "k"])
    edges = cut(edges.select("mesh_id", "cluster", "u", "v", "open"))
    has = edges.groupBy("mesh_id", "cluster").agg(F.bool_or("open").alias("has"))
    rim = edges.join(has, ["mesh_id", "cluster"]).where("open = has").select("mesh_id", "cluster", "u", "v")
    g = geometry.join(clusters, KEY).groupBy("mesh_id", "cluster")
    g = g.agg(F.count(F.lit(1)).alias("faces"), *[F.avg(f"m{a}").alias(f"m{a}") for a in AXES], *[F.sum(f"n{a}").alias(f"s{a}") for a in AXES])
    size = F.sqrt(sum((F.col(f"s{a}") ** 2 for a in AXES), F.lit(0.0)))
    normals = [F.when(size > 0, F.col(f"s{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES]
    rows = g.select("mesh_id", "cluster", "faces", *[f"m{a}" for a in AXES], *normals).join(has.withColumnRenamed("has", "open"), ["mesh_id", "cluster"], "left")
    return rim, rows


def trails(u: list[int], v: list[int]) -> list[tuple[list[int], bool]]:
    """Directed edges as paths (vertices, closed): from vertices that no edge enters first, then the cycles left, smaller ids first."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(set(zip(u, v, strict=True)), reverse=True):
        after.setdefault(a, []).append(b)
    starts = [a for a in sorted(after) if a not in set(v)]
    out = []
    for start in starts + sorted(after):
        while after[start]:
            path = [start]
            while after.get(path[-1]) and (len(path) == 1 or path[-1] != start):
                path.append(after[path[-1]].pop())
            closed = len(path) > 3 and path[-1] == start
            out.append((path[:-1] if closed else path, closed))
    return out


def chains(rim: DataFrame) -> DataFrame:
    """mesh_id, cluster, root, part, closed, vertices: the rims' paths. What hangs together of one rim is walked in one task."""
    # the clusters of a mesh do not hang together here, even where they share a vertex
    name = F.to_json(F.struct("mesh_id", "cluster"))
    e = cut(rim.withColumn("name", name))
    nodes = e.select(F.col("name").alias("mesh_id"), F.explode(F.array("u", "v")).alias("fid")).distinct()
    c = components(nodes, e.select(F.col("name").alias("mesh_id"), F.col("u").alias("fid"), F.col("v").alias("nb")))
    rooted = e.join(c.select(F.col("mesh_id").alias("name"), F.col("fid").alias("u"), "root"), ["name", "u"])

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = trails(rows["u"].tolist(), rows["v"].tolist())
        data = {"mesh_id": key[0], "cluster": key[1], "root": key[2], "part": range(len(found)), "closed": [x for _, x in found], "vertices": [p for p, _ in found]}
        return pd.DataFrame(data, columns=list(data))

    kind = rim.schema["cluster"].dataType.simpleString()
    return cut(rooted.groupBy("mesh_id", "cluster", "root").applyInPandas(walk, f"mesh_id string, cluster {kind}, root long, part int, closed boolean, vertices array<long>"))


def two_clusters(clusters: DataFrame) -> None:
    """An error with the number of clusters for the first mesh that has not two."""
    wrong = clusters.groupBy("mesh_id").agg(F.count_distinct("cluster").alias("n")).where("n != 2").orderBy("mesh_id").first()
    if wrong:
        raise ValueError(f"a bridge needs two selected patches, mesh {wrong['mesh_id']} has {wrong['n']}")


def nearest_chains(v: DataFrame, paths: DataFrame, cell: float) -> DataFrame:
    """A row a mesh: distance, and a and b, the (root, part) of the paths of cluster 0 and of cluster 1 whose vertices come nearest.

    Vertices meet in grid cells; a mesh whose patches are not found within a cell's length goes on with cells of twice the size.
    """
    one = paths.where(F.size("vertices") > 1).select("mesh_id", "cluster", "root", "part", F.explode("vertices").alias("vid"))
    at = cut(one.join(v.select("mesh_id", "vid", *[F.col(a).cast("double").alias(a) for a in AXES]), ["mesh_id", "vid"]))
    left, done = cut(at.groupBy("mesh_id").agg(F.count_distinct("cluster").alias("n")).where("n = 2").select("mesh_id")), []
    while left.take(1):
        mine = at.join(left, "mesh_id", "left_semi")
        a = point_cells(mine.where("cluster = 0"), cell).select("mesh_id", "cx", "cy", "cz", F.struct("root", "part").alias("a"), *[F.col(c).alias(f"a{c}") for c in AXES])
        b = mine.where("cluster = 1").select("mesh_id", *[_cell(F.col(c), cell).alias(f"c{c}") for c in AXES], F.struct("root", "part").alias("b"), *AXES)
        d = F.sqrt(sum(((F.col(c) - F.col(f"a{c}")) ** 2 for c in AXES), F.lit(0.0)))
        best = cut(a.join(b, ["mesh_id", "cx", "cy", "cz"]).groupBy("mesh_id").agg(F.min(F.struct(d.alias("distance"), "a", "b")).alias("m")).select("mesh_id", "m.*").where(F.col("distance") <= cell))
        done.append(best)
        left = cut(left.join(best, "mesh_id", "left_anti"))
        cell *= 2
    if not done:
        return left.select("mesh_id", F.lit(None).cast("double").alias("distance"), *[F.lit(None).cast("struct<root:bigint,part:int>").alias(c) for c in "ab"])
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def arc(points: np.ndarray) -> np.ndarray:
    """The share of the path's length up to each point; even shares where it has no length."""
    s = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))])
    return s / s[-1] if s[-1] > 1e-12 else np.linspace(0, 1, len(points))


def _unit(a: np.ndarray, least: float = 1e-12) -> np.ndarray:
    size = np.linalg.norm(a, axis=-1, keepdims=True)
    return np.where(size > least, a / np.maximum(size, least), 0.0)


def along(points: np.ndarray, normals: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and unit normals at shares of a path's length."""
    s = arc(points)
    pick = lambda values: np.stack([np.interp(at, s, values[:, k]) for k in range(3)], 1)
    return pick(points), _unit(pick(normals))


def span(pa_: np.ndarray, na: np.ndarray, pb: np.ndarray, nb: np.ndarray, method: str, segments: int, tension: float, bulge: float) -> np.ndarray:
    """Points [row, column, axis] from path a to path b."""
    s = np.linspace(0, 1, segments + 1)[:, None, None]
    chord = pb - pa_
    length = np.linalg.norm(chord, axis=1, keepdims=True)
    if method == "hermite":

        def tangent(n):
            flat = chord - n * (chord * n).sum(1, keepdims=True)
            return np.where((flat**2).sum(1, keepdims=True) > 1e-8, _unit(flat) * length, chord) * tension

        ease = s * s * (3 - 2 * s)
        out = pa_ * (1 - ease) + pb * ease + s * (1 - s) * ((1 - s) * tangent(na) - s * tangent(nb))
    elif method in ("linear", "arc"):
        out = pa_ + s * chord
    else:
        raise ValueError(f"no way to bridge is called {method}")
    if method != "linear" and abs(bulge) > 1e-3:
        out = out + _unit(na + s * (nb - na)) * (4 * s * (1 - s) * bulge * length / 2)
    return out


def fair(grid: np.ndarray, times: int) -> np.ndarray:
    """Inner points go 45 % of the way to the mean of their four neighbours, all at once, so many times."""
    if grid.shape[0] < 4 or grid.shape[1] < 3:
        return grid
    grid = grid.copy()
    for _ in range(times):
        mean = (grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:]) / 4
        grid[1:-1, 1:-1] += 0.45 * (mean - grid[1:-1, 1:-1])
    return grid


def stitch(points: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Faces between two paths of point numbers, each time over the shorter diagonal; slivers are left out. They run against a's direction."""
    out, i, j = [], 0, 0
    while i + 1 < len(a) or j + 1 < len(b):
        far = len(b) == j + 1 or (i + 1 < len(a) and np.linalg.norm(points[a[i + 1]] - points[b[j]]) <= np.linalg.norm(points[a[i]] - points[b[j + 1]]))
        face = (a[i + 1], a[i], b[j]) if far else (a[i], b[j], b[j + 1])
        i, j = i + far, j + (not far)
        n = np.cross(points[face[1]] - points[face[0]], points[face[2]] - points[face[0]])
        if n @ n > 1e-12:
            out.append(face)
    return out


def bridge_patch(
    a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, method: str = "hermite", segments: int = 8, tension: float = 1.0, bulge: float = 0.0,
    flip_twist: bool = False, flip_normals: bool = False, fairing: int = 5,
) -> tuple[np.ndarray, list[tuple[int, int, int]], bool]:
    """Points (a's, b's, then new ones), faces, and whether b was turned about, for a bridge from path a to path b.

    b is turned where its ends lie nearer to a's ends so (the other way with flip_twist). Rows of as many points as the longer
    path has lie between, 1 to 60 segments; the first and last are stitched to the paths themselves.
    """
    if len(a) < 2 or len(b) < 2:
        raise ValueError("a bridge needs two vertices on each side")
    straight, crossed = (np.linalg.norm(a[0] - b[x]) + np.linalg.norm(a[-1] - b[-1 - x]) for x in (0, -1))
    turned = bool(crossed < straight) != flip_twist
    pb, qb = (b[::-1], nb[::-1]) if turned else (b, nb)
    segments, width = max(1, min(60, segments)), max(len(a), len(b))
    share = np.linspace(0, 1, width)
    grid = fair(span(*along(a, na, share), *along(pb, qb, share), method, segments, tension, bulge), fairing)
    inner = grid[1:-1].reshape(-1, 3)
    points = np.concatenate([a, b, inner])
    first = list(range(len(a)))
    last = list(range(len(a), len(a) + len(b)))
    last = last[::-1] if turned else last
    rows = [first, *[[len(a) + len(b) + k * width + w for w in range(width)] for k in range(segments - 1)], last]
    faces = [t for x, y in zip(rows, rows[1:], strict=False) for t in stitch(points, x, y)]
    return points, [(x, z, y) for x, y, z in faces] if flip_normals else faces, turned


def bridges(v: DataFrame, f: DataFrame, adj: DataFrame, geometry: DataFrame, normals: DataFrame, clusters: DataFrame, cell: float, **settings) -> tuple[DataFrame, DataFrame]:
    """New vertices and faces, with ids behind the mesh's, for a bridge between each mesh's two clusters (0 and 1); see bridge_patch().

    normals(mesh_id, vid, nx, ny, nz) of the vertices. Meshes whose clusters have no rim give nothing. holes.filled() adds the patch.
    """
    clusters = cut(clusters)
    two_clusters(clusters)
    rim, _ = rims(f, adj, geometry, clusters)
    paths = chains(rim)
    pair = nearest_chains(v, paths, cell)
    chosen = [paths.where(F.col("cluster") == k).join(pair.select("mesh_id", f"{s}.root", f"{s}.part"), ["mesh_id", "root", "part"], "left_semi") for k, s in enumerate("ab")]
    at = v.select("mesh_id", "vid", *[F.col(a).cast("double").alias(a) for a in AXES]).join(normals.select("mesh_id", "vid", "nx", "ny", "nz"), ["mesh_id", "vid"], "left")
    one = chosen[0].union(chosen[1]).select("mesh_id", "cluster", F.posexplode("vertices").alias("at", "vid")).join(at, ["mesh_id", "vid"])
    given = F.array(*[F.coalesce(f"n{a}", F.lit(0.0)) for a in AXES])
    vertex = F.struct("at", "vid", F.array(*AXES).alias("p"), given.alias("n"))
    sides = one.groupBy("mesh_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("cluster") == k, vertex))).alias(s) for k, s in enumerate("ab")])
    first = v.groupBy("mesh_id").agg((F.max("vid") + 1).alias("vid")).join(f.groupBy("mesh_id").agg((F.max("fid") + 1).alias("fid")), "mesh_id")
    schema = pa.schema([("mesh_id", pa.string()), ("vid", pa.int64()), ("fid", pa.int64()), ("points", pa.list_(pa.list_(pa.float64()))), ("faces", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = r["a"], r["b"]
                if len(a) < 2 or len(b) < 2:
                    continue
                points, faces, _ = bridge_patch(*[np.array([x[k] for x in side]) for side in (a, b) for k in ("p", "n")], **settings)
                names = np.array([x["vid"] for x in a + b] + list(range(r["vid"], r["vid"] + len(points) - len(a) - len(b))), dtype=np.int64)
                out.append({"mesh_id": r["mesh_id"], "vid": r["vid"], "fid": r["fid"], "points": points[len(a) + len(b) :].tolist(), "faces": names[np.array(faces, dtype=np.int64).reshape(-1, 3)].tolist()})
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    made = cut(sides.join(first, "mesh_id").mapInArrow(run, "mesh_id string, vid long, fid long, points array<array<double>>, faces array<array<long>>"))
    points = made.select("mesh_id", "vid", F.posexplode("points").alias("k", "p")).select("mesh_id", (F.col("vid") + F.col("k")).alias("vid"), *[F.col("p")[i].alias(a) for i, a in enumerate(AXES)])
    faces = made.select("mesh_id", "fid", F.posexplode("faces").alias("k", "t")).select("mesh_id", (F.col("fid") + F.col("k")).alias("fid"), *[F.col("t")[i].alias(f"v{i}") for i in range(3)])
    return points, faces
