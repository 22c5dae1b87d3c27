"""Health report and repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .loops import ordered_loops
from .mesh import compact, corners_of, cross
from .topology import KEY, _least, components, edge_pairs, face_components, half_edges

#: Square of a face's cross product below which it is degenerate.
FLAT = 1e-14
#: Corners of a vertex that may meet in one row.
HUB = 1024


def index_degenerate():
    return (F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v2") == F.col("v0"))


def degenerate_faces(v: DataFrame, f: DataFrame) -> DataFrame:
    """Faces with a repeated index or next to no area."""
    square = sum((c.cast("double") * c for c in cross()), F.lit(0.0))
    return corners_of(v, f).where(index_degenerate() | (square < FLAT)).select(*KEY)


def remove_degenerate(v: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    return compact(v, cut(f.join(degenerate_faces(v, f), KEY, "left_anti")))


def duplicate_faces(f: DataFrame) -> DataFrame:
    """Per mesh: faces beyond the first of each vertex set, without index-degenerate ones."""
    sets = f.where(~index_degenerate()).groupBy("mesh_id", F.array_sort(F.array("v0", "v1", "v2")).alias("set")).agg(F.count(F.lit(1)).alias("n"))
    return sets.groupBy("mesh_id").agg(F.sum(F.col("n") - 1).alias("duplicate_faces"))


def edge_report(f: DataFrame) -> DataFrame:
    e = half_edges(f).groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("u") == F.col("lo")).cast("int")).alias("up"))
    return e.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"), F.count_if((F.col("n") == 2) & (F.col("up") != 1)).alias("inconsistent_normals")
    )


def _corners(f: DataFrame) -> DataFrame:
    """mesh_id, vid, fid and the face's other two vertices, for each corner."""
    return f.select("mesh_id", "fid", F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), F.col(f"v{(k + 1) % 3}").alias("o1"), F.col(f"v{(k + 2) % 3}").alias("o2")) for k in range(3)])).alias("c")).select("mesh_id", "c.vid", "fid", "c.o1", "c.o2")


def _fans_of_rows(batches):
    """fans and degree of vertices with their corners, many at once: faces and other vertices are nodes, each corner two links."""
    for batch in batches:
        at = batch.column("at")
        corner = at.flatten()
        row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
        fid, o1, o2 = (corner.field(k).to_numpy() for k in range(3))
        names, code = np.unique(np.concatenate([fid, o1, o2]), return_inverse=True)
        kind = np.repeat([0, 1, 1], len(fid))
        nodes, node = np.unique((np.tile(row, 3) * 2 + kind) * len(names) + code, return_inverse=True)
        face, first, second = node.reshape(3, -1)
        top = _least(np.concatenate([face, face]), np.concatenate([first, second]), len(nodes))
        owner = nodes // len(names) // 2
        fans = np.bincount(owner[top == np.arange(len(nodes))], minlength=len(at))
        degree = np.bincount(owner[(nodes // len(names)) % 2 == 0], minlength=len(at))
        yield pa.RecordBatch.from_pydict({"mesh_id": batch.column("mesh_id"), "vid": batch.column("vid"), "fans": pa.array(fans, pa.int64()), "degree": pa.array(degree, pa.int64())})


def fans(f: DataFrame, hub: int = HUB) -> DataFrame:
    """mesh_id, vid, fans: groups of incident faces that share an edge at the vertex; only vertices of two faces or more.

    The corners of a vertex meet in its row, and many rows are solved at once. Vertices of more than `hub` corners are
    spread instead: faces around them are linked when both have the same opposite vertex, and components over (vertex, face) nodes count their fans.
    """
    corners = _corners(f)
    hubs = cut(corners.groupBy("mesh_id", "vid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("mesh_id", "vid"))
    large = not hubs.isEmpty()
    few = corners.join(F.broadcast(hubs), ["mesh_id", "vid"], "left_anti") if large else corners
    kinds = {x.name: x.dataType.simpleString() for x in corners.schema}
    rows = few.groupBy("mesh_id", "vid").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("fid", "o1", "o2")])).alias("at"))
    per = rows.mapInArrow(_fans_of_rows, f"mesh_id {kinds['mesh_id']}, vid {kinds['vid']}, fans long, degree long")
    if large:
        per = per.union(_spread_fans(f, corners.join(F.broadcast(hubs), ["mesh_id", "vid"], "left_semi")))
    return per.where("degree > 1").select("mesh_id", "vid", "fans")


def _spread_fans(f: DataFrame, corners: DataFrame) -> DataFrame:
    """mesh_id, vid, fans and degree by components over links."""
    spokes = corners.select("mesh_id", "fid", "vid", F.explode(F.array("o1", "o2")).alias("o"))
    first = spokes.groupBy("mesh_id", "vid", "o").agg(F.min("fid").alias("low"))
    # the node of a face at a vertex: its corner number, which no other face or vertex has
    number = f.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).groupBy("mesh_id", "fid", "vid").agg((F.min("fid") * 3 + F.min("k")).alias("node")).join(corners.select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_semi")
    at = lambda name, face: number.select("mesh_id", F.col("fid").alias(face), "vid", F.col("node").alias(name))
    links = spokes.join(first, ["mesh_id", "vid", "o"]).where("fid != low").join(at("a", "fid"), ["mesh_id", "fid", "vid"]).join(at("b", "low"), ["mesh_id", "low", "vid"])
    c = components(number.select("mesh_id", F.col("node").alias("fid")), links.select("mesh_id", F.col("a").alias("fid"), F.col("b").alias("nb")), within=True)
    return number.join(c.select("mesh_id", F.col("fid").alias("node"), "root"), ["mesh_id", "node"]).groupBy("mesh_id", "vid").agg(F.count_distinct("root").alias("fans"), F.count(F.lit(1)).alias("degree"))


def report(v: DataFrame, f: DataFrame, loops: bool = True) -> DataFrame:
    """A row per mesh; loops=False leaves out what needs rounds (components, holes, fans, and with them watertight and genus)."""
    ones = f.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces"))
    used = f.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    nu = used.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices_used"))
    lone = v.join(used, ["mesh_id", "vid"], "left_anti").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("isolated_verts"))
    bad = degenerate_faces(v, f).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("degenerate_faces"))
    out = ones.join(nu, "mesh_id").join(edge_report(f), "mesh_id").join(lone, "mesh_id", "left").join(bad, "mesh_id", "left").join(duplicate_faces(f), "mesh_id", "left")
    out = out.fillna(0, ["isolated_verts", "degenerate_faces", "duplicate_faces"]).withColumn("euler_characteristic", F.col("vertices_used") - F.col("edges") + F.col("faces"))
    if not loops:
        return out
    parts = face_components(f).groupBy("mesh_id").agg(F.count_distinct("root").alias("component_count"))
    holes = ordered_loops(f).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("hole_count"))
    split = fans(f).where("fans > 1").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("non_manifold_verts"))
    out = out.join(parts, "mesh_id", "left").join(holes, "mesh_id", "left").join(split, "mesh_id", "left").fillna(0, ["component_count", "hole_count", "non_manifold_verts"])
    tight = (F.col("boundary_edges") == 0) & (F.col("non_manifold_edges") == 0) & (F.col("non_manifold_verts") == 0) & (F.col("component_count") == 1)
    return out.withColumn("is_watertight", tight).withColumn("genus", F.when(tight, F.floor((2 - F.col("euler_characteristic")) / 2)).otherwise(0))


def remove_small_components(v: DataFrame, f: DataFrame, ratio: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Components of at least max(2, ceil(faces * ratio)) faces, or the largest alone if none is."""
    return compact(v, _large(f, face_components(f), ratio))


def _large(f: DataFrame, c: DataFrame, ratio: float) -> DataFrame:
    """The faces that remove_small_components() keeps, by the roots of their components, c."""
    c = cut(c)
    size = c.groupBy("mesh_id", "root").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("mesh_id")
    top = F.max(F.struct("n", -F.col("root"))).over(w)
    least = F.greatest(F.lit(2), F.ceil(F.sum("n").over(w) * ratio))
    keep = size.select("mesh_id", "root", "n", least.alias("least"), F.max("n").over(w).alias("most"), (top == F.struct("n", -F.col("root"))).alias("largest")).where("CASE WHEN most >= least THEN n >= least ELSE largest END")
    return f.join(c.join(keep, ["mesh_id", "root"], "left_semi"), KEY, "left_semi")


def _det():
    """Six times the volume under a face of corners_of()."""
    return sum((F.col(f"{a}0") * (F.col(f"{b}1") * F.col(f"{d}2") - F.col(f"{d}1") * F.col(f"{b}2")) for a, b, d in ("xyz", "yzx", "zxy")), F.lit(0.0))


def unify_normals(v: DataFrame, f: DataFrame) -> DataFrame:
    """Faces turned to agree across shared edges, and each component outwards by the sign of its volume.

    Parity by a double cover: every face is two nodes, as it is and flipped; an edge that both faces run alike links one's
    node with the other's flipped one. The component that holds a face's seed, as it is, tells how others turn.
    """
    return _unified(f.join(corners_of(v, f).select(*KEY, _det().alias("det"), F.lit(True).alias("seen")), KEY, "left"), edge_pairs(f))


def _unified(f: DataFrame, pairs: DataFrame) -> DataFrame:
    """unify_normals() of f (with det, and seen where a face has a corner) by its edge_pairs()."""
    alike = F.col("alike").cast("long")
    links = pairs.select("mesh_id", F.explode(F.array(*[F.struct((2 * F.col("fid") + s).alias("fid"), (2 * F.col("other") + (alike + s) % 2).alias("nb")) for s in (0, 1)])).alias("l")).select("mesh_id", "l.*")
    nodes = f.select("mesh_id", F.explode(F.array(2 * F.col("fid"), 2 * F.col("fid") + 1)).alias("fid"))
    c = components(nodes, links, within=True)
    # the sheet of the component's least face as it is has an even root; a face of the other sheet turns, and the roots of both differ by one
    mine = c.where("fid % 2 = 0").select("mesh_id", F.floor(F.col("fid") / 2).cast("long").alias("fid"), F.pmod("root", F.lit(2)).alias("turn"), (F.col("root") - F.pmod("root", F.lit(2))).alias("root"))
    held = cut(f.join(mine, KEY))
    volume = held.where("seen").groupBy("mesh_id", "root").agg(F.sum(F.when(F.col("turn") == 1, -F.col("det")).otherwise(F.col("det"))).alias("volume"))
    turned = held.join(volume, ["mesh_id", "root"]).withColumn("swap", (F.col("turn") == 1) != (F.col("volume") < -1e-7))
    return turned.select("mesh_id", "fid", "v0", F.when(F.col("swap"), F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(F.col("swap"), F.col("v1")).otherwise(F.col("v2")).alias("v2"))


def auto_repair(v: DataFrame, f: DataFrame, ratio: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Without degenerate faces, normals unified, small components removed; duplicates stay.

    Equal to remove_degenerate(), unify_normals() and remove_small_components() one after the other: those number vertices and faces anew in the
    order that they have, so it is enough to do so at the end. Corners and edges are met once.
    """
    square = sum((c.cast("double") * c for c in cross()), F.lit(0.0))
    told = corners_of(v, f).select(*KEY, (index_degenerate() | (square < FLAT)).alias("bad"), _det().alias("det"), F.lit(True).alias("seen"))
    f = cut(f.join(told, KEY, "left").where("NOT coalesce(bad, false)").select(*KEY, "v0", "v1", "v2", "det", "seen"))
    pairs = cut(edge_pairs(f))
    c = components(f, pairs.where("two").select("mesh_id", "fid", F.col("other").alias("nb")), within=True)
    return compact(v, cut(_large(_unified(f, pairs), c, ratio)))
