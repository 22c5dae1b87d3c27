"""Closed loops of open edges, with their vertices in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .topology import boundary_edges, components

LOOP = ["mesh_id", "root", "part"]
#: Edges whose loops a task walks at once.
WALKED = 1 << 16


def simple_cycles(u, v) -> list[list[int]]:
    """Vertices of the cycles of at least three edges that directed edges make, each from its least vertex.

    A walk takes the edge to the least vertex first. What lies between two visits of a vertex is a cycle of its own, so
    cycles that touch come apart; an edge that leads to a dead end is in none.
    """
    after: dict[int, list[int]] = {}
    for a, b in sorted(zip(u, v, strict=True), reverse=True):
        after.setdefault(a, []).append(b)
    out = []
    for start in sorted(after):
        path, place = [start], {start: 0}
        while path:
            here = path[-1]
            if not after.get(here):
                del place[path.pop()]
                continue
            to = after[here].pop()
            if to in place:
                ring = path[place[to] :]
                for x in ring[1:]:
                    del place[x]
                path = path[: place[to] + 1]
                if len(ring) > 2:
                    k = ring.index(min(ring))
                    out.append(ring[k:] + ring[:k])
            else:
                place[to] = len(path)
                path.append(to)
    return sorted(out)


def ordered_loops(f: DataFrame) -> DataFrame:
    """mesh_id, root (least vertex of what hangs together), part (loops of one root), vertices (in the direction of the faces' edges).

    A row per closed loop of three open edges or more. What hangs together is walked in one task: it has as many edges as a hole's rim.
    """
    b = cut(boundary_edges(f).select("mesh_id", "u", "v"))
    nodes = b.select("mesh_id", F.explode(F.array("u", "v")).alias("fid")).distinct()
    c = components(nodes, b.select("mesh_id", F.col("u").alias("fid"), F.col("v").alias("nb")), within=True)
    rooted = b.join(c.select("mesh_id", F.col("fid").alias("u"), "root"), ["mesh_id", "u"])

    kinds = {c.name: c.dataType.simpleString() for c in rooted.schema}

    def run(batches):
        """Walks what hangs together, many at once: what has gathered is walked up to the last root, which may go on in the next batch."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= WALKED:
                table = pa.Table.from_batches(held).combine_chunks()
                same = pc.and_(pc.equal(table.column("root"), table.column("root")[n - 1]), pc.equal(table.column("mesh_id"), table.column("mesh_id")[n - 1]))
                last = int(np.flatnonzero(~same.to_numpy()).max(initial=-1)) + 1
                if last:
                    yield from _walked(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
        if n:
            yield from _walked(pa.Table.from_batches(held))

    # few bytes are much work: dealt by number, as their size would put them into few tasks
    parts = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rooted.select(*LOOP[:2], "u", "v").repartition(parts, "mesh_id", "root").sortWithinPartitions("root", "mesh_id")
    return cut(near.mapInArrow(run, f"mesh_id {kinds['mesh_id']}, root {kinds['root']}, part int, vertices array<{kinds['u']}>"))


def _walked(table: pa.Table):
    """The loops of edges (mesh_id, root, u, v) that lie together by mesh and root, each with its number in its root."""
    root, u, v = (table.column(c).to_numpy() for c in ("root", "u", "v"))
    mesh = table.column("mesh_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, (np.diff(root) != 0) | (np.diff(mesh) != 0)])
    first, part, rings = [], [], []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(root)]):
        found = simple_cycles(u[a:b].tolist(), v[a:b].tolist())
        first += [a] * len(found)
        part += range(len(found))
        rings += found
    at = pa.array(first, pa.int64())
    kind = table.schema.field("u").type
    made = {c: table.column(c).take(at) for c in LOOP[:2]} | {"part": pa.array(part, pa.int32()), "vertices": pa.array(rings, pa.list_(kind))}
    yield from pa.table(made).to_batches()


def loop_edges(loops: DataFrame) -> DataFrame:
    """mesh_id, root, part, at (from 0), u, v of each loop's edges."""
    n = F.size("vertices")
    one = loops.select(*LOOP, "vertices", F.posexplode("vertices").alias("at", "u"))
    return one.select(*LOOP, "at", "u", F.element_at("vertices", ((F.col("at") + 1) % n + 1).cast("int")).alias("v"))
