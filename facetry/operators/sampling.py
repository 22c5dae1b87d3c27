"""Surface samples that are those of one sequential stream, whatever the number of partitions.

Face areas are summed exactly, as whole shares of the mesh's largest, so their running sums do not depend on how the faces lie. A sample
takes three numbers of the stream; blocks of samples are drawn side by side, each from its own place of it. A sample's face is the last
one that begins before it: samples and faces are sorted together by ranges, and what the last face of a range was goes on to the next,
so neither a mesh nor a face with most of the area is one task's work.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stream
from ..tables import carried, running
from .mesh import AXES, corners_of, cross

#: Samples of a block, and blocks that a task draws at once.
BLOCK, SIDE_BY_SIDE = 1024, 64
LEAST_AREA, LEAST_TOTAL = 1e-20, 1e-12
_CORNERS = [f"{a}{k}" for k in range(3) for a in AXES]


def draws(meshes: DataFrame, n: int, seed: int) -> DataFrame:
    """mesh_id, i (0 to n - 1), at (53 bits of the stream), a and b (24 bits each): each mesh of the column mesh_id gets the stream from its start."""
    last = max(0, n - 1) // BLOCK
    blocks = meshes.select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block")).where(F.lit(n > 0))
    parts = int(meshes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = meshes.schema["mesh_id"].dataType.simpleString()

    def run(batches):
        start = stream.seeded(seed)
        for rows in batches:
            for k in range(0, len(rows), SIDE_BY_SIDE):
                some = rows.iloc[k : k + SIDE_BY_SIDE]
                block = some["block"].to_numpy(np.int64)
                s = stream.jump(np.repeat(start[None], len(block), axis=0), 3 * BLOCK * block)
                got = np.empty((3, len(block), BLOCK), np.uint64)
                for i in range(BLOCK):
                    for j in range(3):
                        got[j, :, i] = stream.output(s)
                        s = stream.advance(s)
                i = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                at, a, b = (got[j].ravel() >> np.uint64(h) for j, h in enumerate((11, 40, 40)))
                out = pd.DataFrame({"mesh_id": np.repeat(some["mesh_id"].to_numpy(), BLOCK), "i": i, "at": at.astype(np.int64), "a": a.astype(np.int64), "b": b.astype(np.int64)})
                yield out[out["i"] < n]

    return blocks.repartition(parts, "mesh_id", "block").mapInPandas(run, f"mesh_id {kind}, i long, at long, a long, b long")


def stream_sample(v: DataFrame, f: DataFrame, n: int, seed: int = 0, masked: DataFrame | None = None) -> DataFrame:
    """mesh_id, i, fid, x, y, z: n samples of each mesh, spread by area; sample i is the same for any number of partitions.

    Faces count in the order of fid. Without a mask each has an area of at least 1e-20, so a mesh of slivers has samples too; with a mask(mesh_id, fid)
    the others' areas count as they are, and a mesh with no more than 1e-12 of them has no samples. Faces whose corners are missing or null don't count.
    Areas and points are doubles. Equal fids of a mesh are one face.
    """
    g = corners_of(v, f if masked is None else f.join(masked.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti")).dropna(subset=_CORNERS)
    square = reduce(lambda a, b: a + b, [c.cast("double") * c for c in cross()])
    g = g.select("mesh_id", "fid", *[F.col(c).cast("double").alias(c) for c in _CORNERS], (F.sqrt(square) / 2).alias("area"))
    if masked is None:
        g = g.withColumn("area", F.greatest("area", F.lit(LEAST_AREA)))
    most = g.groupBy("mesh_id").agg(F.max("area").alias("most")).where("most > 0")
    # a row a mesh: where few meshes make most exchange partitions empty, the planner may drop its own broadcast and put a mesh into one task
    g = g.join(F.broadcast(most), "mesh_id").withColumn("share", F.round(F.col("area") / F.col("most") * 2.0**53).cast("decimal(18,0)"))
    g = running(g, ["fid"], "share", "before")
    whole = g.groupBy("mesh_id").agg(F.sum("share").cast("double").alias("whole"), F.first("most").alias("most"), F.min("fid").alias("first"))
    if masked is not None:
        whole = whole.where(F.col("whole") / 2.0**53 * F.col("most") > LEAST_TOTAL)
    d = draws(whole, n, seed).join(F.broadcast(whole.select("mesh_id", "whole")), "mesh_id")
    # a face holds what lies beyond its beginning, so a sample at that place comes before it
    corners = F.struct("fid", *_CORNERS)
    faces = g.join(F.broadcast(whole.select("mesh_id", "first")), "mesh_id").select(
        "mesh_id", F.when(F.col("fid") == F.col("first"), -1.0).otherwise(F.col("before").cast("double")).alias("place"), F.lit(1).alias("kind"), F.col("fid").alias("nth"), corners.alias("face"), *[F.lit(None).cast("long").alias(c) for c in "ab"]
    )
    points = d.select("mesh_id", (F.col("at") * 2.0**-53 * F.col("whole")).alias("place"), F.lit(0).alias("kind"), F.col("i").alias("nth"), F.lit(None).cast(faces.schema["face"].dataType).alias("face"), "a", "b")
    held = carried(faces.unionByName(points), ["place", "kind", "nth"], "face", "held").where("kind = 0")
    held = held.select("mesh_id", F.col("nth").alias("i"), "held.*", (F.col("a") * 2.0**-24).alias("a"), (F.col("b") * 2.0**-24).alias("b"))
    flip = F.col("a") + F.col("b") > 1
    held = held.withColumns({c: F.when(flip, 1 - F.col(c)).otherwise(F.col(c)) for c in "ab"})
    at = {c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("a") + (F.col(f"{c}2") - F.col(f"{c}0")) * F.col("b") for c in AXES}
    return held.select("mesh_id", "i", "fid", *[x.alias(c) for c, x in at.items()])
