"""Mesh tables derived from the harness tables, with integer coordinates, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    n = table(spark, d, "events").count()
    w = math.isqrt(n)
    return w, n // w if w else 0


def scan(spark: SparkSession, d: str, dirty: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices and faces of a height field over events, with square holes and a detached corner; dirty adds defects."""
    w, h = sizes(spark, d)
    e = table(spark, d, "events").where(F.col("event_id") < w * h)
    mesh = F.lit("scan").alias("mesh_id")
    i, j = F.col("event_id") % w, F.floor(F.col("event_id") / w).cast("long")
    z = (F.round(100 * F.col("value")).cast("long") % 101).alias("z")
    v = e.select(mesh, F.col("event_id").alias("vid"), (100 * i).alias("x"), (100 * j).alias("y"), z)
    hole = (i % 10).isin(4, 5) & (j % 10).isin(4, 5)
    trench = ((i >= w - 6) & (j == h - 6)) | ((i == w - 6) & (j >= h - 6))
    cells = e.where((i < w - 1) & (j < h - 1) & ~hole & ~trench).select(mesh, F.col("event_id").alias("a"), i.alias("i"), j.alias("j"))
    a = F.col("a")
    face = lambda fid, *vs: F.struct(fid.alias("fid"), *[x.alias(f"v{k}") for k, x in enumerate(vs)])
    turned = (a % 97 == 0) if dirty else F.lit(False)
    second = lambda x, y: F.when(turned, y).otherwise(x)
    faces = [face(2 * a, a, second(a + 1, a + w + 1), second(a + w + 1, a + 1)), face(2 * a + 1, a, second(a + w + 1, a + w), second(a + w, a + w + 1))]
    f = cells.select("mesh_id", F.explode(F.array(*faces)).alias("f")).select("mesh_id", "f.*")
    if dirty:
        spot = cells.where("i % 50 = 0 AND j % 50 = 0")
        extra = F.array(face(2 * a + 2 * w * h, a, a, a + 1), face(2 * a + 1 + 2 * w * h, a, a + 1, a + w + 1))
        f = f.union(spot.select("mesh_id", F.explode(extra).alias("f")).select("mesh_id", "f.*"))
    return v, f


def scan_sql(dirty: bool = False) -> str:
    """CTEs v(vid, x, y, z), f(fid, v0, v1, v2), he(fid, k, u, v, lo, hi) and p(fid, v0.., x0..z2), to put before a query."""
    t = "vid % 97 = 0" if dirty else "false"
    extra = ""
    if dirty:
        extra = """ UNION ALL SELECT 2 * vid + 2 * w * h, vid, vid, vid + 1 FROM c WHERE i % 50 = 0 AND j % 50 = 0
        UNION ALL SELECT 2 * vid + 1 + 2 * w * h, vid, vid + 1, vid + w + 1 FROM c WHERE i % 50 = 0 AND j % 50 = 0"""
    return f"""
WITH RECURSIVE g0 AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM events), g AS (SELECT w, n // w AS h FROM g0),
ij AS (SELECT event_id AS vid, event_id % w AS i, event_id // w AS j, w, h, CAST(round(100 * value) AS BIGINT) % 101 AS z FROM events, g WHERE event_id < w * h),
v AS (SELECT vid, 100 * i AS x, 100 * j AS y, z FROM ij),
c AS (SELECT vid, i, j, w, h FROM ij WHERE i < w - 1 AND j < h - 1 AND NOT (i % 10 IN (4, 5) AND j % 10 IN (4, 5)) AND NOT ((i >= w - 6 AND j = h - 6) OR (i = w - 6 AND j >= h - 6))),
f AS (SELECT 2 * vid AS fid, vid AS v0, CASE WHEN {t} THEN vid + w + 1 ELSE vid + 1 END AS v1, CASE WHEN {t} THEN vid + 1 ELSE vid + w + 1 END AS v2 FROM c
 UNION ALL SELECT 2 * vid + 1, vid, CASE WHEN {t} THEN vid + w ELSE vid + w + 1 END, CASE WHEN {t} THEN vid + w + 1 ELSE vid + w END FROM c{extra}),
he AS (SELECT fid, k, u, v, least(u, v) AS lo, greatest(u, v) AS hi FROM (SELECT fid, 0 AS k, v0 AS u, v1 AS v FROM f UNION ALL SELECT fid, 1, v1, v2 FROM f UNION ALL SELECT fid, 2, v2, v0 FROM f)),
p AS (SELECT fid, v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2 FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v d ON d.vid = v2),
n AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS cx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS cy, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS cz FROM p),
be AS (SELECT lo, hi, min(fid) AS fid, min(u) AS u, min(v) AS v FROM he GROUP BY lo, hi HAVING count(*) = 1)
"""


#: A selection: faces whose id falls in one of seven classes. Spark and DuckDB.
def chosen(f: DataFrame) -> DataFrame:
    return f.where(F.floor(F.col("fid") / 40) % 7 < 3).select("mesh_id", "fid")


CHOSEN = "sel AS (SELECT fid FROM f WHERE (fid // 40) % 7 < 3)"


def hidden(f: DataFrame) -> DataFrame:
    return f.where(F.floor(F.col("fid") / 64) % 11 == 5).select("mesh_id", "fid")


HIDDEN = "hid AS (SELECT fid FROM f WHERE (fid // 64) % 11 = 5)"
ADJ = """adj AS (SELECT fid, k, CASE WHEN count(*) OVER e > 1 THEN coalesce(lead(fid) OVER o, first_value(fid) OVER e) END AS nb FROM he
 WINDOW o AS (PARTITION BY lo, hi ORDER BY fid, k), e AS (PARTITION BY lo, hi ORDER BY fid, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
UNIT = "un AS (SELECT fid, cx / s AS nx, cy / s AS ny, cz / s AS nz FROM (SELECT *, sqrt(CAST(cx AS DOUBLE) * cx + CAST(cy AS DOUBLE) * cy + CAST(cz AS DOUBLE) * cz) AS s FROM n))"
