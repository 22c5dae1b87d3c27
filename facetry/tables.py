"""Tables that cut lineage, and ids in a total order without a single-task window."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []
#: Rows of a block in running() and carried(), as a power of two.
BLOCK_BITS = 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without a setting (a local session) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append(found)
    return found.rstrip("/")


@atexit.register
def _clear() -> None:
    for d in _made:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, evaluated once."""
    path = f"{shared_dir(df.sparkSession)}/mesh-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing will read again; others are passed over."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[str], name: str, per: str = "mesh_id") -> DataFrame:
    """df with `name`: 0, 1, ... in the order, for each value of `per`.

    Rows are dealt by ranges of (per, order), numbered inside their range, and shifted by what lies in earlier ranges: a
    large mesh is spread over all tasks, and only a count per range and mesh is brought together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, per, *order).sortWithinPartitions(per, *order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = dealt.groupBy(per, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"))
    before = Window.partitionBy(per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(per, "_part", "_low", "_before")
    return dealt.join(shift, [per, "_part"]).withColumn(name, F.col("_row") - F.col("_low") + F.col("_before")).drop("_part", "_row", "_low", "_before")


def _dealt(df: DataFrame, order: list[str], per: str) -> DataFrame:
    """df dealt by ranges of (per, order), with _part, a block of rows of a range, and _row, both rising. Blocks are small, so that windows over them spread evenly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, per, *order).sortWithinPartitions(per, *order)
    return cut(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", BLOCK_BITS)))


def running(df: DataFrame, order: list[str], value: str, name: str, per: str = "mesh_id") -> DataFrame:
    """df with `name`: the sum of `value` over the rows before, in the order, for each value of `per`; 0 at its first row. Sums of
    decimals or whole numbers are the same for any number of ranges; only a sum per range is brought together."""
    dealt = _dealt(df, order, per)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(per, "_part").agg(F.sum(value).alias("_sum"))
    shift = shift.select(per, "_part", F.sum("_sum").over(before(Window.partitionBy(per).orderBy("_part"))).alias("_before"))
    inside = F.sum(value).over(before(Window.partitionBy(per, "_part").orderBy("_row")))
    out = dealt.withColumn("_inside", inside).join(shift, [per, "_part"])
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))).drop("_part", "_row", "_before", "_inside")


def carried(df: DataFrame, order: list[str], value: str, name: str, per: str = "mesh_id") -> DataFrame:
    """df with `name`: the last `value` that is not null, of the row and those before it in the order, for each value of `per`. An as-of join is
    this over the union of both sides; a range only hands its last value on, so many rows on one value are spread as well."""
    dealt = _dealt(df, order, per)
    ends = dealt.where(F.col(value).isNotNull()).groupBy(per, "_part").agg(F.max_by(value, "_row").alias("_end"))
    parts = dealt.select(per, "_part").distinct().join(ends, [per, "_part"], "left")
    before = Window.partitionBy(per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(per, "_part", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(per, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(shift, [per, "_part"]).withColumn(name, F.coalesce("_inside", "_before")).drop("_part", "_row", "_before", "_inside")
