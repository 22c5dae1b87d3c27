"""What the document operators share: Arrow passes, word tables, hashes and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Words of the contracts: runs outside ASCII white space, and runs of digits, letters and non-ASCII characters.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.ones(256, bool)
ALNUM_WORDS[:128] = False
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of text that one step of a pass holds in numpy arrays at once; a longer text is a step of its own.
STEP_BYTES = 1 << 21

_BYTES = np.random.default_rng(20240501).integers(0, 2**64, (2, 256), dtype=U) | U(1)
_POWER = np.ones(1, U)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        size = max(n, 4096)
        _POWER = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, _BASE, U)]))
    return _POWER


def hash_runs(values: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of consecutive runs of bytes; values holds the runs end to end, all of at least one byte. Two independent ones."""
    if not len(lengths):
        return np.zeros(0, U)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTES[which][values] * _powers(int(lengths.max()))[place], starts)
    return mix(sums + lengths.astype(U) * U(0xD6E8FEB86659FD93))


class Texts:
    """The UTF-8 bytes of some texts (null: empty), end to end; off has the places where each begins."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
        if a.null_count:
            a = a.fill_null(b"")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        body = a.buffers()[2] if len(a) else None
        self.data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]

    def __len__(self) -> int:
        return len(self.off) - 1

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, place, "right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per byte."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and text of each \\n-split line that has a word."""
        newline = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.off[:-1], newline + 1]))
        stops = np.sort(np.concatenate([newline, self.off[1:]]))
        full = np.concatenate([[0], np.cumsum(SPACE_WORDS[self.data])])
        keep = full[stops] > full[starts]
        return starts[keep], (stops - starts)[keep], self.doc_of(starts[keep])

    def runs(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes of disjoint runs of at least one byte, end to end."""
        at = np.cumsum(lengths) - lengths
        return self.data[np.arange(int(lengths.sum())) + np.repeat(starts - at, lengths)]

    def words(self, wordly: np.ndarray, fold: np.ndarray = LOWER) -> Words:
        return Words(self, wordly, fold)


class Words:
    """hash, start and end (bytes) and doc of each word; off has the index of each text's first word."""

    def __init__(self, texts: Texts, wordly: np.ndarray, fold: np.ndarray):
        inside = wordly[texts.data]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        edge = np.zeros(len(inside) + 1, bool)
        edge[texts.off] = True
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hash = hash_runs(fold[texts.data[inside]], self.end - self.start)
        self.off = np.searchsorted(self.start, texts.off)
        self.count = np.diff(self.off)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows inside one text, and the index of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return gram_hash(self.hash, at, k), at


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    g = np.full(len(at), U(k * 0xA24BAED4963EE407 % 2**64), U)
    for j in range(k):
        g = g * U(0x9FB21C651E98DF25) + h[at + j]
    return mix(g)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `most` bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=float))
        share = np.cumsum(sizes + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def tune(spark: SparkSession) -> SparkSession:
    """Bounds what crosses to Python at once: long texts must not gather in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(f, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without a setting (a local session) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="facetry-")
            spark.conf.set("spark.checkpoint.dir", found)
            _made.append(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


_made: list[str] = []


@atexit.register
def _clear() -> None:
    import shutil

    for d in _made:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/facetry-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows as a Parquet table in the shared folder: evaluated once, with no lineage behind it."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(c: str | Column = "doc_id") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def crc_mod(n: int, c: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(id_text(c).cast("binary")) % F.lit(n)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """A number of partitions in proportion to the rows, and no fewer than the session's."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
