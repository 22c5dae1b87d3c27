"""Nearest neighbours by a permutation index: largest inner products of some vectors among all.

Vectors are lifted by one coordinate that makes all of them equally long (queries get zero there), so that the largest inner
product is the smallest angle. A vector is then the list of its PREFIX nearest pivots in order. Blocks of vectors keep an
inverted file each: for every pivot, the members that have it in their list, with its rank. A query meets every block once,
reads the lists of its own pivots, and so gets the footrule distance to each member (a pivot that only one of both lists
has counts as ranked just behind). The nearest by footrule are reranked by the inner product of the original vectors.

Equal vectors are one member with its smallest ids, as many as a result may need, so copies cost nothing and none is lost.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, map_arrow, read

#: Pivots (different vectors of least hash: a bounded sample of the table) and how many of them a vector's list has.
PIVOTS, PREFIX = 256, 64  # a list of at most 255, so that ranks are bytes
#: Members of a block; every vector is in one.
BLOCK = 4096
#: Members of a block that are reranked for a query: so many, and that share of the block.
LEAST, SHARE = 256, 0.12
#: Queries that a task holds at once, with their results.
GROUP = 32768
#: Parts of a group of copies that are cut down to their smallest ids before the group meets.
SALTS = 32


def usable(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """vec_id and v (doubles): different rows whose id is not null and whose vector is neither null, empty nor zero and has finite components only."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _smallest(rows: DataFrame, keep: int, *keys: str | Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("vec_id")
    return rows.withColumn("·n", F.row_number().over(w)).where(F.col("·n") <= keep).drop("·n")


def members(rows: DataFrame, keep: int) -> DataFrame:
    """v and ids (its `keep` smallest different vec_ids, in order) of each different vector."""
    few = _smallest(rows, keep, "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    return few.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))


def lists(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row of x, nearest first, ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Index:
    """blocks: a Parquet table of block, v (the members' vectors end to end), ids and counts (vec_ids of each member, end to end),
    and of the inverted file starts, slots and ranks: list p is slots[starts[p]:starts[p + 1]], with p's rank in the list of each slot."""

    def __init__(self, blocks: DataFrame | None, pivots: np.ndarray, prefix: int, kind: str):
        self.blocks, self.pivots, self.prefix, self.kind = blocks, pivots, prefix, kind


def build(rows: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK) -> Index:
    """The index of all usable rows, for results of up to k. Of rows with vectors of several lengths the commonest length (ties: the
    longer) takes part."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return Index(None, np.zeros((0, 1)), prefix, kind)
    own = cut(members(rows.where(F.size("v") == size["d"]), k + 1), "members")
    n, unit = own.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit))  # huge components must not overflow
    top = own.agg(F.max(square)).first()[0]
    chosen = np.array([r["v"] for r in own.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()])

    def lift(x: np.ndarray) -> np.ndarray:
        x = x / unit
        return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1, keepdims=True), 0))])

    p, prefix, blocks = lift(chosen), min(prefix, len(chosen), 255), -(-n // block)

    def invert(batches):
        for b in batches:
            for row in range(b.num_rows):
                x = np.asarray(b.column("v")[row].values.flatten(), float).reshape(-1, size["d"])
                near = lists(lift(x), p, prefix)
                order = np.argsort(near.ravel(), kind="stable")
                starts = np.searchsorted(near.ravel()[order], np.arange(len(p) + 1))
                ids = b.column("ids")[row].values
                counts = np.diff(ids.offsets.to_numpy())
                yield batch_of(
                    block=pa.array([b.column("block")[row].as_py()], pa.int64()), v=pa.array([x.tobytes()]), ids=pa.ListArray.from_arrays(pa.array([0, len(ids.flatten())], pa.int32()), ids.flatten()),
                    counts=pa.array([counts.astype(np.int32).tobytes()]), starts=pa.array([starts.astype(np.int32).tobytes()]), slots=pa.array([(order // prefix).astype(np.int32).tobytes()]),
                    ranks=pa.array([(order % prefix).astype(np.int16).tobytes()]),
                )

    # a block is a number of members that does not grow with the table, whatever their copies
    packed = own.groupBy(F.pmod(F.xxhash64("v", F.lit("block")), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("v", "ids")).alias("m")).select("block", "m.v", "m.ids")
    table = map_arrow(packed, invert, f"block long, v binary, ids array<{kind}>, counts binary, starts binary, slots binary, ranks binary")
    return Index(cut(table, "blocks"), p, prefix, kind)


class Block:
    """One block in memory: near[p] has, for each member, prefix minus p's rank in its list, 0 if p is not in it."""

    def __init__(self, row: dict, dims: int, pivots: int, prefix: int):
        self.v = np.frombuffer(row["v"]).reshape(-1, dims)
        self.ids = np.asarray(row["ids"])
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int32))])
        starts, slots, ranks = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["slots"], np.int32), np.frombuffer(row["ranks"], np.int16)
        self.near = np.zeros((pivots, len(self.v)), np.uint8)
        self.near[np.repeat(np.arange(pivots), np.diff(starts)), slots] = prefix - ranks

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """The footrule distance of each member's list to a query's. A pivot of both with ranks q and x counts |q - x| and one of
        a single list prefix - rank; as all lists are equally long the sum is prefix * (prefix + 1) - 2 * sum(prefix - max(q, x)) over shared pivots."""
        n = len(own)
        near = self.near[own]
        np.minimum(near, (n - np.arange(n)).astype(np.uint8)[:, None], out=near)
        return n * (n + 1) - 2 * near.sum(0, dtype=np.uint16).astype(np.int32)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and vec_ids of the block's k best rows."""
        n = len(self.v)
        c = min(n, least + int(share * n))
        found = np.argpartition(self.footrule(own), c - 1)[:c] if c < n else np.arange(n)
        score = (self.v[found] * q).sum(1)
        if c > k:
            limit = np.partition(score, c - k)[c - k]
            found, score = found[score >= limit], score[score >= limit]
        take = np.concatenate([np.arange(self.first[m], self.first[m + 1]) for m in found])
        return best(np.repeat(score, self.first[found + 1] - self.first[found]), self.ids[take], k)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search(index: Index, queries: DataFrame, k: int = 20, least: int = LEAST, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each of the queries (vec_id, v).

    Queries are dealt into groups and each group meets every block once, a block at a time; of few groups each goes to several tasks that
    share the blocks. So a task holds a group, its results and one block, and rows made are k for each query and task.
    """
    spark, kind = queries.sparkSession, index.kind
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if index.blocks is None:
        return spark.createDataFrame([], schema)
    p, prefix = index.pivots, index.prefix
    dims = p.shape[1] - 1
    rows = queries.where(F.size("v") == dims)
    groups = max(1, -(-rows.count() // group))
    shares = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    mine = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"), F.lit(-1).cast("long").alias("block"), "vec_id", F.col("v").alias("q"))
    theirs = index.blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("s", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    both = mine.unionByName(theirs, allowMissingColumns=True).repartition("g", "s").sortWithinPartitions("g", "s", "block")

    def run(batches):
        cell, q, own, state, same = None, [], None, [], None

        def results():
            done = [(i, *s) for i, s in zip(q_ids, state, strict=True) if s is not None]
            sizes = [len(x[1]) for x in done]
            values = [np.concatenate(c) if done else np.zeros(0) for c in ([x[j] for x in done] for j in (1, 2))]
            return batch_of(query_id=pa.array([x[0] for x in done], id_type).take(pa.array(np.repeat(np.arange(len(done)), sizes))), vec_id=pa.array(values[1].tolist(), id_type), score=pa.array(values[0], pa.float64()))

        q_ids, id_type = [], None
        for b in batches:
            id_type = b.column("vec_id").type
            for i in range(b.num_rows):
                here = b.column("g")[i].as_py(), b.column("s")[i].as_py()
                if here != cell:
                    if q_ids and own is not None:
                        yield results()
                    cell, q_ids, q, own, state = here, [], [], None, []
                if b.column("block")[i].as_py() < 0:
                    q_ids.append(b.column("vec_id")[i].as_py())
                    q.append(np.asarray(b.column("q")[i].values, float))
                    continue
                if not q_ids:
                    continue
                if own is None:
                    own = lists(np.hstack([np.array(q), np.zeros((len(q), 1))]), p, prefix)
                    state = [None] * len(q)
                    same = Counter(q_ids)  # rows of a query's id may be found first and are left out in the end
                block = Block({c: b.column(c)[i].as_py() for c in ("v", "counts", "starts", "slots", "ranks")} | {"ids": b.column("ids")[i].values.to_numpy(zero_copy_only=False)}, dims, len(p), prefix)
                for j, x in enumerate(q):
                    most = k + same[q_ids[j]]
                    score, ids = block.search(x, own[j], most, least, share)
                    if state[j] is not None:
                        score, ids = best(np.concatenate([score, state[j][0]]), np.concatenate([ids, state[j][1]]), most)
                    state[j] = score, ids
        if q_ids and own is not None:
            yield results()

    found = map_arrow(both, run, f"query_id {kind}, vec_id {kind}, score double").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding", id: str = "vec_id", **how) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the inner product of the original vectors in double precision): for each row whose id is
    divisible by `every`, the k nearest found among the rows of other ids; all of them, if fewer. Ties go to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part, nor do
    vectors of another length than the commonest. Repeated rows are one row; different vectors of one id are
    candidates each, and as queries they share one result: the best k over all of them, an id once for each of its vectors.
    Other columns are ignored; an empty table, or one with a single row, gives no rows. Texts are not looked at.
    """
    rows = usable(vectors, vector, id)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    return search(build(rows, k, **{x: how[x] for x in how if x in ("pivots", "prefix", "block")}), queries, k, **{x: how[x] for x in how if x in ("least", "share", "group")})


def op13_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
