"""Near-duplicate detection by min-max hashing over distinct 5-word shingles.

Each permutation gives two signature values, the minimum and the maximum of the shingles' hashes; four values make a band.
Texts of equal shingle sets are one class, so copies cost one node. Classes that share a band are candidates:

1. every member of a bucket is compared with the bucket's most central member (the one with most fellows over all bands);
2. confirmed links give components; buckets whose members are all in one component are done;
3. in the others every pair from different components is compared that two exact bounds leave. The Jaccard distance is a
   metric, so distances to a common pivot differ by 0.25 at most; and two sets' parity maps (each shingle flips one of at
   least 4 n bits) differ in no more bits than the sets in shingles, of which a link allows a seventh of both sizes. Maps of
   that width leave pairs above a similarity of about 0.73. Then components are made again.

Links are confirmed on full shingle sets. A pair at the limit of 0.75 shares none of 40 bands with a probability of 3e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Texts, U, cut, gram_hash, map_arrow, mix, read, steps

SHINGLE = 5
ROWS = 4
BANDS = 40
PERMS = ROWS * BANDS // 2
#: Longs of the narrowest parity map.
NARROW = 16

_A, _B = np.random.default_rng(20240502).integers(0, 2**64, (2, PERMS), dtype=U)
_A |= U(1)
_BAND = mix(np.arange(1, BANDS + 1).astype(U) * U(0xD1B54A32D192ED03))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, by text and hash, and the index of each text's first."""
    t = Texts(column)
    w = t.words(SPACE_WORDS)
    g, at = w.grams(SHINGLE)
    hashes, docs = [g], [w.doc[at] if len(at) else at]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(w.count == k)
        hashes.append(gram_hash(w.hash, w.off[few], k))
        docs.append(few)
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def set_nodes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of the sets, as 16 bytes each."""
    halves = [np.add.reduceat(mix(h ^ U(k)), starts) for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return np.stack(halves, axis=1).astype("<u8").view("S1").reshape(len(starts), 16)


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set 2 * PERMS values: minima, then maxima, each from one evaluation of its permutation."""
    out = np.empty((2 * PERMS, len(starts)), U)
    for p in range(PERMS):
        v = h * _A[p] + _B[p]
        out[p] = np.minimum.reduceat(v, starts)
        out[PERMS + p] = np.maximum.reduceat(v, starts)
    return out


def _node_array(nodes: np.ndarray, has: np.ndarray) -> pa.Array:
    full = np.zeros(len(has), object)
    full[:] = None
    full[has] = [x.tobytes() for x in nodes]
    return pa.array(full, pa.binary())


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, t (text hash), n_shingles, node (hash of the set; null if empty), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in steps(batches):
            h, off = shingles(b.column("text"))
            n = np.diff(off)
            has = n > 0
            starts = off[:-1][has]
            bands = np.zeros((0, BANDS), U)
            nodes = np.zeros((0, 16), "S1")
            if len(starts):
                nodes, v = set_nodes(h, starts), signatures(h, starts)
                keys = np.repeat(_BAND[:, None], len(starts), axis=1)
                for r in range(ROWS):
                    keys = mix(keys ^ v[r::ROWS])
                bands = keys.T
            per_set = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * values.shape[1])]), pa.int32()), pa.array(np.ascontiguousarray(values).ravel().view(np.int64)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "t": b.column("t"), "n_shingles": pa.array(n.astype(np.int64)), "node": _node_array(nodes, has)}
                | {"bands": per_set(bands)}
            )

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), run, f"doc_id {kind}, t long, n_shingles long, node binary, bands array<long>")


def map_level(n: np.ndarray) -> np.ndarray:
    """The least k for which 2 ** k maps of NARROW longs have 4 n bits."""
    return np.ceil(np.log2(np.maximum(4 * n / (64 * NARROW), 1))).astype(np.int64)


def parity_maps(h: np.ndarray, off: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Per set the map of its level: bit i is 1 if an odd number of its hashes end in i."""
    bits = 64 * NARROW << level
    at = np.cumsum(bits) - bits
    n = np.diff(off)
    place = np.repeat(at, n) + (h & np.repeat(bits - 1, n).astype(U)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    return np.split(np.packbits(odd.astype(np.uint8)).view("<i8"), at[1:] // 64)


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, s (its distinct shingle hashes), level, and parity maps at that level (map) and the next (wide) of the wanted nodes (columns id, node): each from the text of its doc_id."""
    ids = nodes.select("id").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def run(batches):
        for b in steps(batches):
            h, off = shingles(b.column("text"))
            has = np.diff(off) > 0
            if has.any():
                off = np.concatenate([off[:-1][has], off[-1:]])
                level = map_level(np.diff(off))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))
                maps = {k: pa.array(parity_maps(h, off, level + more), pa.list_(pa.int64())) for k, more in (("map", 0), ("wide", 1))}
                yield pa.RecordBatch.from_pydict({"node": _node_array(set_nodes(h, off[:-1]), np.ones(len(level), bool)), "s": lists, "level": pa.array(level)} | maps)

    return map_arrow(texts, run, "node binary, s array<long>, level long, map array<long>, wide array<long>").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def measured(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of nodes with linked (the intersection of their sets is at least that percentage of the union) and d (Jaccard distance)."""
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb")).alias("both")
    n = pairs.join(left, "a").join(right, "b").select("a", "b", both, (F.size("sa") + F.size("sb")).alias("n"))
    return n.select("a", "b", (100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).alias("linked"), (1 - F.col("both") / (F.col("n") - F.col("both"))).alias("d"))


def components(links: DataFrame) -> DataFrame:
    """node, root of the nodes in links (a, b): each root is its component's least node.

    Alternating large-star and small-star steps: rows stay as many as links, and a hub's rows split over tasks, as the
    minima that they are joined with are plain tables.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        j = large.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "edges")
        # done when it is a set of stars that the step left as it was
        if new.count() == edges.count() and not new.join(edges, ["u", "v"], "left_anti").take(1):
            roots = new.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return cut(roots.union(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
        edges = new


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, component_id (smallest doc_id of the component) and kept, one row per row of docs.

    Null and empty texts and texts without words have no shingles and stay alone; rows of equal shingle sets are linked;
    repeated rows of the smallest doc_id are all kept; a null doc_id is never smallest unless its component has no other;
    other columns are not read; an empty table gives no rows.
    """
    rows = cut(sketch(docs), "sketch")
    classes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    places = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    full = cut(places.groupBy("key").agg(F.count(F.lit(1)).alias("fellows")).where("fellows > 1"), "buckets")
    members = cut(places.join(full, "key"), "members")
    central = cut(members.groupBy("node").agg(F.sum("fellows").alias("c")), "central")
    pivots = cut(members.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node", "n")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")), "pivots")
    near = (4 * F.least("n", "pn") >= 3 * F.greatest("n", "pn")) & (F.col("node") != F.col("pivot"))
    stars = cut(members.join(pivots, "key").where(near).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "stars")
    ids = classes.select("node", "id")
    named = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(ids, "node")
    sets = cut(shingle_sets(docs, cut(named(stars), "named")), "sets")
    tested = cut(measured(stars, sets), "tested")
    links = tested.where("linked").select("a", "b")
    roots = components(links)

    mine = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = cut(mine.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key"), "open")
    rest = cut(mine.join(open_keys, "key").join(classes.select("node", "bands"), "node").select("key", "band", "node", "n", "root", "bands"), "rest")
    # each node's distance to its bucket's pivot, where it was compared
    at = pivots.select("key", "pivot")
    rest = rest.join(at, "key").withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot")).join(tested.select("a", "b", "d"), ["a", "b"], "left")
    rest = cut(rest.withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("d"))).drop("a", "b", "pivot"), "rest")
    wanted = rest.select("node").distinct()
    sets = sets.union(cut(shingle_sets(docs, cut(wanted.join(sets, "node", "left_anti").join(ids, "node"), "named")), "sets"))
    rest = cut(rest.join(sets.drop("s"), "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    other &= 4 * F.least("x.n", "y.n") >= 3 * F.greatest("x.n", "y.n")
    other &= F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= 0.25 + 1e-9, F.lit(True))
    # sizes within 4 to 3 are a level apart at most
    mine, its = (F.when(F.col(f"{p}.level") < F.col(f"{q}.level"), F.col(f"{p}.wide")).otherwise(F.col(f"{p}.map")) for p, q in ("xy", "yx"))
    apart = F.aggregate(F.zip_with(mine, its, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    flat = sum((F.bit_count(F.col("x.map")[i].bitwiseXOR(F.col("y.map")[i])) for i in range(NARROW)), F.lit(0))
    apart = F.when((F.col("x.level") == 0) & (F.col("y.level") == 0), flat).otherwise(apart)
    other &= 7 * apart <= F.col("x.n") + F.col("y.n")
    # a pair comes from the first band that it shares
    other &= F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    pairs = cut(x.join(y, other).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    if pairs.take(1):
        more = cut(measured(pairs, sets).where("linked").select("a", "b"), "links")
        if more.take(1):
            roots = components(links.union(more))

    least = classes.join(roots, "node").groupBy("root").agg(F.min("id").alias("least"))
    found = cut(classes.select("node", "id").join(roots, "node", "left").join(least, "root", "left").select("node", F.coalesce("least", "id").alias("component_id")), "found")
    out = rows.where("node IS NOT NULL").join(found, "node").select("doc_id", "t", "n_shingles", "component_id")
    out = out.union(rows.where("node IS NULL").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns.

    Rows of null and empty texts stay, as they are linked with nothing; of rows that repeat the smallest doc_id all stay; names
    of docs' columns never clash; an empty table gives no rows.
    """
    gone = groups(docs).where("NOT kept").select(F.col("doc_id").alias("·id"), F.col("t").alias("·t")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("·id")) & (F.xxhash64(docs["text"]) == F.col("·t")), "left_anti")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
