"""Benchmark decontamination by winnowing.

Both sides keep the minimum 5-gram hash of each 9 consecutive ones, so every shared span of 13 words shares a fingerprint.
Document fingerprints that a bit table of the benchmark's admits carry the 8 words on each side; joined with the benchmark's
they are extended word by word, and a match of 13 words or more is a hit. That reaches each 13-word window: one that holds
the fingerprint lies within those 8 words. Items of fewer than 13 words are looked up whole, by the hash of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Texts, U, Words, cut, gram_hash, map_arrow, mix, read, steps

SPAN = 13
K = 5
SIDE = SPAN - K
#: Bits of the table that admits fingerprints; a benchmark too large for it only admits more.
BITS = 1 << 22


def selected(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the winnowed k-grams and the index of the first word of each."""
    g, at = w.grams(K)
    size = SIDE + 1
    if len(g) < size:
        return g[:0], at[:0]
    low = sliding_window_view(g, size).argmin(axis=1) + np.arange(len(g) - size + 1)
    inside = w.doc[at[: len(low)]] == w.doc[at[size - 1 :]]
    keep = np.zeros(len(g), bool)
    keep[low[inside]] = True
    return g[keep], at[keep]


def whole(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As selected, of all n-grams, for items of n words."""
    g, at = w.grams(n)
    return mix(g ^ U(0x5851F42D4C957F2D)), at


def around(w: Words, at: np.ndarray, pad: int) -> np.ndarray:
    """Word hashes from SIDE words before to SIDE after each k-gram; pad outside the text."""
    place = at[:, None] + np.arange(-SIDE, K + SIDE)
    inside = (place >= w.off[w.doc[at]][:, None]) & (place < w.off[w.doc[at] + 1][:, None])
    return np.where(inside, w.hash[np.clip(place, 0, max(0, len(w.hash) - 1))] if len(w.hash) else U(0), U(pad))


def binary(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in a], pa.binary())


def benchmark_prints(items: DataFrame) -> DataFrame:
    """h, item (text; null: empty), near (word hashes around; null for an item looked up whole), n (its words, 13 at most)."""

    def run(batches):
        for b in steps(batches):
            t = Texts(b.column("text"))
            w = t.words(ALNUM_WORDS)
            item = b.column("item")
            h, at = selected(w)
            rows = [(h, at, binary(around(w, at, 1)), np.full(len(h), SPAN))]
            for n in range(1, SPAN):
                docs = np.flatnonzero(w.count == n)
                if len(docs):
                    at = w.off[docs]
                    rows.append((mix(gram_hash(w.hash, at, n) ^ U(0x5851F42D4C957F2D)), at, pa.nulls(len(at), pa.binary()), np.full(len(at), n)))
            for h, at, near, n in rows:
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "item": item.take(pa.array(w.doc[at])), "near": near, "n": pa.array(n.astype(np.int32))})

    return map_arrow(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), run, "h long, item string, near binary, n int")


def document_prints(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, t (text hash), n_words, prints (those that the benchmark's bit table admits)."""
    spark = docs.sparkSession
    places = [r[0] for r in prints.select(F.pmod("h", F.lit(BITS)).cast("int")).distinct().toLocalIterator()]  # BITS at most
    table = np.zeros(BITS, bool)
    table[places] = True
    admits = spark.sparkContext.broadcast(np.packbits(table, bitorder="little"))
    short = sorted(r[0] for r in prints.where(F.col("n") < SPAN).select("n").distinct().collect())  # 12 at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bits = admits.value
        for b in steps(batches):
            t = Texts(b.column("text"))
            w = t.words(ALNUM_WORDS)
            hs, ats, nears, ns = [], [], [], []
            for n in (SPAN, *short):
                h, at = selected(w) if n == SPAN else whole(w, n)
                bit = (h & U(BITS - 1)).astype(np.int64)
                ok = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                h, at = h[ok], at[ok]
                hs.append(h)
                ats.append(at)
                ns.append(np.full(len(h), n, np.int32))
                nears += [x.tobytes() for x in around(w, at, 0)] if n == SPAN else [None] * len(h)
            at, h, n = np.concatenate(ats), np.concatenate(hs), np.concatenate(ns)
            order = np.argsort(w.doc[at], kind="stable")
            off = np.searchsorted(w.doc[at][order], np.arange(len(t) + 1))
            pos = at - w.off[w.doc[at]]
            rows = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(pos[order]), pa.array(n[order]), pa.array(nears, pa.binary()).take(pa.array(order))], ["h", "pos", "n", "near"])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "t": b.column("t"), "n_words": pa.array(w.count), "prints": pa.ListArray.from_arrays(pa.array(off, pa.int32()), rows)})

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), run, f"doc_id {kind}, t long, n_words long, prints array<struct<h:long,pos:long,n:int,near:binary>>")


def extend(pairs: DataFrame, kind: str) -> DataFrame:
    """doc_id, t, context, lo, hi: the matched words of each pair of equal fingerprints, where they are a window or more."""

    def run(batches):
        for b in batches:
            n, pos = b.column("n").to_numpy(), b.column("pos").to_numpy()
            lo, hi, ok = pos.copy(), pos + n, np.ones(len(n), bool)
            long = np.flatnonzero(n == SPAN)
            if len(long):
                sides = [np.frombuffer(b"".join(b.column(c).take(pa.array(long)).to_pylist()), U).reshape(len(long), K + 2 * SIDE) for c in ("near", "near_item")]
                same = sides[0] == sides[1]
                left = np.minimum.accumulate(same[:, :SIDE][:, ::-1], axis=1).sum(axis=1)
                right = np.minimum.accumulate(same[:, SIDE + K :], axis=1).sum(axis=1)
                lo[long], hi[long] = pos[long] - left, pos[long] + K + right
                ok[long] = same[:, SIDE : SIDE + K].all(axis=1) & (left + K + right >= SPAN)
            out = b.select(["doc_id", "t", "context"]).take(pa.array(np.flatnonzero(ok)))
            yield pa.RecordBatch.from_pydict({c: out.column(c) for c in out.schema.names} | {"lo": pa.array(lo[ok]), "hi": pa.array(hi[ok])})

    return map_arrow(pairs, run, f"doc_id {kind}, t long, context long, lo long, hi long")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, t, n_words, n_hit, n_items, items (sorted ids), contaminated, one row per row of docs.

    Null and empty texts have no words and no hits; a null item_id counts as an empty one, and rows of one item_id are one
    item; repeated rows have equal results; other columns are not read; an empty table on either side gives no hits.
    """
    prints = cut(benchmark_prints(items), "prints")
    own = cut(document_prints(docs, prints), "docprints")
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = own.where(F.size("prints") > 0).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", F.explode("prints").alias("p")).select("doc_id", "t", "p.*")
    # contexts first: a passage that many items hold is matched once, and its items are joined with texts that have it
    contexts = cut(prints.select("h", "n", F.col("near").alias("near_item"), F.xxhash64("h", "n", "near").alias("context")).distinct(), "contexts")
    pairs = each.join(contexts, ["h", "n"])
    found = cut(extend(pairs.select("doc_id", "t", "context", "n", "pos", "near", "near_item"), kind), "spans")
    owners = prints.select(F.xxhash64("h", "n", "near").alias("context"), "item").distinct()
    which = found.select("doc_id", "t", "context").distinct().join(owners, "context").groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.select("doc_id", "t", "lo", "hi").distinct()
    # as many spans as a text has places; a text is one row in any case
    hits = spans.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    hits = hits.join(which.withColumnsRenamed({"doc_id": "·d", "t": "·h"}), F.col("doc_id").eqNullSafe(F.col("·d")) & (F.col("t") == F.col("·h")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    union = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["hit"] + F.greatest(s["hi"] - F.greatest(a["end"], s["lo"]), F.lit(0))).alias("hit")))
    hits = hits.select(F.col("doc_id").alias("·id"), F.col("t").alias("·t"), "items", union["hit"].alias("n_hit"))
    out = own.select("doc_id", "t", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("·id")) & (F.col("t") == F.col("·t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "t", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns.

    Rows of null and empty texts stay; repeated rows stay or go together; names of docs' columns never clash; an empty table of
    items drops nothing, an empty one of docs gives no rows.
    """
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("·id"), F.col("t").alias("·t")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("·id")) & (F.xxhash64(docs["text"]) == F.col("·t")), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
