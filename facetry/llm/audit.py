"""Filter interaction audit: what each filter removes at each place of every order of the filters.

Texts are sorted by ranges of (fingerprint, doc_id) and inside a range by fingerprint, full text and doc_id, so a row is a
duplicate if its predecessor has the same text and a smaller doc_id, or is a duplicate itself. Ranges cut a group of
copies of any size; the first and last groups of each range say in a small table which of their heads an earlier range has.
The same pass evaluates the other filters, so a text is shuffled once and read once. Failures become a bit mask, masks become
counters (rows of a part with that mask), and counters give every order: no text or row is looked at again.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SAME, SPACE_WORDS, Texts, Words, cut, map_arrow, read, steps

_UPPER = np.zeros(256, np.uint8)
_UPPER[0x41:0x5B] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#$%&*|")] = 1


def _distinct(w: Words) -> np.ndarray:
    """Distinct words of each text."""
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(w.count))


#: Failure conditions by letter, over some texts and their words. The duplicate filter's letter comes after them.
FILTERS: dict[str, Callable[[Texts, Words], np.ndarray]] = {
    "A": lambda t, w: w.count < 200,
    "B": lambda t, w: 100 * _distinct(w) < 50 * w.count,
    "C": lambda t, w: 100 * t.sums(_UPPER[t.data]) > 3 * t.sums((t.data & 0xC0) != 0x80),
    "D": lambda t, w: t.sums(_SYMBOL[t.data]) > 0,
}
DUPLICATE = "E"


def failures(docs: DataFrame, part: str = "lang", filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """doc_id, part (text; null: empty) and mask (bit i: the i-th filter fails, the bit after them: duplicate) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    again = 1 << len(filters)

    def run(batches):
        fp = body = first = None  # of the last row: fingerprint, text, and the doc_id of its group's head
        held, edge, out = [], True, []  # heads of the fingerprint at hand; whether it is the range's first

        def close(edge):
            out.extend((*x, b.tobytes().decode() if edge else None) for x, b in held)
            held.clear()

        def batch():
            cols = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["doc_id", "part", "mask", "fp", "edge"])

        types = None
        for b in steps(batches):
            types = types or [b.column("doc_id").type, pa.string(), pa.int32(), pa.int64(), pa.string()]
            t = Texts(b.column("text"))
            w = t.words(SPACE_WORDS, SAME)
            mask = sum(np.asarray(f(t, w)).astype(np.int32) << i for i, f in enumerate(filters.values())) + np.zeros(len(t), np.int32)
            rows = zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), mask.tolist(), b.column("fp").to_pylist(), strict=True)
            for i, (doc_id, name, m, f) in enumerate(rows):
                own = t.data[t.off[i] : t.off[i + 1]]
                if body is not None and f != fp:
                    close(edge)
                    edge = False
                if body is None or f != fp or not np.array_equal(own, body):
                    fp, body, first = f, own.copy(), doc_id
                if doc_id == first:
                    held.append(((doc_id, name, m, f), body))
                else:
                    out.append((doc_id, name, m | again, f, None))
            yield batch()
        if body is not None:
            close(True)
            yield batch()

    text = F.coalesce("text", F.lit(""))
    sorted_ = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"))
    sorted_ = sorted_.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = cut(map_arrow(sorted_, run, f"doc_id {kind}, part string, mask int, fp long, edge string"), "failures")
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")  # nulls first, as in the sort
    earlier = F.min(place).over(Window.partitionBy("fp", "edge")) < place
    heads = found.where("edge IS NOT NULL").select("doc_id", "part", F.when(earlier, F.col("mask").bitwiseOR(again)).otherwise(F.col("mask")).alias("mask"))
    return found.where("edge IS NULL").select("doc_id", "part", "mask").unionByName(heads)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows n, good and toxic of each part and mask: additive, so counters of other tables may be added."""
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("·good"), F.max((F.col("toxic") == 1).cast("int")).alias("·toxic"))
    both = masks.join(marked, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("·good"), F.lit(0)).alias("good"), F.coalesce(F.sum("·toxic"), F.lit(0)).alias("toxic"))


def orders(counted: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters and every step in it, from counters."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    places = [("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k])) for p in permutations(letters) for k, c in enumerate(p)]
    place = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("filter_order", "step", "bit", "before"), strict=True))) for r in places)))
    x = counted.select("part", "mask", "n", "good", "toxic", place.alias("at")).select("*", "at.*")
    failed, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    out = x.groupBy("part", "filter_order", "step", "bit").agg(
        count("n", ~failed & ~gone).alias("kept"), count("n", failed & ~gone).alias("removed"), count("n", failed & gone).alias("redundant"),
        count("n", F.col("mask") == F.col("bit")).alias("unique_fails"), count("good", failed & ~gone).alias("good_lost"), count("toxic", failed & ~gone).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty; null parts count as the empty part; a null doc_id is smaller than all others and has no labels.
    Repeated rows count each; rows with the same doc_id and text are no duplicates of each other, and all of them meet in one
    task; of copies, those with a doc_id above the smallest are. Very long texts are read whole, one at a time. A document
    with several rows of labels is good or toxic if any says so. Other columns are ignored. A part has all its orders and
    steps, zeros included; an empty table has no part and no rows.
    """
    return orders(counters(failures(docs, part, filters), labels), "".join(filters) + DUPLICATE)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: DuckDB's form over `documents` and `labels`.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x g ON g.c NOT IN (a.c, b.c) JOIN x h ON h.c NOT IN (a.c, b.c, g.c) JOIN x i ON i.c NOT IN (a.c, b.c, g.c, h.c)),
s AS (SELECT filter_order, step, x.bit, coalesce((SELECT sum(y.bit) FROM x y WHERE contains(substr(filter_order, 1, step - 1), y.c)), 0)::INT AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o) JOIN x ON x.c = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
