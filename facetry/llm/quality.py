"""Quality rules: base limits on each text, then robust multivariate outliers per language and source.

Each text gives a vector of six transformed statistics. For each group (language and source), each language and the whole
table a minimum-covariance-determinant estimate is made by deterministic concentration steps over all its documents: the
share H of rows nearest by Mahalanobis distance gives the next mean and covariance, until the determinant no longer shrinks.
There are two starts, the mean and covariance of all rows and the medians and spreads by median deviations; the end of
smaller determinant is taken. Equal vectors of a group count once, so that no number of copies makes an estimate; of
different ones a cluster of up to 1 - H of a group is left out, but not a larger one.

A covariance's eigenvalues, in units of the spread of all the group's rows, are BOUND at least: statistics that are equal in
nearly all texts must not reject the few others. An estimate from n rows is mixed with its parent's (group, language, table,
and for the table the plain mean and covariance) in the proportion of n to BORROW, at every size.

Everything is sums of integers grouped on the cluster; only a row per group is ever small enough to matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SAME, SPACE_WORDS, Texts, U, batch_of, cut, hash_runs, map_arrow, mix, parts, read, steps

P = 6
#: Statistics are counted in this share of a unit, so that sums are exact, and are this large at most (logarithms and shares
#: are not larger): so longs hold the sums of squares of 10 ** 11 rows.
UNIT, MOST = 256, 32
#: Least eigenvalue of a covariance, as a share of what all rows of the group have.
BOUND = 0.05
H = 0.75
#: Concentration steps before the first look at the determinants; one less between later looks.
STEPS = 4
#: A determinant (logarithm) that falls by less has stopped.
STILL = 1e-9
#: Rows that an estimate's parent counts for.
BORROW = 100
#: Share of a normal sample beyond the limit. Real statistics have longer tails, hence so small.
TAIL = 1e-9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"x{i} long" for i in range(P))

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[list(b".,;:!?'()-\"")] = 1


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The contract's counts of each text, and its vector in units of 1/UNIT."""
    t = Texts(column)
    w = t.words(SPACE_WORDS, SAME)
    n = w.count.astype(np.int64)
    inside = SPACE_WORDS[t.data]
    chars, symbols, upper, marks = t.sums(inside & _CHAR[t.data]), t.sums(_SYMBOL[t.data]), t.sums(_UPPER[t.data]), t.sums(_MARKS[t.data])
    other = np.unique(mix(w.hash + w.doc.astype(U) * U(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
    distinct = np.bincount(w.doc[other], minlength=len(t))

    # lines with a word, and those equal to an earlier one of the same text
    starts, length, doc = t.lines()
    h = hash_runs(t.runs(starts, length), length)
    lines = np.bincount(doc, minlength=len(t))
    first = np.unique(mix(h + doc.astype(U) * U(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
    dup = lines - np.bincount(doc[first], minlength=len(t))

    # words in windows of three that occur at least twice in their text
    g, at = w.grams(3)
    _, inverse, times = np.unique(mix(g + w.doc[at].astype(U) * U(0xC2B2AE3D27D4EB4F)), return_inverse=True, return_counts=True)
    hit = np.zeros(len(w.hash) + 3, bool)
    again = at[times[inverse] > 1] if len(at) else at
    for j in range(3):
        hit[again + j] = True
    c = np.concatenate([[0], np.cumsum(hit[: len(w.hash)])])
    repeat = c[w.off[1:]] - c[w.off[:-1]]

    some = np.maximum(n, 1)
    x = (np.log(some), np.log(np.maximum(chars, 1) / some), np.log1p(100 * symbols / some), distinct / some, np.sqrt(marks / some), np.sqrt(upper / np.maximum(chars, 1)))
    return dict(zip(COUNTS, (n, chars, symbols, dup, repeat), strict=True)) | {f"x{i}": np.rint(np.minimum(v, MOST) * UNIT).astype(np.int64) for i, v in enumerate(x)}


def with_stats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and the statistics; text itself need not be carried."""
    taken = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema if f.name in carry)

    def run(batches):
        for b in steps(batches):
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c in carry} | {k: pa.array(v) for k, v in text_stats(b.column("text")).items()})

    return map_arrow(taken, run, f"{schema}, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _chi2_cdf(x: float, k: int) -> float:
    """For an even k."""
    term, total = 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if _chi2_cdf((lo + hi) / 2, k) < q else (lo, (lo + hi) / 2)
    return hi


#: By this the covariance of the nearest share H of a normal sample is too small.
CONSISTENT = H / _chi2_cdf(chi2_quantile(H, P), P + 2)
LIMIT = chi2_quantile(1 - TAIL, P)
#: A normal spread by its median deviation.
MAD = 1.4826
#: What an estimate is of: level 0 is a language and source, 1 a language, 2 the table; start until the best is taken.
GROUP = ["level", "lang", "source"]
KEYS = [*GROUP, "start"]


def levels(rows: DataFrame) -> DataFrame:
    """Each row once for each level."""
    at = [F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, lang, source in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit("")), (2, F.lit(""), F.lit("")))]
    return rows.select(F.explode(F.array(*at)).alias("at"), *[f"x{i}" for i in range(P)]).select("at.*", *[f"x{i}" for i in range(P)])


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the group's columns mean and inv."""
    d = [F.col(f"x{i}") / F.lit(float(UNIT)) - F.col("mean")[i] for i in range(P)]
    return sum((F.col("inv")[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def bounded(cov: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The covariance with eigenvalues of at least BOUND, in units of the spread (a variance for each statistic)."""
    unit = np.sqrt(np.outer(spread, spread))
    w, v = np.linalg.eigh(cov / unit)
    return (v * np.maximum(w, BOUND)) @ v.T * unit


EST = "level int, lang string, source string, start int, mean array<double>, inv array<double>, logdet double, n long, spread array<double>"
_EST_TYPES = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.list_(pa.float64()))


def _estimates(rows, scale: float) -> list[tuple]:
    """EST's columns of each group from its sums; spread comes from these where it is not given."""
    out = []
    for r in rows:
        n = r["n"]
        m = np.array([int(r[f"s{i}"]) / n for i in range(P)]) / UNIT
        s = np.empty((P, P))
        for i in range(P):
            for j in range(i, P):
                exact = int(r[f"c{i}{j}"]) * n - int(r[f"s{i}"]) * int(r[f"s{j}"])
                s[i, j] = s[j, i] = exact / n / n / UNIT / UNIT * scale
        spread = np.array(r.get("spread") or np.maximum(np.diag(s), UNIT**-2.0))
        s = bounded(s, spread)
        out.append((r["level"], r["lang"], r["source"], r["start"], m.tolist(), np.linalg.inv(s).ravel().tolist(), float(np.linalg.slogdet(s)[1]), n, spread.tolist()))
    return out


SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i, P)]]


def _partial(batches):
    """SUMS of each group's rows in a batch."""
    for b in batches:
        code = np.zeros(b.num_rows, np.int64)
        for k in KEYS:
            e = b.column(k).dictionary_encode()
            code = code * (len(e.dictionary) + 1) + e.indices.to_numpy()
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        x = np.stack([b.column(f"x{i}").to_numpy() for i in range(P)], axis=1)[order]
        at = np.searchsorted(group[order], np.arange(len(first)))
        sums = [np.bincount(group), *[np.add.reduceat(x[:, i], at) for i in range(P)], *[np.add.reduceat(x[:, i] * x[:, j], at) for i in range(P) for j in range(i, P)]]
        yield pa.RecordBatch.from_pydict({k: b.column(k).take(pa.array(first)) for k in KEYS} | dict(zip(SUMS, map(pa.array, sums), strict=True)))


def _moments(df: DataFrame, scale: float, spreads: DataFrame | None = None) -> DataFrame:
    each = map_arrow(df.select(*KEYS, *[f"x{i}" for i in range(P)]), _partial, "level int, lang string, source string, start int, " + ", ".join(f"{c} long" for c in SUMS))
    grouped = each.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    if spreads is not None:
        grouped = grouped.join(spreads, GROUP)

    def run(batches):
        for b in batches:
            cols = _estimates(b.to_pylist(), scale)
            names = [x.split()[0] for x in EST.split(", ")]
            yield pa.RecordBatch.from_pydict({k: pa.array([c[i] for c in cols], t) for i, (k, t) in enumerate(zip(names, _EST_TYPES, strict=True))})

    return map_arrow(grouped, run, EST)


def _nearest(df: DataFrame, est: DataFrame) -> DataFrame:
    """The share H of each group's rows by distance, with all ties of the last distance class (1/64 of an octave)."""
    d = df.join(est.select(*KEYS, "mean", "inv"), GROUP).withColumn("bin", F.floor(F.log2(distance() + 1e-6) * 64).cast("int")).drop("mean", "inv")
    bins = d.groupBy(*KEYS, "bin").count()
    # classes of one group: some thousands at most, as a distance has few octaves
    found = bins.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("b"), F.sum("count").alias("n"))
    need = F.ceil(F.col("n") * H)
    last = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin")), lambda a, x: F.struct((a["seen"] + x["count"]).alias("seen"), F.when(a["seen"] < need, x["bin"]).otherwise(a["bin"]).alias("bin")))
    # a table, of known size: rows stay where they are, so that no group gathers in a task
    return d.join(cut(found.select(*KEYS, last["bin"].alias("last")), "last"), KEYS).where("bin <= last").drop("bin", "last")


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """Per group n and the median of each value (name0, name1, ...), from counts by value: few rows of a group ever meet in a task."""
    one = rows.select(*GROUP, F.posexplode(F.array(*values)).alias("i", "x"))
    counts = one.groupBy(*GROUP, "i", "x").agg(F.count(F.lit(1)).alias("n"))
    # values of one statistic: MOST * UNIT at most, twice that for distances from a median
    bars = counts.groupBy(*GROUP, "i").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("b"), F.sum("n").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("x"))
    place = lambda k: F.aggregate("b", start, lambda a, e: F.struct((a["seen"] + e["n"]).alias("seen"), F.when(a["x"].isNull() & (a["seen"] + e["n"] > k), e["x"].cast("double")).otherwise(a["x"]).alias("x")))["x"]
    middle = (place(F.floor((F.col("n") - 1) / 2)) + place(F.floor(F.col("n") / 2))) / 2
    found = bars.select(*GROUP, "i", "n", middle.alias("m"))
    return found.groupBy(*GROUP).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"{name}{i}") for i in range(P)])


def _middles(rows: DataFrame, spreads: DataFrame) -> DataFrame:
    """Medians and, from median deviations, spreads of each group, which a cluster of less than half its rows cannot move far."""
    med = cut(_medians(rows, [F.col(f"x{i}") for i in range(P)], "m"), "medians")
    off = cut(_medians(rows.join(med, GROUP), [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(P)], "d").drop("n"), "deviations")
    var = [F.greatest(F.pow(F.col(f"d{i}") * F.lit(MAD / UNIT), F.lit(2.0)), F.col("spread")[i] * BOUND) for i in range(P)]
    mean = F.array(*[F.col(f"m{i}") / F.lit(float(UNIT)) for i in range(P)])
    inv = F.array(*[1 / var[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    return med.join(off, GROUP).join(spreads, GROUP).select(*GROUP, F.lit(1).alias("start"), mean.alias("mean"), inv.alias("inv"), sum(map(F.log, var), F.lit(0.0)).alias("logdet"), "n", "spread")


def _lower(new: DataFrame, old: DataFrame) -> DataFrame:
    """Of each group and start the estimate of smaller determinant, and whether that is the new one; what has stopped has no new one."""
    both = old.alias("b").join(new.alias("a"), KEYS, "left")
    fell = F.coalesce(F.col("a.logdet") < F.col("b.logdet") - STILL, F.lit(False))
    return both.select(*KEYS, *[F.when(fell, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("mean", "inv", "logdet", "n")], fell.alias("fell"))


def concentrate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per level, lang and source the plain estimate, and the one of smaller determinant of those that both starts lead to."""
    plain = cut(_moments(rows.withColumn("start", F.lit(0)), 1.0), "plain")
    spreads = cut(plain.select(*GROUP, "spread"), "spreads")
    est = cut(plain.unionByName(_middles(rows, spreads)), "mcd")
    # a start's determinant is of other rows than a share H
    est = cut(_moments(_nearest(rows, est), CONSISTENT, spreads), "mcd").withColumn("fell", F.lit(True))
    while not est.where("fell").isEmpty():
        for _ in range(STEPS - 1):
            est = cut(_lower(_moments(_nearest(rows, est.where("fell")), CONSISTENT, spreads), est), "mcd")
    best = F.min(F.struct("logdet", "start", "mean", "inv")).alias("best")
    return plain, cut(est.groupBy(*GROUP).agg(best).select(*GROUP, "best.mean", "best.inv", "best.logdet"), "mcd")


def mixed(a: tuple, b: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a mixture: n rows as in a and BORROW as in b, with the spread between both."""
    (ma, sa), (mb, sb), w = a, b, n / (n + BORROW)
    return w * ma + (1 - w) * mb, w * sa + (1 - w) * sb + w * (1 - w) * np.outer(ma - mb, ma - mb)


def fit(stats: DataFrame) -> DataFrame:
    """lang, source, mean and inv of all groups with rows that pass the base. stats should be a table: it is read often."""
    own = stats.where(~base_failed()).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *[f"x{i}" for i in range(P)])
    # over all tasks: rows of few bytes would else be read by one, and are worked on in each step
    rows = own.distinct().repartition(parts(stats.sparkSession, 0, 1))
    plain, best = concentrate(levels(cut(rows, "rows")))
    named = lambda df, level, c: df.where(F.col("level") == level).select(*GROUP[1 : 3 - level], *[F.col(x).alias(f"{x}{c}") for x in ("mean", "inv")])
    est = best.join(plain.select(*GROUP, "n"), GROUP)
    size = lambda level: est.where(F.col("level") == level).select(*GROUP[1 : 3 - level], F.col("n").alias(f"n{level}"))
    # the table's are a row each
    table = named(best, 2, "2").crossJoin(F.broadcast(named(plain, 2, "3"))).crossJoin(F.broadcast(size(2)))
    chain = named(best, 0, "0").join(size(0), ["lang", "source"]).join(named(best, 1, "1").join(size(1), "lang"), "lang").crossJoin(F.broadcast(table))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                one = [(np.array(r[f"mean{k}"]), np.linalg.inv(np.array(r[f"inv{k}"]).reshape(P, P))) for k in range(4)]
                m, s = one[3]
                for k in (2, 1, 0):
                    m, s = mixed(one[k], (m, s), r[f"n{k}"])
                out.append((m.tolist(), np.linalg.inv(s).ravel().tolist()))
            yield batch_of(lang=b.column("lang"), source=b.column("source"), mean=pa.array([x for x, _ in out], pa.list_(pa.float64())), inv=pa.array([x for _, x in out], pa.list_(pa.float64())))

    return cut(map_arrow(chain, run, "lang string, source string, mean array<double>, inv array<double>"), "estimates")


def judge(stats: DataFrame, est: DataFrame) -> DataFrame:
    """Adds base_failed, distance (null only where no row of the language and source passes the base) and kept.

    est is a table of known size: Spark broadcasts it below its limit, and splits large groups of the join beyond it.
    """
    keyed = stats.withColumn("lang_", F.coalesce("lang", F.lit(""))).withColumn("source_", F.coalesce("source", F.lit("")))
    p = est.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "mean", "inv")
    out = keyed.join(p, ["lang_", "source_"], "left").withColumn("base_failed", base_failed()).withColumn("distance", distance())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > LIMIT, F.lit(False))).drop("lang_", "source_", "mean", "inv")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept of each row.

    Null or empty texts have no words and fail the base; very long texts are read whole, one at a time; null languages and
    sources count as empty ones; repeated rows get equal verdicts and count once in the estimates; ties of the last distance
    class all count as near; an empty table gives no rows; other columns of docs are not read, so names cannot clash.
    """
    stats = cut(with_stats(docs, ["doc_id", "lang", "source"]), "stats")
    return judge(stats, fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with docs' columns. Statistics are made again beside the text, which is never shuffled.

    Rows of null and empty texts go, as they fail the base; repeated rows stay or go together; columns of docs with names of
    results keep their values; an empty table gives no rows.
    """
    clash = [c for c in docs.columns if c in {*COUNTS, "mean", "inv", "distance", "kept", "base_failed", "lang_", "source_", *(f"x{i}" for i in range(P))}]
    named = docs.withColumnsRenamed({c: f"{c}·own" for c in clash})
    stats = cut(with_stats(named, ["lang", "source"]), "stats")
    out = judge(with_stats(named, named.columns), fit(stats)).where("kept")
    return out.select(*[F.col(f"`{c}`") for c in named.columns]).withColumnsRenamed({f"{c}·own": c for c in clash})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
