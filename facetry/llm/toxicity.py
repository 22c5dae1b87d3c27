"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (3 to 5) inside its words, each word between two blanks, present or not. A
feature's scale is its log-count ratio between toxic and other training texts, 0 where that may be chance; logistic
regression with an L2 penalty is fitted on the scaled features. How many deviations from 0 are no chance is chosen from
SURE by the loss on FOLDS folds inside the training texts. Training texts are a bounded sample of the labelled ones
(MOST_TRAINED of each class, by the hash of doc_id); scoring reads every text whole.

Features are counted by fold on the cluster. Only those that the loosest choice keeps in some fit come to the driver: DIM
counts at most, and of each training text its features among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Texts, U, batch_of, crc_mod, cut, map_arrow, mix, read, steps

ORDERS = (3, 4, 5)
#: Hashed features; also the length of what is broadcast.
DIM = 1 << 19
#: Training texts of each class at most.
MOST_TRAINED = 3000
#: Smoothing of counts, L2 penalty, steps, and steps of the fits that only choose.
ALPHA, PENALTY, ITERATIONS, SHORT = 1.0, 1e-3, 500, 120
#: Deviations that a log-count ratio must be from zero, to choose from, and folds to choose by.
SURE, FOLDS = (2.0, 3.0, 4.0, 5.0), 3
_TABLE = np.random.default_rng(20240503).integers(0, 2**64, 256, dtype=U) | U(1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, and the index of each text's first."""
    t = Texts(column)
    w = t.words(SPACE_WORDS)
    n = len(t)
    # each distinct word of a text once
    key = mix(w.hash + w.doc.astype(U) * U(0xC2B2AE3D27D4EB4F))
    one = np.sort(np.unique(key, return_index=True)[1])
    start, length, doc = w.start[one], (w.end - w.start)[one], w.doc[one]
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    size = length + 2
    at = np.cumsum(size) - size
    body = np.full(int(size.sum()), 32, np.uint8)
    inner = np.arange(int(length.sum())) + np.repeat(at + 1 - (np.cumsum(length) - length), length)
    low = t.runs(start, length)
    body[inner] = np.where((low >= 65) & (low <= 90), low + 32, low)
    v = _TABLE[body]
    word = np.repeat(np.arange(len(size)), size)
    ids, docs = [], []
    for k in ORDERS:
        m = len(v) - k + 1
        if m <= 0:
            continue
        h = np.zeros(m, U)
        for j in range(k):
            h = h * U(0x9FB21C651E98DF25) + v[j : m + j]
        whole = np.flatnonzero(word[:m] == word[k - 1 :])
        ids.append((mix(h[whole] + U(k)) & U(DIM - 1)).astype(np.int64))
        docs.append(doc[word[whole]])
    both = np.unique(np.concatenate(docs) * DIM + np.concatenate(ids))
    return both % DIM, np.searchsorted(both, np.arange(n + 1) * DIM)


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, held_out: int = 5) -> DataFrame:
    """fold, toxic and text of the training texts: rows whose crc32(doc_id) is not divisible by held_out, `most` of each class.

    Of several texts of one doc_id the one of least hash is taken; of contradicting labels the larger.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(held_out) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = None
    for value in (0, 1):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        taken = part if taken is None else taken.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # 2 * most ids at most
    one = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), F.col("toxic").cast("int").alias("toxic"), "text")


def counted(texts: DataFrame) -> DataFrame:
    """id and, by fold, the toxic (p0, ...) and other (q0, ...) training texts that have the feature."""

    def run(batches):
        for b in steps(batches):
            ids, off = features(b.column("text"))
            which = np.repeat(b.column("fold").to_numpy() + FOLDS * (1 - b.column("toxic").to_numpy()), np.diff(off))
            key, n = np.unique(ids * 2 * FOLDS + which, return_counts=True)
            yield batch_of(id=pa.array((key // (2 * FOLDS)).astype(np.int32)), which=pa.array((key % (2 * FOLDS)).astype(np.int32)), n=pa.array(n))

    names = [f"{c}{k}" for c in "pq" for k in range(FOLDS)]
    rows = map_arrow(texts, run, "id int, which int, n long")
    return rows.groupBy("id").agg(*[F.sum(F.when(F.col("which") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(names)])


def ratios(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios of features that p of pos toxic and q of neg other texts have, and their deviations from 0."""
    p, q = p + ALPHA, q + ALPHA
    ratio = np.log(p / (pos + 2 * ALPHA)) - np.log(q / (neg + 2 * ALPHA))
    return ratio, np.abs(ratio) / np.sqrt(1 / p + 1 / q)


def train(y: np.ndarray, row: np.ndarray, column: np.ndarray, ratio: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights per column (scale included), and the intercept behind them. row and column: the features that texts have."""
    n, pos = len(y), int(y.sum())
    used = ratio[column] != 0
    row, column = row[used], column[used]
    x = ratio[column]
    # accelerated gradient descent
    square = np.bincount(row, weights=x * x, minlength=n) + 1
    rate = 4.0 / (square.mean() + 4 * PENALTY)
    b = old = np.zeros(len(ratio) + 1)
    b[-1] = np.log((pos + 1) / (n - pos + 1))
    for k in range(iterations):
        z = b + (k / (k + 3)) * (b - old)
        s = np.bincount(row, weights=x * z[column], minlength=n) + z[-1]
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / n
        grad = np.append(np.bincount(column, weights=x * g[row], minlength=len(ratio)) + PENALTY * z[:-1], g.sum())
        old, b = b, z - rate * grad
    return np.append(b[:-1] * ratio, b[-1])


def chosen(y: np.ndarray, fold: np.ndarray, row: np.ndarray, column: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    """The limit of SURE with the least loss on the folds, each judged by fits on the others; the largest of equal ones."""
    loss = dict.fromkeys(sorted(SURE, reverse=True), 0.0)
    for k in range(FOLDS):
        rest = fold != k
        pos, neg = int(y[rest].sum()), int((1 - y[rest]).sum())
        if not pos or not neg or rest.all():
            continue
        ratio, sure = ratios(np.delete(p, k, axis=0).sum(axis=0), np.delete(q, k, axis=0).sum(axis=0), pos, neg)
        mine = rest[row]
        place = np.cumsum(rest) - 1
        for limit in loss:
            w = train(y[rest], place[row[mine]], column[mine], np.where(sure < limit, 0.0, ratio), SHORT)
            s = np.bincount(row[~mine], weights=w[column[~mine]], minlength=len(y))[~rest] + w[-1]
            loss[limit] += float(np.logaddexp(0, np.where(y[~rest] == 1, -s, s)).sum())
    return min(loss, key=loss.get)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, held_out: int = 5) -> tuple[np.ndarray, float]:
    """Weights per feature and the intercept; zeros and the smoothed base rate if a class is missing."""
    texts = cut(sample(docs, labels, most, held_out), "training")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    pos, neg = (np.array([sizes.get((k, v), 0) for k in range(FOLDS)]) for v in (1, 0))
    weights = np.zeros(DIM, np.float32)
    if not pos.sum() or not neg.sum():
        return weights, float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
    got = counted(texts).toPandas()  # DIM rows at most
    p, q = (got[[f"{c}{k}" for k in range(FOLDS)]].to_numpy(float).T for c in "pq")
    ratio, sure = ratios(p.sum(axis=0), q.sum(axis=0), pos.sum(), neg.sum())
    some = sure >= min(SURE)
    for k in range(FOLDS):
        some |= ratios(p.sum(axis=0) - p[k], q.sum(axis=0) - q[k], pos.sum() - pos[k], neg.sum() - neg[k])[1] >= min(SURE)
    kept = got["id"].to_numpy()[some]
    at = np.full(DIM, -1, np.int32)
    at[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        place = shared.value
        for b in steps(batches):
            ids, off = features(b.column("text"))
            mine = place[ids] >= 0
            ends = np.concatenate([[0], np.cumsum(mine)])[off]
            yield batch_of(fold=b.column("fold"), toxic=b.column("toxic"), ids=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[ids[mine]])))

    rows = map_arrow(texts, run, "fold int, toxic int, ids array<int>").toArrow().combine_chunks()  # 2 * most rows at most, of chosen features
    lists = pa.concat_arrays(rows.column("ids").chunks)
    row, column = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten(), np.int64)
    y = rows.column("toxic").to_numpy().astype(float)
    limit = chosen(y, rows.column("fold").to_numpy(), row, column, p[:, some], q[:, some])
    w = train(y, row, column, np.where(sure[some] < limit, 0.0, ratio[some]))
    weights[kept] = w[:-1]
    return weights, float(w[-1])


def score(docs: DataFrame, weights: np.ndarray, intercept: float, held_out: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts have no features and get the intercept's score; very long texts are read whole; a score of exactly 0.5
    counts as toxic; a null doc_id counts as empty text in the fold; repeated rows get equal scores; other columns are not
    read, so names cannot clash; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w = shared.value
        for b in steps(batches):
            ids, off = features(b.column("text"))
            c = np.concatenate([[0.0], np.cumsum(w[ids], dtype=np.float64)])
            s = 1 / (1 + np.exp(-np.clip(c[off[1:]] - c[off[:-1]] + intercept, -500, 500)))
            yield batch_of(doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)))

    return map_arrow(docs.select("doc_id", (crc_mod(held_out) == 0).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, *fit(docs, read(spark, sf_dir, "labels")))
