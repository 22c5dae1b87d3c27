"""Best-fit packing of token sequences through the configuration linear program over the length histogram.

The program: with n(l) pieces of each length l, choose how often to use each configuration (multiset of lengths that fits a
sequence) so that all lengths are covered with fewest sequences. Multiplicative weights solve it: a configuration's use is
the product of its lengths' weights, a length's weight is multiplied in each step by a power of need over coverage, and at
falling temperatures the uses gather on the cheapest configurations. The weights' logarithms are the lengths' prices; a
knapsack dynamic program over the capacity finds the best configuration that holds each length at those prices, and by the
best value of all it turns the prices into a lower bound on the number of sequences.

Uses are rounded down, then up in the order of what was cut off while pieces last; the program is solved again for what is
left, as long as that places pieces. Best fit, largest first, takes the last ones, fewer than there are lengths times slots
of a sequence, and takes all where that needs fewer sequences, as with uniform lengths (by 2 in 100,000 to 1 in 1,000). The driver's work
depends on the number of lengths, not of pieces: only the histogram (as many rows as the capacity) comes to it, and equal
sequences are counted together. Pieces get their places by rank within their length, counted over hash buckets so that one
hot length is dealt over many tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, map_arrow, read, steps
from .tokens import encoder, vocabulary

SIZE = 1024
END = 2
#: Temperatures of the weights; pricings and steps of the weights between two of them, at each temperature.
HEAT, PRICINGS, STEPS = (0.01, 0.003, 0.001, 0.0003, 0.0001), 12, 15
#: Part of a price by which it may be raised at random, so that pricings find different ones of equal configurations.
JITTER = 1e-3
#: Configurations of a smaller share of all uses are dropped when the temperature falls.
FADED = 1e-12
#: The program is solved again for the rest if it placed this share of the pieces at least.
PLACED = 0.1
#: Pieces for each hash bucket within a length; few pieces make buckets of fewer, up to a number of buckets.
BUCKET, FEW, BUCKETS = 100_000, 500, 64


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids with `end` behind them, and the ids themselves if wanted.

    A longer document is cut into full pieces behind a first one that takes the remainder, so full sequences stay whole.
    """
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        e = encoder(path)
        for b in steps(batches):
            rows, piece, start, length, crc, body = [], [], [], [], [], []
            for i, got in enumerate(e.ids([x or "" for x in b.column("text").to_pylist()])):
                got += last
                n = len(got) // 4
                at, k = 0, 0
                stop = n % size or size if n > size else n
                while at < n:
                    one = got[4 * at : 4 * stop]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(one))
                    body.append(one)
                    at, stop, k = stop, stop + size, k + 1
            extra = {"ids": pa.array(body, pa.binary())} if ids else {}
            yield batch_of(doc_id=b.column("doc_id").take(pa.array(rows, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), **extra)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def price(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity, and the index of a length that attains it (-1: none)."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    for c, n in enumerate(np.searchsorted(lengths, np.arange(size + 1), "right").tolist()):
        if n:
            v = value[:n] + best[c - lengths[:n]]
            i = n - 1 - int(v[::-1].argmax())  # of equal ones the longest, so that short pieces are left to fill up
            best[c], pick[c] = v[i], i if value[i] > 0 else pick[c - lengths[i]]
    return best, pick


class Pool:
    """Configurations (descending tuples of indices into lengths), and how often (times) each (conf) holds each length (item)."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.all: list[tuple[int, ...]] = []
        self.known: set[tuple[int, ...]] = set()
        self.conf = self.item = np.zeros(0, np.int64)
        self.times = np.zeros(0)

    def add(self, pick: np.ndarray) -> None:
        """For each length the best configuration that holds it."""
        cols, room = [np.arange(len(self.lengths))], self.size - self.lengths
        while (p := pick[room]).max() >= 0:
            cols.append(p)
            room = room - np.where(p >= 0, self.lengths[p], 0)
        rows = np.sort(np.stack(cols, axis=1), axis=1)[:, ::-1]
        found = dict.fromkeys(tuple(r[:n]) for r, n in zip(rows.tolist(), (rows >= 0).sum(axis=1).tolist(), strict=True))
        if new := [c for c in found if c not in self.known]:
            which = np.repeat(np.arange(len(self.all), len(self.all) + len(new)), [len(c) for c in new])
            key, times = np.unique(which * len(self.lengths) + np.concatenate(new), return_counts=True)
            self.all += new
            self.known.update(new)
            for name, more in (("conf", key // len(self.lengths)), ("item", key % len(self.lengths)), ("times", times)):
                setattr(self, name, np.concatenate([getattr(self, name), more]))

    def keep(self, which: np.ndarray) -> None:
        self.all = [c for c, k in zip(self.all, which.tolist(), strict=True) if k]
        self.known = set(self.all)
        at = which[self.conf]
        self.conf, self.item, self.times = (np.cumsum(which) - 1)[self.conf[at]], self.item[at], self.times[at]


def solve(lengths: np.ndarray, need: np.ndarray, size: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional uses of configurations (tuples of indices into lengths) that cover about `need`, and a lower bound on sequences."""
    random = np.random.default_rng(20240504)
    total = float((lengths * need).sum()) / size  # sequences without any room left, the first bound
    n = need / total
    pool = Pool(lengths, size)
    prices, bound = lengths / size, 1.0
    for heat in HEAT:
        for _ in range(PRICINGS):
            pool.add(price(np.maximum(prices, 0) * (1 + JITTER * random.random(len(n))), lengths, size)[1])
            items = np.bincount(pool.conf, pool.times)
            most = np.zeros(len(n))
            np.maximum.at(most, pool.item, items[pool.conf])
            # powers that add up to 1 at most in any configuration, so that steps of all lengths at once do not overshoot
            power = (lengths / size + 1 / most) / 2
            for _ in range(STEPS):
                use = np.exp(np.clip((np.bincount(pool.conf, pool.times * prices[pool.item]) - 1) / heat, -700, 50))
                covered = np.bincount(pool.item, pool.times * use[pool.conf], minlength=len(n)) / n
                prices = prices - heat * power * np.log(np.maximum(covered, 1e-30))
        dual = np.maximum(prices, 0)
        bound = max(bound, float((dual * n).sum()) / price(dual, lengths, size)[0][size])  # prices over the best are a dual solution
        if heat != HEAT[-1]:
            pool.keep(use > FADED)
    return dict(zip(pool.all, (use * total).tolist(), strict=True)), bound * total


def _rounded(uses: dict[tuple[int, ...], float], left: np.ndarray) -> dict[tuple[int, ...], int]:
    """Whole uses that `left` holds; their pieces are taken from it. First what is whole, then once more by what was cut off."""
    out: dict[tuple[int, ...], int] = {}
    order = sorted(uses.items(), key=lambda u: (-(u[1] % 1), u[0]))
    for whole in (True, False):
        for c, x in order:
            if k := int(x) if whole else int(x % 1 > 0.01):
                i, times = np.unique(c, return_counts=True)
                if k := min(k, int((left[i] // times).min())):
                    out[c] = out.get(c, 0) + k
                    left[i] -= k * times
    return out


def _best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Best fit, largest first, of what is left. Equal sequences are counted together and equal pieces placed together."""
    open_by: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    room = np.zeros(size + 1, bool)
    done: dict[tuple[int, ...], int] = {}
    for i in np.argsort(-lengths):
        n, long = int(left[i]), int(lengths[i])
        while n:
            fits = np.flatnonzero(room[long:])
            free = int(fits[0]) + long if len(fits) else size
            c, k = open_by[free].pop() if len(fits) else ((), n)
            each = min(free // long, n)  # a sequence stays the fullest that fits until it is full
            some = min(k, n // each)
            if len(fits):
                if k > some:
                    open_by[free].append((c, k - some))
                room[free] = bool(open_by[free])
            rest = free - each * long
            open_by[rest].append(((*c, *[int(i)] * each), some))
            room[rest] = rest > 0
            n -= some * each
    for same in open_by:
        for c, k in same:
            done[c] = done.get(c, 0) + k
    return done


def program(lengths: np.ndarray, need: np.ndarray, size: int) -> tuple[dict[tuple[int, ...], int], np.ndarray, float]:
    """Whole uses of configurations, the pieces that they leave, and the lower bound."""
    left, out, bound = need.copy(), {}, 0.0
    while before := int(left.sum()):
        live = np.flatnonzero(left)
        uses, low = solve(lengths[live], left[live].astype(float), size)
        bound = bound or low
        for c, k in _rounded({tuple(live[list(c)].tolist()): x for c, x in uses.items()}, left).items():
            out[c] = out.get(c, 0) + k
        if before - int(left.sum()) < PLACED * before:
            break
    return out, left, bound


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(lengths of a sequence, how many such sequences) that hold the histogram's pieces exactly, and a lower bound."""
    if not histogram:
        return [], 0.0
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    out, left, bound = program(lengths, need, size)
    for c, k in _best_fit(lengths, left, size).items():
        out[c] = out.get(c, 0) + k
    out = min(out, _best_fit(lengths, need, size), key=lambda x: sum(x.values()))
    return [(tuple(int(lengths[i]) for i in c), k) for c, k in sorted(out.items())], bound


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of runs of its pieces, and the sequence and offset of each run's first piece."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for c, k in sequences:
        at = 0
        for n in c:
            by.setdefault(n, []).append((used.get(n, 0), base, at))
            used[n] = used.get(n, 0) + k
            at += n
        base += k
    return {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in by.items()}


def ranked(found: DataFrame, rows: int) -> DataFrame:
    """found with rank: a number from 0 within each length."""
    deal = max(1, rows // BUCKET, min(BUCKETS, rows // FEW))
    keyed = found.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)))
    counts = keyed.groupBy("length", "deal").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1))).select("length", "deal", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    return keyed.withColumn("rank", F.row_number().over(order) - 1).join(cut(before, "before"), ["length", "deal"]).withColumn("rank", F.col("rank") + F.col("before")).drop("deal", "before")


def pack(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset.

    Null and empty texts are one piece of the end id alone; very long texts are cut into as many pieces as they need; repeated
    rows are packed as often as they occur, and ties of a rank go by the order of the columns; a null doc_id is an id like
    others; other columns are not read, so names cannot clash; an empty table gives no rows.
    """
    found = cut(pieces(docs, size, end, path, ids), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # `size` rows at most
    table = slots(plan(histogram, size)[0]) if histogram else {}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as many runs as configurations have slots, whatever the rows
    placed = ranked(found, sum(histogram.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop("rank").schema)

    def run(batches):
        by = shared.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for v in np.unique(n):
                me = n == v
                first, base, at = by[int(v)]
                i = np.searchsorted(first, rank[me], "right") - 1
                seq[me], off[me] = base[i] + rank[me] - first[i], at[i]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "rank"} | {"sequence_id": pa.array(seq), "offset": pa.array(off)})

    return map_arrow(placed, run, f"{schema}, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, "sequence_id", "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
