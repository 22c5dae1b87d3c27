"""Katz backoff language model: bigrams backing off to unigrams, and those to one class of unknown words.

Counts are discounted by Good-Turing (counts up to 5, from the counts of counts of all training texts; larger counts lose
what a count of 5 loses, so that every context keeps mass to give away). A context's backoff weight is the mass left by its
seen words over the unigram mass of the words not seen after it, so each context's distribution sums to one exactly:

    P(w | v) = d(c(vw)) / c(v)                if c(vw) > 0
             = alpha(v) * P1(w)               else; P1(w) alone where v itself is unknown

Word tables are partitioned by word hash, and tokens are sent to their tables: those of all texts, with their contexts,
first to the table of the predicted word, which knows c(w) and c(vw); a seen pair adds log d(c(vw)) to its text, and each
word, as the context of the next, -log c(w). Unseen pairs go on with c(w) to the table of v, where v's seen words meet, as
numbers of words of each discounted count and sums of the larger ones. These whole numbers give seen mass, unigram mass and
so alpha(v) without loss on the way. What travels are compressed blocks of many tokens, so that a shuffle holds some bytes a
token; a table's partition is bounded by the number of partitions, which follows the text's size. Words that fill over a
quarter of their partition (four a partition at most, found with the counts of counts) are hot: the occurrences of a hot
word are dealt by the pair (v, w), and its count goes to all tasks.

No sender makes a row for each partition: beyond `FAN` partitions an exchange takes several hops, each to at most about `FAN`
ranges of partitions (see `Routes`), so the rows grow with the tokens and not with senders times partitions.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Texts, U, crc_mod, map_arrow, mix, read, steps

CUTOFF = 5
#: The order under which hot words are listed beside the counts of counts.
HOT = 0
END, START = U(0x452821E638D01377), U(0xBE5466CF34E90C6C)
#: Text of one block, and text for each partition of the tables.
BLOCK_BYTES, PART_BYTES = 16 << 20, 16 << 20
#: Ranges of partitions that a sender serves in one hop.
FAN = 1024


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    body, head = [], [len(arrays)]
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        z = squeeze.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""
        head += [ord(a.dtype.kind), a.itemsize, len(a), len(z)]
        body.append(z)
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 4 * n, 8).reshape(n, 4)
    at, out = 8 + 32 * n, []
    loose = zstandard.ZstdDecompressor()
    for kind, item, length, size in head.tolist():
        raw = loose.decompress(blob[at : at + size]) if length else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, length).T).view(f"<{chr(kind)}{item}").ravel() if length else np.zeros(0, f"<{chr(kind)}{item}"))
        at += size
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=U(0)) if len(ascending) else ascending


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """The partition of a hash; it does not fall as the hash grows."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9FB21C651E98DF25) + mix(w + U(0x632BE59BD9B4E019)))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at the wanted keys (ascending keys), 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def sequences(batches, held_column: bool, block: int):
    """Blocks of texts as (rows, held out, words of each text, words)."""
    rows, held, counts, words, size = [], [], [], [], 0
    for b in steps(batches):
        t = Texts(b.column("text"))
        w = t.words(SPACE_WORDS)
        rows.append(b.column("doc_id") if "doc_id" in b.schema.names else pa.nulls(b.num_rows))
        held.append(np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool) if held_column else np.zeros(b.num_rows, bool))
        counts.append(w.count)
        words.append(w.hash)
        size += len(t.data) + 64 * len(t)
        if size >= block:
            yield rows, np.concatenate(held), np.concatenate(counts), np.concatenate(words)
            rows, held, counts, words, size = [], [], [], [], 0
    if rows:
        yield rows, np.concatenate(held), np.concatenate(counts), np.concatenate(words)


def pairs(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, predicted word and text of each token; every text ends with END."""
    total = counts + 1
    ends = np.cumsum(total) - 1
    w = np.empty(int(total.sum()), U)
    at = np.ones(len(w), bool)
    at[ends] = False
    w[at], w[ends] = words, END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[ends - counts] = START
    return v, w, np.repeat(np.arange(len(counts), dtype=np.uint32), total)


class Discounts:
    """Good-Turing discounts of one order from its counts of counts; n[c] types have count c, of `types` and `tokens` in all."""

    def __init__(self, n: dict[int, int], types: int, tokens: int):
        self.types, self.tokens = types, tokens
        d = np.ones(CUTOFF + 1)
        n1 = n.get(1, 0)
        far = (CUTOFF + 1) * n.get(CUTOFF + 1, 0) / n1 if n1 else 0
        absolute = n1 / (n1 + 2 * n.get(2, 0)) if n1 else 0.5
        for c in range(1, CUTOFF + 1):
            r = (c + 1) * n.get(c + 1, 0) / n[c] / c if n.get(c) else 0
            d[c] = (r - far) / (1 - far) if far < 1 else 0
            if not 0 < d[c] < 1:  # too little data for Good-Turing: an absolute discount
                d[c] = 1 - absolute / c * 0.999
        self.kept = np.arange(CUTOFF + 1) * d
        self.lost = CUTOFF - self.kept[CUTOFF]
        known = {c: n.get(c, 0) for c in range(1, CUTOFF + 1)}
        many, mass = types - sum(known.values()), tokens - sum(c * k for c, k in known.items())
        self.seen = sum(k * self.kept[c] for c, k in known.items()) + mass - many * self.lost

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c <= CUTOFF, self.kept[np.minimum(c, CUTOFF)], c - self.lost)

    def classes(self, c: np.ndarray) -> list[np.ndarray]:
        """Whole numbers whose sums over words give mass() and lost_mass(): one of each count to CUTOFF, larger ones, and their counts."""
        big = c > CUTOFF
        return [*((c == k).astype(np.int64) for k in range(1, CUTOFF + 1)), big.astype(np.int64), np.where(big, c, 0)]

    def mass(self, n: list[np.ndarray]) -> np.ndarray:
        """The sum of discounted counts."""
        return sum(self.kept[k] * n[k - 1] for k in range(1, CUTOFF + 1)) + (n[-1] - self.lost * n[-2])

    def lost_mass(self, n: list[np.ndarray]) -> np.ndarray:
        """The sum of what the discounts took."""
        return sum((k - self.kept[k]) * n[k - 1] for k in range(1, CUTOFF + 1)) + self.lost * n[-2]

    def unknown(self) -> float:
        """The mass of the class of unknown words."""
        return 1 - self.seen / self.tokens if self.tokens else 1.0


TOKENS, UNSEEN, SUMS, TEXTS = range(4)


def _group(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted names of all rows, and each record's place among them; a row has names at -2 and places there at -1."""
    names = np.unique(np.concatenate([r[-2] for r in rows]))
    return names, np.concatenate([np.searchsorted(names, r[-2])[r[-1]] for r in rows]).astype(np.int64)


class Routes:
    """How records reach their group of 0 to n - 1.

    At each hop a sender makes a row for each range of `width` groups, `fan` or so of them. A range's rows are dealt over as many
    tasks as the range has groups, and these split the range further, down to single groups. So a sender makes about `fan` rows
    a hop, and each task receives about as many. Up to `fan` groups need one hop.
    """

    def __init__(self, n: int, fan: int, hot: np.ndarray, hot_counts: np.ndarray):
        self.n, self.hot, self.hot_counts = n, hot, hot_counts
        self.widths = [-(-n // fan)]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fan))

    def rows(self, p: np.ndarray, width: int, sender: int, kind: int, pick) -> list[tuple]:
        """A row for each range of groups among the ascending p; pick(a, b) gives the arrays of records a to b."""
        low = p // width * width
        cut = [*np.flatnonzero(np.diff(low, prepend=-1)), len(low)]
        salt = int(mix(np.array([sender], U))[0]) % width
        return [(int(low[a]) + salt, kind, pack(*pick(a, b))) for a, b in zip(cut, cut[1:], strict=False)]

    def counts(self, keys: np.ndarray, times: np.ndarray, width: int, sender: int, order: int) -> list[tuple]:
        return self.rows(part_of(keys, self.n), width, sender, order, lambda a, b: (deltas(keys[a:b]), times[a:b]))

    def tokens(self, w, v, doc, names, batch, width: int, sender: int) -> list[tuple]:
        route = np.where(lookup(self.hot, self.hot_counts, w) > 0, pair_key(v, w), w)
        order = np.argsort(route, kind="stable")
        w, v, doc, batch, p = w[order], v[order], doc[order], batch[order], part_of(route[order], self.n)

        def pick(a, b):
            word, place = np.unique(w[a:b], return_inverse=True)
            context, index = np.unique(v[a:b], return_inverse=True)
            used, which = np.unique(batch[a:b], return_inverse=True)
            return deltas(word), np.diff(place, prepend=0).astype(np.int32), deltas(context), index.astype(np.uint32), doc[a:b], names[used], which.astype(np.uint32)

        return self.rows(p, width, sender, TOKENS, pick)

    def unseen(self, context, known, v, doc, c1, names, batch, width: int, sender: int) -> list[tuple]:
        """Contexts with their whole numbers, and unseen pairs; context and v ascend."""
        p = [part_of(x, self.n) // width for x in (context, v)]
        ranges = np.unique(np.concatenate(p))
        (ca, va), (cb, vb) = ([np.searchsorted(x, ranges, side) for x in p] for side in ("left", "right"))

        def pick(i, _):
            at = slice(va[i], vb[i])
            used, which = np.unique(batch[at], return_inverse=True)
            return deltas(context[ca[i] : cb[i]]), *(x[ca[i] : cb[i]] for x in known), deltas(v[at]), doc[at], c1[at], names[used], which.astype(np.uint32)

        return self.rows(ranges * width, width, sender, UNSEEN, pick)

    def sums(self, doc, known, values, names, batch, width: int, sender: int) -> list[tuple]:
        """Sums per text, by the group of its block."""
        p = self.home(names)
        order = np.argsort(p, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        names, p = names[order], p[order]
        key, inverse = np.unique((rank[batch] << 32) | doc.astype(np.int64), return_inverse=True)
        batch, doc = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32)
        known, *values = (np.bincount(inverse, weights=x, minlength=len(key)) for x in (known, *values))
        known = known.astype(np.uint32)

        def pick(a, b):
            used, which = np.unique(batch[a:b], return_inverse=True)
            return doc[a:b], known[a:b], *(x[a:b] for x in values), names[used], which.astype(np.uint32)

        return self.rows(p[batch], width, sender, SUMS, pick)

    def home(self, names: np.ndarray) -> np.ndarray:
        """The group in which a block's results meet."""
        return part_of(mix(names.astype(U)), self.n)


def read_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(b) for b in blobs]
    key, inverse = np.unique(np.concatenate([np.cumsum(g[0], dtype=U) for g in got]), return_inverse=True)
    times = np.zeros(len(key), np.int64)
    np.add.at(times, inverse, np.concatenate([g[1] for g in got]).astype(np.int64))
    return key, times


def read_tokens(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """w, v, doc, names and batch."""
    got = [unpack(b) for b in blobs]
    w, v, doc = zip(*((np.cumsum(g[0], dtype=U)[np.cumsum(g[1])], np.cumsum(g[2], dtype=U)[g[3]], g[4]) for g in got), strict=True)
    return np.concatenate(w), np.concatenate(v), np.concatenate(doc), *_group(got)


def read_unseen(blobs: list[bytes]) -> tuple:
    """Contexts (ascending) with their whole numbers, v (ascending), doc, c1, names and batch."""
    got = [unpack(b) for b in blobs]
    context, i = np.unique(np.concatenate([np.cumsum(g[0], dtype=U) for g in got]), return_inverse=True)
    known = []
    for j in range(1, 2 * (CUTOFF + 2) + 1):
        n = np.zeros(len(context), np.int64)
        np.add.at(n, i, np.concatenate([g[j] for g in got]))
        known.append(n)
    v, doc, c1 = (np.concatenate(x) for x in zip(*((np.cumsum(g[-5], dtype=U), g[-4], g[-3]) for g in got), strict=True))
    names, batch = _group(got)
    order = np.argsort(v, kind="stable")
    return context, known, v[order], doc[order], c1[order], names, batch[order]


def read_sums(blobs: list[bytes]) -> tuple:
    """doc, known, values, names and batch."""
    got = [unpack(b) for b in blobs]
    doc, known, *values = (np.concatenate([g[i] for g in got]) for i in range(4))
    return doc, known, values, *_group(got)


def count_counts(training: DataFrame, n_parts: int, fan: int, block: int) -> tuple[Discounts, Discounts, np.ndarray, np.ndarray]:
    """Discounts of unigrams and of bigrams over all training texts, and the hot words and their counts."""
    routes = Routes(n_parts, fan, np.zeros(0, U), np.zeros(0, np.int64))

    def split(batches):
        for name, (_, _, counts, words) in zip(_names(), sequences(batches, False, block), strict=False):
            v, w, _ = pairs(counts, words)
            for order, keys in ((1, w), (2, pair_key(v, w))):
                key, times = np.unique(keys, return_counts=True)
                yield from _counted(routes.counts(key, times, routes.widths[0], name, order)).to_batches()

    def further(width: int):
        def run(table: pa.Table) -> pa.Table:
            q = table.column("q")[0].as_py()
            return _counted([r for order in (1, 2) if (blobs := _blobs(table, order)) for r in routes.counts(*read_counts(blobs), width, q, order)])

        return run

    def merge(table: pa.Table) -> pa.Table:
        out = {"o": [], "c": [], "types": [], "tokens": []}
        for order in (1, 2):
            blobs = _blobs(table, order)
            if not blobs:
                continue
            key, times = read_counts(blobs)
            for c in range(1, CUTOFF + 2):
                k = int((times == c).sum())
                out = {f: x + [y] for (f, x), y in zip(out.items(), (order, c, k, c * k), strict=True)}
            out = {f: x + [y] for (f, x), y in zip(out.items(), (order, 0, len(key), int(times.sum())), strict=True)}
            if order == 1:
                for i in np.flatnonzero(4 * times > times.sum()):
                    out = {f: x + [y] for (f, x), y in zip(out.items(), (HOT, i, int(key[i].view(np.int64)), int(times[i])), strict=True)}
        return pa.table({"o": pa.array(out["o"], pa.int32()), "c": pa.array(out["c"], pa.int32()), "types": pa.array(out["types"], pa.int64()), "tokens": pa.array(out["tokens"], pa.int64())})

    form = "q int, kind int, blob binary"
    rows = map_arrow(training.select("text"), split, form)
    for width in routes.widths[1:]:
        rows = rows.groupBy("q").applyInArrow(further(width), form)
    rows = rows.groupBy("q").applyInArrow(merge, "o int, c int, types long, tokens long")
    word = F.when(F.col("o") == HOT, F.col("types"))
    summed = rows.groupBy("o", F.when(F.col("o") != HOT, F.col("c")).alias("c"), word.alias("word")).agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()  # 14 rows and 4 a partition at most
    got = {(r["o"], r["c"]): (r["types"], r["tokens"]) for r in summed if r["o"] != HOT}
    hot = sorted((np.int64(r["word"]).view(U), r["tokens"]) for r in summed if r["o"] == HOT)
    one, two = (Discounts({c: got.get((o, c), (0, 0))[0] for c in range(1, CUTOFF + 2)}, *got.get((o, 0), (0, 0))) for o in (1, 2))
    return one, two, np.array([x[0] for x in hot], U), np.array([x[1] for x in hot], np.int64)


def _names():
    """Numbers of a task's blocks, the same when the task is run again."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 24)


def _blobs(table: pa.Table, kind: int) -> list[bytes]:
    return table.filter(pa.array(np.asarray(table.column("kind")) == kind)).column("blob").to_pylist()


def _counted(rows: list[tuple]) -> pa.Table:
    q, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"q": pa.array(q, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


_ROW = "q int, kind int, blob binary, block long, ids array<{kind}>, n array<long>, held array<boolean>"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    data = [c.cast(f.type) for c, f in zip(_counted(rows).columns, schema, strict=False)]
    return pa.Table.from_arrays(data + [pa.nulls(len(rows), f.type) for f in list(schema)[3:]], schema=schema)


def score(docs: DataFrame, folds: int = 7, fold: int = 2, fan: int = FAN, block: int = BLOCK_BYTES, part: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are the end alone; a very long text is a block of its own, dealt over all partitions like others; a
    null doc_id counts as empty text in the fold; repeated rows are read as often as they occur; other columns are not read, so
    names cannot clash; without training texts every word is unknown and of probability 1; an empty table gives no rows.
    `fan`, `block` and `part` size the exchanges and change no result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", (crc_mod(folds) == fold).alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part))
    one, two, hot, hot_counts = count_counts(marked.where("NOT held_out"), n_parts, fan, block)
    texts = marked.where("NOT held_out").count()
    types, tokens, unknown = one.types, one.tokens, one.unknown()
    routes = Routes(n_parts, fan, hot, hot_counts)
    schema = docs.sparkSession.createDataFrame([], _ROW.format(kind=kind)).schema

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def split(batches):
        width = routes.widths[0]
        for name, (rows, held, counts, words) in zip(_names(), sequences(batches, True, block), strict=False):
            v, w, doc = pairs(counts, words)
            doc = doc << np.uint32(1) | held[doc]
            yield from _table(routes.tokens(w, v, doc.astype(np.uint32), np.array([name]), np.zeros(len(w), np.int64), width, name), arrow).to_batches()
            ids = pa.concat_arrays(rows)
            info = [pa.array([name % n_parts]), pa.array([TEXTS]), pa.array([b""], pa.binary()), pa.array([name])]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(counts + 1, pa.int64()), pa.array(held))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(info + lists, arrow, strict=True)], schema=arrow)

    def waiting(table: pa.Table, width: int, q: int) -> pa.Table:
        """The rows of texts, sent on."""
        t = table.filter(pa.array(np.asarray(table.column("kind")) == TEXTS))
        to = routes.home(np.asarray(t.column("block"))) // width * width + int(mix(np.array([q], U))[0]) % width
        return t.set_column(0, arrow.field(0), pa.array(to, pa.int32()))

    def further(width: int):
        """A hop on the way, of records of any kind."""

        def run(table: pa.Table) -> pa.Table:
            q, out = table.column("q")[0].as_py(), []
            for what, take, send in ((TOKENS, read_tokens, routes.tokens), (UNSEEN, read_unseen, routes.unseen), (SUMS, read_sums, routes.sums)):
                blobs = _blobs(table, what)
                if blobs:
                    out += send(*take(blobs), width, q)
            return pa.concat_tables([waiting(table, width, q), _table(out, arrow)])

        return run

    def words_tables(table: pa.Table) -> pa.Table:
        q, width = table.column("q")[0].as_py(), routes.widths[0]
        passed, blobs = waiting(table, width, q), _blobs(table, TOKENS)
        if not blobs:
            return passed
        w, v, doc, names, batch = read_tokens(blobs)
        train, doc = (doc & 1) == 0, doc >> np.uint32(1)
        word, c = np.unique(w[train], return_counts=True)
        c1 = np.maximum(lookup(word, c, w), lookup(hot, hot_counts, w))
        key = pair_key(v, w)
        seen, first, c = np.unique(key[train], return_index=True, return_counts=True)
        c2 = lookup(seen, c, key)
        del key, seen
        tv, tc1 = v[train][first], c1[train][first]

        hit = c2 > 0
        s = np.where(hit, np.log10(np.where(hit, two(c2), 1.0)), 0.0)
        s -= np.where((c1 > 0) & (w != END), np.log10(np.maximum(c1, 1)), 0.0)
        base = np.log10((c1 + 1) / (tokens + types + 1))
        out = routes.sums(doc, c1 > 0, [base, s], names, batch, width, q)

        order = np.argsort(tv, kind="stable")
        tv, c, tc1 = tv[order], c[order], tc1[order]
        new = np.flatnonzero(np.concatenate([[True], tv[1:] != tv[:-1]])) if len(tv) else np.zeros(0, np.int64)
        seen_by = [np.add.reduceat(x, new) if len(new) else x[:0] for x in (*two.classes(c), *one.classes(tc1))]
        miss = np.flatnonzero(~hit)
        miss = miss[np.argsort(v[miss], kind="stable")]
        out += routes.unseen(tv[new], seen_by, v[miss], doc[miss], c1[miss].astype(np.int64), names, batch[miss], width, q)
        return pa.concat_tables([passed, _table(out, arrow)])

    def context_tables(table: pa.Table) -> pa.Table:
        q, width = table.column("q")[0].as_py(), routes.widths[0]
        blobs = _blobs(table, SUMS)
        out = routes.sums(*read_sums(blobs), width, q) if blobs else []
        blobs = _blobs(table, UNSEEN)
        if blobs:
            context, whole, v, doc, c1, names, batch = read_unseen(blobs)
            k = CUTOFF + 2
            rest = 1 - one.mass(whole[k:]) / max(tokens, 1)  # the unigram mass of words not seen after the context
            back = np.log10(np.maximum(two.lost_mass(whole[:k]), 1e-300) / np.maximum(rest, 1e-12))  # log of alpha(v) * c(v)
            p = np.log10(np.where(c1 > 0, one(c1) / max(tokens, 1), unknown))
            s = p + lookup(context, back, v)
            out += routes.sums(doc, np.zeros(len(s), bool), [np.zeros(len(s)), s], names, batch, width, q)
        return pa.concat_tables([waiting(table, width, q), _table(out, arrow)])

    def gather(table: pa.Table) -> pa.Table:
        t = table.filter(pa.array(np.asarray(table.column("kind")) == TEXTS)).sort_by("block").combine_chunks()
        ids, n, held = (pc.list_flatten(t.column(c)).combine_chunks() for c in ("ids", "n", "held"))
        start = np.cumsum(np.asarray(pc.list_value_length(t.column("ids"))))
        doc, known, values, names, batch = read_sums(_blobs(table, SUMS))
        at = np.concatenate([[0], start])[np.searchsorted(np.asarray(t.column("block")), names)][batch] + doc
        known, base, s = (np.bincount(at, weights=x, minlength=len(ids)) for x in (known, *values))
        begin = np.log10(texts) if texts else 0.0
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(s - begin)})

    form = _ROW.format(kind=kind)
    rows = map_arrow(marked, split, form)
    for table in (words_tables, context_tables, gather):
        for width in routes.widths[1:]:
            rows = rows.groupBy("q").applyInArrow(further(width), form)
        final = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        rows = rows.groupBy("q").applyInArrow(table, form if table is not gather else final)
    return rows


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
