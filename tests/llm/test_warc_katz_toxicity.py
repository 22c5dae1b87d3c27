import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import katz, toxicity, warc
from facetry.llm.common import table_path

from .fixtures import ROWS, documents, prose

PAGES = [
    (5, "http://a/?q=1", "<html>" + "x" * 200),
    (3, "http://b/é \r\nX: y", "<html>" + "x" * 200),
    (7, None, "<html>" + "x" * 200),
    (7, None, "<html>" + "x" * 200),
    (1, "u", "short"),
    (2, "u", "short"),
    (8, "u", None),
    (9, "u", ""),
    (None, "u", "<html>" + "x" * 200),
    (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30),
    (11, "u", "é" * 50),
    (12, "u", "é" * 50),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")


def test_round_trip(spark):
    import hashlib

    got = warc.round_trip(pages(spark)).collect()
    by = {}
    for p, _, h in PAGES:
        if len((h or "").encode()) >= 100 and p is not None:
            by[h] = min(by.get(h, p), p)
    want = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if by.get(h, p) != p else "response", by[h] if by.get(h, p) != p else None) for p, _, h in PAGES]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["checked"] for r in got)
    assert all(r["html"] == next(h or "" for p, _, h in PAGES if p == r["page_id"]) for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert warc.round_trip(pages(spark).limit(0)).collect() == []


def test_digests_keep_clashing_columns(spark):
    out = warc.digests(pages(spark).withColumn("first", F.lit(5)).withColumn("n", F.lit(6)))
    assert out.count() == len(PAGES) and {(r["first"], r["n"]) for r in out.collect()} == {(5, 6)}


def test_selected_records_by_ranges(spark, monkeypatch):
    folder = table_path(spark, "warc-test")
    index = warc.write_archives(warc.digests(pages(spark, [(i, f"u{i}", prose(i, 30)) for i in range(60)])), folder)
    got = warc.read_records(index.where("page_id % 7 = 3"), folder).collect()
    assert {r["page_id"]: r["html"] for r in got} == {i: prose(i, 30) for i in range(60) if i % 7 == 3}


def test_ranges_join_neighbours():
    o, n = np.array([0, 100, 250, 10_000, 10_100]), np.array([100, 100, 50, 100, 9_000])
    assert warc.ranges(o, n, gap=60, span=1000) == [(0, 3), (3, 4), (4, 5)]
    assert warc.ranges(o, n, gap=20_000, span=10**6) == [(0, 5)]


def test_warc_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = warc.op3_warc_round_trip(spark, d)
    cols = sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({warc.SQL})").fetchall())


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


class Model:
    """The documented model, by dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = [*t, "</s>"]
            self.one.update(w)
            self.two.update(zip(["<s>", *t], w))
        count = lambda c: katz.Discounts(Counter(min(n, 99) for n in c.values()), len(c), sum(c.values()))
        self.d1, self.d2 = count(self.one), count(self.two)
        self.context, self.after = Counter(), {}
        for (v, w), n in self.two.items():
            self.context[v] += n
            self.after.setdefault(v, []).append(w)
        self.n = sum(self.one.values())

    def uni(self, w):
        return float(self.d1(np.array([self.one[w]]))[0]) / self.n if self.one[w] else self.d1.unknown()

    def alpha(self, v):
        left = 1 - sum(float(self.d2(np.array([self.two[v, w]]))[0]) for w in self.after[v]) / self.context[v]
        return left / (1 - sum(self.uni(w) for w in self.after[v]))

    def p(self, v, w):
        if self.two[v, w]:
            return float(self.d2(np.array([self.two[v, w]]))[0]) / self.context[v]
        return (self.alpha(v) if self.context[v] else 1) * self.uni(w)


TEXTS = [*ROWS, *((100 + i, prose(i, 60 + i) + " alpha1 alpha1 alpha1", "en", "a") for i in range(60)), (300, "never seen words at all", "en", "a")]


@pytest.mark.parametrize("parts", [1, 7])
def test_katz_matches_brute_force_and_is_normalised(spark, parts, monkeypatch):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    m = Model([tokens(r[1]) for r in TEXTS if not held(r[0])])
    # every context's distribution sums to one, with the class of unknown words
    for v in list(m.context)[:50]:
        assert sum(m.p(v, w) for w in m.one) + m.alpha(v) * m.d1.unknown() == pytest.approx(1)
    want = []
    for d, text, *_ in TEXTS:
        w = tokens(text)
        s = sum(math.log10(m.p(v, x)) for v, x in zip(["<s>", *w], [*w, "</s>"]))
        base = sum(math.log10((m.one[x] + 1) / (m.n + len(m.one) + 1)) for x in [*w, "</s>"])
        want.append((str(d), held(d), len(w) + 1, sum(m.one[x] > 0 for x in [*w, "</s>"]), m.n, base, s))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [(str(r[0]), *tuple(r)[1:]) for r in katz.score(documents(spark, TEXTS)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for a, b in zip(sorted(got, key=lambda r: (r[0], r[2], r[6])), sorted(want, key=lambda r: (r[0], r[2], r[6])), strict=True):
        assert a[:5] == b[:5] and a[5:] == (pytest.approx(b[5], rel=1e-12), pytest.approx(b[6], rel=1e-12))


def test_katz_in_several_hops_equals_one(spark):
    df = documents(spark, TEXTS)
    read = lambda rows: sorted(((str(r[0]), *tuple(r)[1:]) for r in rows.collect()), key=lambda r: (r[0], r[2], r[6]))
    # some 40 partitions in ranges of 14, 5, 2 and 1, from blocks of a few texts; and the default, one hop
    many, one = read(katz.score(df, fan=3, block=2000, part=4000)), read(katz.score(df))
    assert len(katz.Routes(40, 3, None, None).widths) == 4 and len(many) == len(one) == len(TEXTS)
    for a, b in zip(many, one, strict=True):
        assert a[:5] == b[:5] and a[5:] == (pytest.approx(b[5], rel=1e-12), pytest.approx(b[6], rel=1e-12))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_routes_bring_every_record_home_in_few_rows(n):
    r = katz.Routes(n, 4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys = katz.mix(np.arange(1, 5001, dtype=np.uint64))
    senders = [(i, [katz.pack(katz.deltas(np.sort(k)), np.ones(len(k), np.int64))]) for i, k in enumerate(np.array_split(keys, n))]
    for width in r.widths:
        got = {}
        for q, blobs in senders:
            rows = r.counts(*katz.read_counts(blobs), width, q, 1)
            assert len(rows) <= 4 + 1
            for to, _, blob in rows:
                got.setdefault(to, []).append(blob)
        senders = list(got.items())
    homes = {q: katz.read_counts(blobs)[0] for q, blobs in senders}
    assert all((katz.part_of(k, n) == q).all() for q, k in homes.items()) and sorted(np.concatenate(list(homes.values())).tolist()) == sorted(keys.tolist())


def test_katz_without_rows_or_training(spark):
    assert katz.score(documents(spark).limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score(documents(spark, [(only, "a b", "en", "a")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0


def test_features_match_brute_force():
    import pyarrow as pa

    texts = ["Ab abc", None, "", "é x", "ab ab AB"]
    ids, off = toxicity.features(pa.array(texts))

    def grams(t):
        out = set()
        for w in set(tokens(t)):
            b = b" " + w + b" "
            out |= {b[i : i + k] for k in toxicity.ORDERS for i in range(len(b) - k + 1)}
        return out

    # texts' n-grams have different hashes here
    assert np.diff(off).tolist() == [len(grams(t)) for t in texts]
    first = {t: set(ids[off[i] : off[i + 1]].tolist()) for i, t in enumerate(texts)}
    assert first["ab ab AB"] < first["Ab abc"]


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(r["toxic"] == r["predicted"] for r in got) / len(got)
    found = [r["predicted"] for r in got if r["toxic"] == 1]
    assert hit > 0.95 and sum(found) / len(found) > 0.7


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (11, 1), (11, 1), (None, 1), (12, None)], "doc_id long, toxic int")
    out = toxicity.score(documents(spark), *toxicity.fit(documents(spark), labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    out = toxicity.score(documents(spark), *toxicity.fit(documents(spark), labels.limit(0))).collect()
    assert {r["score"] for r in out} == {0.5}
    assert toxicity.score(documents(spark).limit(0), *toxicity.fit(documents(spark), labels.where(F.lit(False)))).collect() == []


def test_fit_agrees_with_plain_gradient_descent():
    """The fitted loss against slow steps on a dense matrix, written anew."""
    r = np.random.default_rng(3)
    x = (r.random((60, 12)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + r.normal(0, 0.5, 60) > 1).astype(float)
    ratio, sure = toxicity.ratios(x[y == 1].sum(axis=0), x[y == 0].sum(axis=0), int(y.sum()), int((1 - y).sum()))
    k = 4
    p, q = (x[y == 1][:, k].sum() + 1) / (y.sum() + 2), (x[y == 0][:, k].sum() + 1) / ((1 - y).sum() + 2)
    assert ratio[k] == pytest.approx(math.log(p / q))
    assert sure[k] == pytest.approx(abs(math.log(p / q)) / math.sqrt(1 / (x[y == 1][:, k].sum() + 1) + 1 / (x[y == 0][:, k].sum() + 1)))
    row, column = np.nonzero(x)
    w = toxicity.train(y, row, column, ratio, 4000)
    b, c = np.zeros(12), 0.0
    for _ in range(40_000):
        g = (1 / (1 + np.exp(-(x * ratio @ b + c))) - y) / 60
        b, c = b - 0.1 * ((x * ratio).T @ g + toxicity.PENALTY * b), c - 0.1 * g.sum()
    assert np.allclose(w, np.append(b * ratio, c), atol=1e-3)


def test_toxicity_from_few_labels(spark):
    """68 labelled texts are enough to tell some toxic ones."""
    d = "/root/testdata/sf0.001"
    w, _ = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert np.isfinite(w).all() and (w != 0).any()
