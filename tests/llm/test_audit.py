import re
from itertools import permutations

import duckdb
import pytest

from facetry.llm import audit

from .fixtures import ROWS, documents, prose


def fails(text, earlier):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
    return "".join(c for c, x in zip("ABCDE", tests, strict=True) if x)


def brute(table, labels):
    """table: (doc_id, text, part)."""
    key = lambda i: (i is not None, i or 0)
    rows = [(p or "", fails(t or "", any((u or "") == (t or "") and key(j) < key(i) for j, u, _ in table)), *labels.get(i, (0, 0))) for i, t, p in table]
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, c in enumerate(order):
                gone = [r for r in left if c in r[1]]
                out[part, "".join(order), k + 1] = [
                    len(left) - len(gone), len(gone), sum(c in r[1] for r in rows if r[0] == part) - len(gone), sum(r[:2] == (part, c) for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                left = [r for r in left if c not in r[1]]
        for c in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == c)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == c:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def labelled(spark, labels):
    return spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    labels = {1: (1, 0), 2: (1, 1), 3: (0, 1), 12: (1, 0), None: (1, 1), 99: (1, 1)}
    found = audit.audit(documents(spark), labelled(spark, labels))
    labels.pop(None)
    assert got(found) == brute([r[:3] for r in ROWS], labels)


def test_copies_over_many_ranges(spark):
    """A group of copies that fills a third of the table is cut by ranges; every copy but the smallest is a duplicate."""
    texts = ["hot copy", "", None, *(prose(k, 260) for k in range(3)), "UPPER $"]
    table = [(k * 7919 % 2003, texts[0 if k % 3 == 0 else k % 7], "ab"[k % 2]) for k in range(900)] + [(None, "hot copy", None), (-1, "hot copy", "a"), (-1, "hot copy", "a")]
    labels = {i: (i % 2, i % 3 == 0) for i, _, _ in table if i is not None and i % 5}
    labels = {i: (int(a), int(b)) for i, (a, b) in labels.items()}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert got(audit.audit(spark.createDataFrame(table, "doc_id long, text string, lang string"), labelled(spark, labels))) == brute(table, labels)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """Fingerprints only order the rows: with all of them equal, full texts still decide, across ranges too."""
    real = audit.F.xxhash64
    monkeypatch.setattr(audit.F, "xxhash64", lambda c: real(c) * 0)
    table = [(k, f"text {k % 11}", "a") for k in range(300)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masks = audit.failures(spark.createDataFrame(table, "doc_id long, text string, lang string"))
        assert {r["doc_id"] for r in masks.where("mask < 16").collect()} == set(range(11)) and masks.count() == 300
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty_table(spark):
    assert audit.audit(documents(spark, []), labelled(spark, {1: (1, 1)})).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = audit.op11_filter_audit(spark, d)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({audit.SQL})").fetchall())
