import hashlib
import re

import duckdb
import pytest

from facetry.llm import fim

from .fixtures import ROWS, documents

AWKWARD = ["", None, "a", "ab", "😀é́日本🎉\r\n x", "<P>a", "a<S><M>", "<", "<P", "a<S<P M>", "x\n\n y\t\tz 12ab3. End!  Next? ", "tail ", " lead", "😀" * 300]


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "plain" if not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, len(t), form, out, *((None,) * 3 if form == "plain" else (p, m, s))


def test_code_points_against_brute_force(spark):
    table = [(i, x) for i, x in enumerate(AWKWARD * 12)] + [(None, "no id"), (3, "ab"), (3, "ab")]
    got = fim.infill(spark.createDataFrame(table, "doc_id long, text string")).withColumn("back", fim.restore("output", "form")).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "output", "prefix", "middle", "suffix")) for r in got), key=str) == sorted((brute(*x) for x in table), key=str)
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_awkward_rows_and_clashing_names(spark):
    docs = documents(spark).withColumnsRenamed({"key": "n", "labels": "form", "kept": "output"})
    got = fim.infill(docs).withColumn("back", fim.restore("output", "form")).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["output"]) for r in got), key=str) == sorted((brute(r[0], r[1])[:4] for r in ROWS), key=str)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert fim.infill(docs.limit(0)).count() == 0


@pytest.mark.parametrize("grammar, unit", [("codepoint", r"(?s)."), ("word", r"(?s)[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"), ("line", r"[^\n]*\n|[^\n]+")])
def test_pieces_of_grammars(spark, grammar, unit):
    table = spark.createDataFrame([(x,) for x in AWKWARD], "text string")
    for r in table.select("text", fim.units(table["text"], grammar).alias("u")).collect():
        assert r["u"] == re.findall(unit, r["text"] or ""), r["text"]


def test_every_grammar_keeps_the_text(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(AWKWARD * 4)], "doc_id long, text string")
    for grammar in (*fim.GRAMMARS, [("a-m", "n-z")]):
        got = fim.infill(docs, grammar).withColumn("back", fim.restore("output", "form")).withColumn("u", fim.units(docs["text"], grammar)).collect()
        assert all(r["back"] == (r["text"] or "") == "".join(r["u"]) and r["n"] == len(r["u"]) and "" not in r["u"] for r in got), grammar


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = fim.op12_fill_in_middle(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({fim.SQL})").fetchall())
