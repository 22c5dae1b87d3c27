import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import licenses, quality

from .fixtures import BASE, ROWS, documents, prose


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) for j in range(3) if grams[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    got = quality.rules(documents(spark)).collect()
    want = sorted(((r[0], *(c := brute_counts(r[1])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in ROWS), key=str)
    assert sorted(((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in got), key=str) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few rows to prove an outlier
    assert quality.rules(documents(spark).limit(0)).collect() == []


def vectors(df):
    return {r["doc_id"]: np.array([r[f"x{k}"] for k in range(quality.P)], float) / quality.UNIT for r in quality.with_stats(df, ["doc_id"]).collect()}


def test_estimate_is_the_least_determinant_of_all_subsets(spark):
    """By enumeration of all 9 of 12 rows."""
    table = [(i, prose(100 + i, 60 + 3 * i).replace("a", "A" * (i % 3)), "en", "a") for i in range(9)]
    table += [(100 + i, "#".join(prose(300 + i, 400 + 90 * i).split(" ", 60)), "en", "a") for i in range(3)]
    df = documents(spark, table)
    rows = quality.with_stats(df, ["lang", "source"]).where(~quality.base_failed())
    best = {r["level"]: r for r in quality.concentrate(quality.levels(rows))[1].collect()}
    x = np.array(list(vectors(df).values()))
    assert len(x) == rows.count() == 12
    spread = np.maximum(x.var(axis=0), quality.UNIT**-2.0)

    def logdet(rows):
        return np.linalg.slogdet(quality.bounded(np.cov(rows.T, bias=True) * quality.CONSISTENT, spread))[1]

    least = min(logdet(x[list(c)]) for c in itertools.combinations(range(12), 9))
    assert [best[k]["logdet"] for k in range(3)] == [pytest.approx(least, abs=1e-6)] * 3


def test_medians_by_counts(spark):
    r = np.random.default_rng(2)
    x = {"a": r.integers(0, 30, (41, quality.P)), "b": r.integers(0, 9, (40, quality.P))}
    rows = spark.createDataFrame([(0, "en", s, *map(int, v)) for s, m in x.items() for v in m], "level int, lang string, source string, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    got = {g["source"]: g for g in quality._medians(rows, [F.col(f"x{i}") for i in range(quality.P)], "m").collect()}
    assert all([got[s][f"m{i}"] for i in range(quality.P)] == np.median(m, axis=0).tolist() and got[s]["n"] == len(m) for s, m in x.items())


def test_bounded_covariance():
    r = np.random.default_rng(1)
    s = np.cov(r.normal(size=(quality.P, 40)))
    assert np.allclose(quality.bounded(s, np.diag(s) * 1e-3), s)  # nothing to bound
    flat = s.copy()
    flat[2] = flat[:, 2] = 0
    got = quality.bounded(flat, np.diag(s))
    assert np.isclose(got[2, 2], quality.BOUND * s[2, 2]) and np.linalg.eigvalsh(got).min() > 0


def test_planted_outliers_of_a_fifth_of_each_group(spark):
    table = [(i, prose(100 + i, 60 + 3 * i), "en", "a") for i in range(150)]
    table += [(1000 + i, " ".join(x + "###" for x in prose(300 + i, 90).split()), "en", "a") for i in range(36)]
    table += [(2000 + i, prose(600 + i, 80 + i), "fr", f"s{i % 60}") for i in range(120)]  # sources of two rows
    df = documents(spark, table)
    got = {r["doc_id"]: r for r in quality.rules(df).collect()}
    assert all(r["distance"] is not None for r in got.values())
    assert sorted(i for i, r in got.items() if not r["kept"]) == list(range(1000, 1036))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 270


def test_distances_grow_smoothly_with_a_group(spark):
    """One row more never makes a group judged in another way."""
    odd = " ".join(x + "$$%%" for x in prose(300, 90).split())
    sizes = (5, 99, 100, 101)
    table = [(i, prose(100 + i, 60 + 3 * i), "en", "a") for i in range(200)]
    table += [(1000 * n + i, prose(500 + i, 80 + i), f"l{n}", "b") for n in sizes for i in range(n)] + [(-n, odd, f"l{n}", "b") for n in sizes]
    got = {r["doc_id"]: r["distance"] for r in quality.rules(documents(spark, table)).collect()}
    far = [got[-n] for n in sizes]
    assert all(x > quality.LIMIT for x in far) and max(far[1:]) < 1.1 * min(far[1:])


def test_a_third_of_copies_of_one_junk_text(spark):
    junk = " ".join(x + "###" for x in prose(300, 90).split())
    table = [(i, prose(100 + i, 60 + 3 * i), "en", "a") for i in range(100)] + [(1000 + i, junk, "en", "a") for i in range(50)]
    got = {r["doc_id"]: r["kept"] for r in quality.rules(documents(spark, table)).collect()}
    assert sorted(i for i in got if not got[i]) == list(range(1000, 1050))


def test_copies_do_not_reject_others(spark):
    table = [(i, BASE, "en", "a") for i in range(300)] + [(1000 + i, prose(i, 70 + i), "en", "a") for i in range(60)]
    assert all(r["kept"] for r in quality.rules(documents(spark, table)).collect())


def test_a_cluster_of_copies_is_found(spark):
    junk = " ".join(x + "###" for x in prose(300, 90).split())
    table = [(i, prose(100 + i, 60 + 3 * i), "en", "a") for i in range(150)] + [(1000 + i, junk, "en", "a") for i in range(47)]
    got = {r["doc_id"]: r["kept"] for r in quality.rules(documents(spark, table)).collect()}
    assert sorted(i for i in got if not got[i]) == list(range(1000, 1047))


def test_small_groups_are_judged(spark):
    junk = [" ".join(x + "$$$%%%###" * 3 for x in prose(300 + i, 90).split()) for i in range(2)]
    table = [(i, prose(100 + i, 60 + 3 * i), "en", "a") for i in range(150)]
    table += [(1000 + i, prose(500 + i, 80 + i).replace("a", "aeiou"), "de", "a") for i in range(20)]  # a language of few rows
    table += [(2000 + i, prose(700 + i, 80 + i), "en", "b") for i in range(10)]  # a small source of a large language
    table += [(3000, junk[0], "de", "a"), (3001, junk[1], "en", "b")]
    got = {r["doc_id"]: r for r in quality.rules(documents(spark, table)).collect()}
    assert all(r["distance"] is not None for r in got.values())
    assert sorted(i for i, r in got.items() if not r["kept"]) == [3000, 3001]


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


TEXTS = [
    "MIT License mit license, x",
    None,
    "",
    "!!",
    "Licensed under CC BY-NC 4.0. and the Apache License, Version 2.0",
    "a gnu general public license version 3 or later; see GPLv3 gpl 2",
    "cc by cc by",
    "xmit license",
    "it's cc-by; Permission is hereby\ngranted, free of charge, to any person obtaining a copy of this",
    "all rights reserved " * 40,
    "é mit license é released under the terms of the mit license",
    "neither the name of foo nor the names of its contributors may",
    "creative commons attribution non-commercial share-alike 3.0 unported",
]


def brute_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    t = f" {' '.join(w)} " if w else " "
    found = [(m.start(), -m.end(), pr, label, sure) for key, pattern, label, pr, sure in licenses.rules() if key in t for m in re.finditer(pattern, t)]
    left = [d for i, d in enumerate(sorted(found)) if not any(e[0] <= d[0] and e[1] <= d[1] for e in sorted(found)[:i])]
    score = max([d[4] for d in left] + [0.5 if base else 0.0])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[3] for d in left})), score


def test_scan_matches_brute_force(spark):
    table = [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + ROWS
    got = licenses.scan(documents(spark, table)).collect()
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(((r["text"], *(r[c] for c in cols)) for r in got), key=str) == sorted(((t[1], *brute_scan(t[1])) for t in table), key=str)
    assert licenses.scan(documents(spark).limit(0)).collect() == []


def test_rules_are_many_and_gated():
    assert len(licenses.rules()) > 300


def samples(pattern):
    """A text for each way through a rule's groups, one group at a time."""
    if m := re.search(r"\(\?:([^()]*)\)(\?)?", pattern):
        ways = m[1].split("|") + [""] * bool(m[2])
        return [x for w in ways for x in samples(pattern[: m.start()] + w + pattern[m.end() :])]
    out = [re.sub(r"\.\{1,80\}\?", "foo inc", pattern)]
    while any("?" in x for x in out):
        out = [y for x in out for y in ([x] if "?" not in x else [re.sub(r".\?", "", x, count=1), x.replace("?", "", 1)])]
    return [f" {' '.join(x.split())} " for x in out]


def test_gates_lose_nothing():
    """Each text that a rule's pattern describes holds the rule's keyword."""
    lost, seen = [], 0
    for key, pattern, label, *_ in licenses.rules():
        for text in samples(pattern.removesuffix("(?= )")):
            if re.search(pattern, text):
                seen += 1
                if key not in text:
                    lost.append((key, text, label))
    assert seen > 2000 and lost == []


def test_gated_and_ungated_agree(spark):
    forms = ["gnu library general public license v2.1", "zlib/libpng license", "Distributed under the Boost Software License, Version 1.0", "simplified BSD", "European Union Public Licence 1.2", *filter(None, TEXTS)]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(forms)])
    got, want = (sorted((r["doc_id"], r["labels"], r["score"]) for r in licenses.scan(df, table=t).collect()) for t in (None, licenses.ungated(licenses.rules())))
    assert got == want and all(r[1] for r in got[:5])


SPDX_LINES = {
    "MIT": "mit", "MIT-0": "mit-0", "0BSD": "0bsd", "Apache-2.0": "apache-2.0", "ISC": "isc", "Zlib": "zlib", "EPL-2.0": "epl-2.0", "EUPL-1.2": "eupl-1.2", "Python-2.0": "python-2", "PHP-3.01": "php-3.01",
    "PostgreSQL": "postgresql", "BSL-1.0": "boost-1.0", "BUSL-1.1": "bsl-1.1", "BSD-3-Clause": "bsd-3-clause", "MPL-2.0": "mpl-2.0", "GPL-2.0-only": "gpl-2", "GPL-2.0-or-later": "gpl-2-or-later",
    "LGPL-2.1-or-later": "lgpl-2.1-or-later", "AGPL-3.0": "agpl-3",
}


def test_spdx_lines(spark):
    table = [(i, f"// SPDX-License-Identifier: {x}\nint main() {{ return 0; }}", "en", x) for i, x in enumerate(SPDX_LINES)]
    got = {r["source"]: r for r in licenses.scan(documents(spark, table)).collect()}
    assert {x: r["labels"] for x, r in got.items()} == SPDX_LINES
    assert all(r["score"] == 1.0 for r in got.values())
