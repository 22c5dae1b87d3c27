import random
import re

from facetry.llm import minhash

from .fixtures import ROWS, documents


def sets(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(table):
    """(doc_id, n_shingles, component) of each row."""
    s = [sets(r[1]) for r in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), least.get(find(i)) if s[i] else r[0], r[0] == (least.get(find(i)) if s[i] else r[0])) for i, r in enumerate(table)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.groups(df).collect()), key=str)


def test_awkward_rows(spark):
    assert got(documents(spark)) == brute(ROWS)
    assert got(documents(spark, ROWS[:0] or []).limit(0)) == []


def test_loose_group_and_chain(spark):
    """A group of near copies many of whose pairs are not linked, and a chain of links."""
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    table = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        table.append((1000 + i, " ".join(w), "en", "a"))
    w = [f"c{r.randrange(500)}" for _ in range(200)]
    for i in range(25):
        for _ in range(3):
            w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
        table.append((2000 + i, " ".join(w), "en", "a"))
    r.shuffle(table)
    assert got(documents(spark, table)) == brute(table)


def test_keep_one_keeps_columns_and_a_row_of_each_group(spark):
    df = documents(spark)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15, 16]


def test_signatures_estimate_similarity():
    import numpy as np

    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    v = minhash.signatures(minhash.mix(np.concatenate([a, b])), np.array([0, 1000]))
    assert abs((v[:, 0] == v[:, 1]).mean() - 0.6) < 0.12
