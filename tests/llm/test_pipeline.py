"""All stages in sequence, on planted cases, against what each must do to them."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from facetry.llm import tokens

from .fixtures import prose


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))


def test_pipeline_on_planted_cases(spark, tmp_path):
    clean = {i: prose(100 + i, 80 + i) for i in range(60)}
    passage = prose(900, 72)  # six lines
    item = prose(901, 40, 100)
    docs = dict(clean)
    docs[100] = clean[3]  # an exact copy
    docs[101] = clean[4].replace(clean[4].split()[60], "changed1", 1)  # a near copy
    docs[102] = prose(500, 60) + "\n" + passage + "\n" + prose(501, 60)
    docs[103] = prose(502, 60) + "\n" + passage + "\n" + prose(503, 60)  # a passage that repeats
    docs[104] = prose(504, 100) + " " + item  # benchmark text
    docs[105] = " ".join(x + "###$$$" for x in prose(505, 120).split())  # junk
    docs[106] = None
    docs[107] = "too short"
    write(spark, tmp_path / "documents.parquet", [(i, t, "en", "a", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path / "benchmark.parquet", [("q1", item)], "item_id string, text string")

    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, found, str(tmp_path))
        assert out.columns == found.columns
        out.write.parquet(f"{tmp_path}/{name}")
        found = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r["text"] for r in found.collect()}
    every = set(docs)
    assert set(left["quality_rules"]) == every - {105, 106, 107}
    # an exact copy's lines are all later ones; of the near copy and of the second passage those go that repeat
    assert set(left["line_dedup"]) == every - {100, 105, 106, 107}
    assert passage in left["line_dedup"][102] and not set(passage.split("\n")) & set(left["line_dedup"][103].split("\n"))
    assert all(left["line_dedup"][i] == clean[i] for i in clean)
    assert set(left["near_dedup"]) <= set(left["line_dedup"]) and set(clean) <= set(left["near_dedup"])
    assert set(left["near_dedup"]) - set(left["decontamination"]) == {104}

    model = Tokenizer.from_file(tokens.vocabulary())
    want = []
    for i, t in left["decontamination"].items():
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
