"""The pipeline's stages one by one, and the registered queries."""

import re

import corpus_pipeline as cp
from basketflow.llm import decontaminate, ngram_join, pii, toxicity
from basketflow.llm.common import table, written
from basketflow.llm.registered import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    lexicon = toxicity.learn(docs, table(spark, SF, "labels"))
    want = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.scan(d, lexicon).where("predicted = 0").collect()},
        "ngram_jaccard": lambda d: {r.component_id for r in ngram_join.scan(d).collect()},
        "decontamination": lambda d: {r.doc_id for r in decontaminate.scan(d, table(spark, SF, "benchmark")).where("not contaminated").collect()},
        "pii": lambda d: {r.doc_id for r in d.collect()},
    }
    columns = docs.dtypes
    for name, stage in cp.STAGES[:-1]:
        after = written(stage(spark, docs, SF), "test")
        assert after.dtypes == columns
        assert {r.doc_id for r in after.collect()} == want[name](docs) and after.count() == len(want[name](docs))
        if name == "pii":
            assert all(r.n_chars == len(r.text) and not any(pii.detect(r.text).values()) for r in after.collect())
        else:
            before = {r.doc_id: r for r in docs.collect()}
            assert all(r == before[r.doc_id] for r in after.collect())
        docs = after
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_stages_with_awkward_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, None, "s", 1), (1, text, None, "s", 1), (2, text, "en", None, None), (None, text, None, None, None), (3, None, None, None, None), (4, "", "", "", 0)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in cp.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "test")
        assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted([("1", text), ("None", text), ("3", None), ("4", "")] if rows else [])
        cp.STAGES[-1][1](spark, docs, SF).collect()


def test_stages_with_clashing_columns_and_texts_that_share_an_id(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    names = ("score", "predicted", "held_out", "rest", "digest", "key", "of_doc", "spans", "n_words")
    rows = [(1, one, *names), (1, other, *names), (1, other + " more", *names), (2, one, *names), (3, other, *names)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    columns = docs.dtypes
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.dtypes == columns
    left = docs.collect()
    assert len(left) == 2 and all(r.doc_id == 1 and tuple(r)[2:] == names for r in left)
    assert {r.text.split()[0] for r in left} == {"a0", "b0"}


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert list(cp.PIPELINE_QUERIES) == ["pipeline"]
