"""The near-duplicate stage with ids that repeat or are missing."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(name):
    return " ".join(f"{name}{k}" for k in range(60))


def test_stage_keeps_each_text(spark):
    rows = [(None, "a"), (None, "b"), (None, "b"), (7, "b"), (5, "c"), (5, "d"), (5, "d"), (9, "d"), (3, "e"), (4, "e")]
    docs = spark.createDataFrame([(i, text(t), "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text.split("0")[0]) for r in cp.near_dedup_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, "a"), (None, "b"), (5, "c"), (5, "d"), (3, "e")], key=str)
