"""The covered fraction in the pipeline's first stage."""

import corpus_pipeline as cp
from kelpgraph.llm import quality_rules


def test_covered_fraction_alone_rejects(spark):
    passage = " ".join(f"p{k}" for k in range(10))
    parts = [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(15)) for i in range(8)]
    rows = [(1, " ".join(parts), "en", "s", 9), (2, " ".join(f"c{k}" for k in range(200)), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = quality_rules.judge(docs).where("doc_id = 1").first()
    assert not judged.base_failed and judged.covered_words == 80 and judged.n_words == 200
    assert [r.doc_id for r in cp.quality_stage(spark, docs, "").collect()] == [2]
