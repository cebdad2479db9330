"""Very long texts, null ids, repeats and columns of clashing names, for all operators and stages."""

import hashlib
import random

import pytest
from kelpgraph.llm import language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup, topk, toxicity
from pyspark.sql import functions as F

NAMES = ["did", "key", "node", "h", "n", "at", "rep", "component_id", "score", "copies", "piece", "bin", "shard", "slot", "size", "place", "label", "x", "half", "chunk", "number", "kept", "part"]


def texts_of(result, columns):
    return sorted(map(str, result.select(*columns).collect()))


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 20 MB of distinct words, one that repeats the middle of it, and short ones."""
    words = [f"w{k * 7919 % 2_900_017}x" for k in range(2_300_000)]
    long = " ".join(words)
    assert len(long) > 19_000_000
    rows = [(1, long, "en", "src1"), (2, "head " + " ".join(words[1_000_000:1_000_500]) + " tail", "en", "src1"), (3, "a short text of seven words here", "de", "src2"), (None, None, None, None), (4, "", "fr", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()


def test_long_text_in_windows(spark, long_docs):
    got = {r.doc_id: r for r in substring_dedup.dedup(long_docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (2_300_000, 0) and (got[2].n_words, got[2].n_removed) == (502, 500)
    assert got[2].kept_sha256 == hashlib.sha256(b"head tail").hexdigest()


def test_long_text_in_the_others(spark, long_docs):
    rules = {r.doc_id: r for r in quality_rules.judge(long_docs).collect()}
    assert rules[1].n_words == 2_300_000 and rules[1].kept and rules[1].longest_repeat == 0
    groups = {r.doc_id: r for r in near_dedup.groups(long_docs).collect()}
    assert groups[1].n_shingles == 2_300_000 - 4 and groups[1].kept and groups[2].kept
    packed = packing.pack(long_docs).where("doc_id = 1").agg(F.sum("n_tokens"), F.max("bin_length")).first()
    assert tuple(packed) == (2_300_000, 8192)
    assert sharding.shard(long_docs).where("doc_id = 1").first().n_tokens == 2_300_000
    assert {r.doc_id for r in mixing.mix(long_docs).collect()} <= {1, 2, 3}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (quality_classifier.classify(long_docs, labels), toxicity.classify(long_docs, labels), language_id.identify(long_docs)):
        assert scored.count() == 5 and scored.where("score < 0 or score > 1 or score is null").isEmpty()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 30, 90]))), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", None])) for k in range(60)]
    rows += rows[:10] + [(None, t, a, b) for _, t, a, b in rows[10:20]] + [(7, "another text of that id", "en", "src1"), (None, None, None, None), (99, "", "en", "src1"), (98, None, "en", "src1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


OPERATORS = {
    "substring_dedup": lambda d, s: substring_dedup.dedup(d),
    "mixing": lambda d, s: mixing.mix(d),
    "quality_classifier": lambda d, s: quality_classifier.classify(d, s.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")).withColumn("score", F.round("score", 6)).drop("prior"),
    "quality_rules": lambda d, s: quality_rules.judge(d),
    "packing": lambda d, s: packing.pack(d),
    "language_id": lambda d, s: language_id.identify(d).withColumn("score", F.round("score", 6)),
    "toxicity": lambda d, s: toxicity.classify(d, s.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")).withColumn("score", F.round("score", 4)),
    "sharding": lambda d, s: sharding.shard(d).drop("slot"),
    "near_dedup": lambda d, s: near_dedup.groups(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_of_clashing_names_change_nothing(spark, odd, name):
    plain = OPERATORS[name](odd, spark)
    more = odd
    for k, c in enumerate(NAMES):
        more = more.withColumn(c, F.lit(k) if k % 2 else F.lit(f"{k}"))
    clashing = OPERATORS[name](more, spark)
    assert clashing.columns == plain.columns
    assert texts_of(clashing, plain.columns) == texts_of(plain, plain.columns)
    assert OPERATORS[name](more.limit(0), spark).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("mixing", "packing")])
def test_a_row_for_each_row(spark, odd, name):
    out = OPERATORS[name](odd, spark)
    count = lambda f: sorted((str(r.doc_id), r.n) for r in f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())
    assert count(out) == count(odd)


def test_search_ignores_other_columns(spark):
    rows = [(k, [float(k % 7), 1.0, -0.5 * k]) for k in range(120)] + [(None, [1.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = ["query_id", "rank", "vec_id", "score"]
    assert texts_of(topk.top_k(df), key) == texts_of(topk.top_k(df.withColumns({c: F.lit(1) for c in ("chunk", "part", "ids", "vector", "dims", "page", "rank")})), key)


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, rows):
    return spark.createDataFrame(rows, STAGE_COLUMNS).withColumns({c: F.lit("clash") for c in NAMES})


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_stages_keep_distinct_documents_whatever_their_ids(spark):
    import corpus_pipeline as cp

    rows = [(None, prose(1), "en", "src1", 1), (None, prose(2), "en", "src1", 1), (None, prose(3), None, None, None), (8, prose(4), "en", "src1", 1), (8, prose(5), "en", "src1", 1), (7, prose(6), "en", "src1", 1)]
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, staged(spark, rows), "")
        assert out.columns == cp.COLUMNS, name
        assert sorted(r.text for r in out.collect()) == sorted(r[1] for r in rows), name


def test_stages_on_repeats_nulls_and_empty_texts(spark):
    import corpus_pipeline as cp

    quality, near, substring, mix, pack = (stage for _, stage in cp.STAGES)
    a = prose(9)
    rows = [(1, a, "en", "src1", 1), (1, a, "en", "src1", 1), (2, a + " more", "de", "src1", 1), (3, None, "en", "src1", 0), (4, "", "en", "src1", 0), (5, "too short", "en", "src1", 9), (6, " ".join(["again and again we go"] * 30), "en", "src1", 9)]
    docs = staged(spark, rows)
    ids = lambda f: sorted(r.doc_id for r in f.collect())
    assert ids(quality(spark, docs, "")) == [1, 1, 2]
    assert ids(near(spark, docs, "")) == [1, 3, 4, 5, 6]
    left = {r.doc_id: r for r in substring(spark, docs.where("doc_id != 1 or text is null"), "").collect()}
    assert set(left) == {2, 5, 6} and left[2].text == a + " more" and left[5].text == "too short" and left[6].n_chars == len(left[6].text) < len(rows[6][1])
    mixed = mix(spark, docs, "").collect()
    assert {r.doc_id for r in mixed} <= {1, 2, 5, 6} and all(r.text for r in mixed)
    packed = pack(spark, docs, "").toPandas()
    assert packed.n_tokens.sum() == sum(len((r[1] or "").split()) for r in rows)
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0
