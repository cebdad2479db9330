"""The corpus pipeline: rules, near-duplicates, repeated passages, mixing, packing. Each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgraph.llm import mixing, near_dedup, packing, quality_rules, substring_dedup, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. Null, empty and wordless texts are short of words and go, whatever
    the id; rows that repeat are judged alike and all stay or go. Other columns than a document's are left behind."""
    judged = quality_rules.judge(docs, keep=COLUMNS[1:])
    return judged.where("kept").select("doc_id", *(F.col(f"in_{c}").alias(c) for c in COLUMNS[1:]))


def _identified(docs: DataFrame) -> DataFrame:
    """The document's columns and `node`: a hash of id and text, either of which may be null."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.col("text").isNull(), "text").alias("node"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8): that of the smallest id, no id first.

    A document is an id and a text: other texts of an id, or without one, are others, and stay unless they are alike; of
    rows that repeat both one stays. Texts without words are alike to none. An empty table gives none.
    """
    docs = _identified(docs)
    named = tables.save(docs.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("key"), F.count(F.lit(1)).alias("rows")))
    found = near_dedup.groups(docs.select("node", "text"), percent=80, id_col="node").select("node", "component_id").distinct()
    least = F.min(F.struct("key", "node", "rows")).alias("m")
    kept = tables.save(found.join(named, "node").groupBy("component_id").agg(least).select("m.node", "m.rows"))
    gone = tables.save(named.select("node").join(kept.select("node"), "node", "left_anti"))
    docs = near_dedup.without(docs, "node", gone)
    if not kept.where("rows > 1").isEmpty():
        docs = docs.dropDuplicates(["node"])
    return docs.select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of windows that occur earlier, joined by one space; those of which nothing is left go.

    A document that repeats nothing keeps its text as it is, lines and all. Null and wordless texts go. No id counts as
    earlier than all; texts of one id are told apart by their hash, and rows that repeat both are treated alike.
    """
    found = substring_dedup.dedup(docs, carry=["text", "lang", "source"]).where("n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("in_text"))
    return found.select("doc_id", text.alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"), F.char_length(text).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each epoch.

    A document is an id, a text, a language and a source; rows that repeat all are one. A null language or source is
    `unknown` to the weights. Texts without words are not chosen. An empty table gives none.
    """
    leaf = ["lang", "source"]
    docs = _identified(docs)
    if not docs.groupBy("node", *leaf).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        docs = docs.dropDuplicates(["node", *leaf])
    chosen = mixing.mix(docs, id_col="node").select(F.col("node").alias("c_node"), *(F.col(c).alias(f"c_{c}") for c in leaf), "copies")
    same = [F.coalesce(docs[c], F.lit("unknown")) == F.col(f"c_{c}") for c in leaf]
    joined = docs.join(chosen, [docs["node"] == F.col("c_node"), *same])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins. Rows that repeat are copies, each packed; a document without words has
    one piece without a bin. An empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Recompression's removal, groups by links and best-fit packing have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again. Nulls, repeats and the like: see the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.save(docs)
    return docs
