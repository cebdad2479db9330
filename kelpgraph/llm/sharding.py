"""Shards of near-equal bytes, tokens and rows.

Method. Vector bin packing: groups of equal texts are vectors of bytes, tokens and rows, as shares of the whole; the
largest first, each goes to the shard with room for its bytes whose residual capacity has the greatest dot product with
it. Groups of over 1/LARGE of a shard are packed one by one (there is a bounded number of those); all others fall by a
hash of their text into buckets, which are packed as such. A group that would fill over 1/SPLIT of a shard is split.

What reaches the driver is the large groups and the buckets, of bounded number at any input; rows are only joined with
that plan. Slots are numbered by chunks of a shard: sums of chunks give where each begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import n_words
from .tables import save

BUCKETS = 4096
#: A group with over 1/LARGE of a shard is packed by itself; one with over 1/SPLIT of a shard is split in parts.
LARGE, SPLIT = 64, 4
#: Repeated rows of one document go so many to an item.
COPIES = 16
CHUNK = 50_000


def assign(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows): of those with room for its bytes, the one with the greatest
    dot product with what it has left; if none has room, that with the most bytes left. So sizes come out near equal."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    residual = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))):
        room = residual[:, 0] >= share[k, 0]
        out[k] = np.argmax(np.where(room, residual @ share[k], -np.inf)) if room.any() else np.argmax(residual[:, 0])
        residual[out[k]] -= share[k]
    return out


def shard(documents: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, size (bytes of its text and 1), text_crc32, law (`bytes`), shard, slot, grown_shard (null) and n_tokens.

    Sizes of shards are near equal, as are their tokens and rows. Equal texts share a shard unless together they would
    fill over a quarter of one; a null text counts as an empty one, and all empty texts as equal. Repeated rows each get
    a slot of their own. Slots are gapless from 0 in each shard, in no order that means anything. An empty table gives none.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), n_words(text).alias("n_tokens"), F.xxhash64(text).alias("g"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "n_tokens", "g").agg(F.count(F.lit(1)).alias("times"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {COPIES}")))
    rows = save(rows.withColumn("part", part).withColumn("times", F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("part") * COPIES)))
    sums = [F.sum(F.col("size") * F.col("times")).alias("bytes"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("rows")]
    groups = save(rows.groupBy("g").agg(*sums))
    total = groups.agg(*(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))).first()
    most = F.greatest(*(F.col(c) / F.lit(max(1, total[c] or 0)) for c in ("bytes", "tokens", "rows")))
    large = groups.withColumn("most", most).where(F.col("most") > 1 / (shards * LARGE)).orderBy("g").toPandas()  # at most 3 * shards * LARGE
    parts = np.where(large.most > 1 / (shards * SPLIT), np.ceil(large.most * shards * LARGE), 1).astype(np.int64)
    large = pd.DataFrame({"g": large.g, "base": BUCKETS + np.cumsum(parts) - parts, "parts": parts})
    plan = F.broadcast(spark.createDataFrame(large, "g long, base long, parts long"))
    item = F.coalesce(F.col("base") + F.pmod(F.xxhash64("doc_id", "part", "g", F.lit(1)), F.col("parts")), F.pmod(F.col("g"), F.lit(BUCKETS)))
    rows = rows.join(plan, "g", "left").withColumn("item", item).drop("base", "parts")
    loads = rows.groupBy("item").agg(*sums).orderBy("item").toPandas()  # at most BUCKETS and the parts of the large groups
    where = spark.createDataFrame(pd.DataFrame({"item": loads["item"], "shard": assign(loads[["bytes", "tokens", "rows"]].to_numpy(float), shards)}), "item long, shard int")
    chunks = max(16, -(-(total["rows"] or 0) // (shards * CHUNK)))
    rows = rows.join(F.broadcast(where), "item").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "part", "g", F.lit(2)), F.lit(chunks)))
    rows = save(rows.drop("item", "g"))
    counts = rows.groupBy("shard", "chunk").agg(F.sum("times").alias("number"))
    begin = F.sum("number").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("number")
    begins = counts.withColumn("begin", begin).drop("number")
    own = F.sum("times").over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "part", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    rows = rows.withColumn("own", own).join(begins, ["shard", "chunk"])
    first = F.col("begin") + F.col("own")
    rows = rows.withColumn("slot", F.explode(F.sequence(first, first + F.col("times") - 1)))
    return rows.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
