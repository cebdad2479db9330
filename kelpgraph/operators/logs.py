"""Event logs: frequency, burstiness, histograms and transitions, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visits(events: DataFrame, key: str = "symbol", ts: str = "ts_us") -> DataFrame:
    """key, frequency, first_seen, last_seen, burstiness: 0 for one event, 1 for all at once, else 1 / (1 + seconds per event)."""
    g = events.groupBy(key).agg(F.count(F.lit(1)).alias("frequency"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    span = F.col("last_seen") - F.col("first_seen")
    burst = F.when(F.col("frequency") <= 1, 0.0).when(span == 0, 1.0).otherwise(F.least(F.lit(1.0), 1 / (1 + span / F.col("frequency") / 1e6)))
    return g.withColumn("burstiness", burst)


def histogram(events: DataFrame, key: str, kind: str) -> DataFrame:
    """key, kind, n, share, dominant (the most frequent, ties: first)."""
    n = events.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("dominant", F.row_number().over(w.orderBy(F.desc("n"), kind)) == 1)


def transitions(events: DataFrame, key: str, kind: str, ts: str = "ts_us", ident: str = "event_id") -> DataFrame:
    """src, dst, n: how often one kind follows another of the same key."""
    after = F.lead(kind).over(Window.partitionBy(key).orderBy(ts, ident))
    return events.select(F.col(kind).alias("src"), after.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["event_id"])
