"""Event streams: idempotent append, running features, windows and entropy over the last batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, symbol string, event_type string, value double"


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def features(stream: DataFrame) -> DataFrame:
    """Running frequency, first and last seen and burstiness of each symbol (output modes update or complete)."""
    g = stream.groupBy("symbol").agg(F.count(F.lit(1)).alias("frequency"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    span = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    return g.withColumn("burstiness", F.when(F.col("frequency") <= 1, 0.0).when(span == 0, 1.0).otherwise(1 / (1 + span / F.col("frequency") / 1e6)))


def windowed(stream: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and event type; tumbling without slide."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", delay).groupBy(w.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("window"), "symbol").agg(F.count(F.lit(1)).alias("n"))


def success_rates(stream: DataFrame, key: str = "symbol", ok: str = "ok") -> DataFrame:
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("rate"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a table, events already there left out; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["event_id"])
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select("event_id"), "event_id", "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the whole of a running aggregate after each batch, in place of what was there."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(batch: DataFrame, done: DataFrame, key: str = "start") -> DataFrame:
    """Restart: starts that the log already has are left out."""
    return batch.join(done.select(key).distinct(), key, "left_anti")


def stable(series: DataFrame, value: str = "entropy", order: str = "round", window: int = 5, within: float = 0.01, key: str = "graph") -> DataFrame:
    """Whether the moving mean of the last `window` values changes by less than `within`, by key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    mean = F.avg(value).over(w.rowsBetween(-(window - 1), 0))
    s = series.withColumn("mean", mean)
    return s.withColumn("stable", F.abs(F.col("mean") - F.lag("mean").over(w)) < within)
