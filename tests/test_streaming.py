"""Streams give what the batch gives."""

import datetime as dt

from kelpgraph.operators import logs
from kelpgraph.streaming import events as ev
from pyspark.sql import functions as F


def sample(spark, path):
    t = dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(seconds=37 * k), f"s{k % 3}", "view" if k % 2 else "click", float(k)) for k in range(40)]
    spark.createDataFrame(rows + rows[:5], ev.SCHEMA).repartition(2).write.parquet(path)
    return spark.createDataFrame(rows, ev.SCHEMA)


def collect(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = sample(spark, path)
    read = lambda: spark.readStream.schema(ev.SCHEMA).parquet(path)
    once = collect(spark, ev.deduplicated(read()), "once", "append")
    assert once.count() == 40
    running = {r.symbol: r.frequency for r in collect(spark, ev.features(read()), "running", "complete").collect()}
    assert sum(running.values()) == 45
    want = {r.symbol: r.frequency for r in logs.visits(batch.withColumn("ts_us", F.unix_micros("ts"))).collect()}
    assert want == {"s0": 14, "s1": 13, "s2": 13}
    w = collect(spark, ev.windowed(read(), "10 minutes"), "w", "complete")
    assert w.agg(F.sum("n")).first()[0] == 45
    s = collect(spark, ev.sessions(read(), "5 minutes"), "s", "complete")
    assert s.agg(F.sum("n")).first()[0] == 45


def test_append_is_idempotent(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    sample(spark, path)
    for k in range(2):
        stream = spark.readStream.schema(ev.SCHEMA).parquet(path)
        ev.append(stream, out, str(tmp_path / f"check{k}")).awaitTermination()
    assert spark.read.parquet(out).count() == 40


def test_stable(spark):
    rows = spark.createDataFrame([("g", k, 1.0 if k > 2 else float(k)) for k in range(9)], "graph string, round int, entropy double")
    got = [r.stable for r in ev.stable(rows).orderBy("round").collect()]
    assert got[-1] and not got[1]
