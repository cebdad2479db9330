"""Event-log queries: frequency, burstiness, couplings and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import log, table, with_views
from ..functions import energy as en
from ..operators import logs as lg
from ..registry import query, r6


@query("agg_03_burstiness", with_views("""SELECT symbol, count(*) AS frequency, min(ts_us) AS first_seen, max(ts_us) AS last_seen, round(CASE WHEN count(*) <= 1 THEN 0 WHEN max(ts_us) = min(ts_us) THEN 1
    ELSE least(1, 1 / (1 + (max(ts_us) - min(ts_us)) / count(*)::DOUBLE / 1e6::DOUBLE)) END, 9) AS burstiness FROM log GROUP BY symbol""", "log"))  # fmt: skip
def burstiness(spark: SparkSession, sf: str) -> DataFrame:
    return lg.visits(log(spark, sf)).withColumn("burstiness", F.round("burstiness", 9))


@query("agg_05_coupling_map", with_views("""WITH n AS (SELECT symbol, event_type, count(*) AS n FROM log GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol)::DOUBLE AS share, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, event_type) AS rn FROM n)
    SELECT symbol, event_type, round(share, 6) AS share, rn = 1 AS dominant FROM t""", "log"))  # fmt: skip
def coupling(spark: SparkSession, sf: str) -> DataFrame:
    return lg.histogram(log(spark, sf), "symbol", "event_type").select("symbol", "event_type", r6("share").alias("share"), "dominant")


@query("src_27_reflections", with_views("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k, json_valid(props) AS valid FROM log", "log"))
def reflections(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query("agg_22_telemetry", with_views("SELECT symbol, count(*) AS n, round(avg(value), 5) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM log GROUP BY symbol", "log"))
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("agg_23_path_payload", "SELECT conv_id, count(*) AS turns, round(avg((role = 'assistant')::INT), 6) AS answered, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def path_payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), r6(F.avg((F.col("role") == "assistant").cast("int"))).alias("answered"), F.max(F.char_length("text")).alias("longest"))


@query("agg_24_diagnosis", with_views("SELECT event_type, count(*) AS n, count(DISTINCT symbol) AS symbols FROM log GROUP BY event_type", "log"))
def diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))


@query("agg_26_heat", with_views("SELECT symbol, count(*) AS commits, round(sum(value), 2) AS lines, count(DISTINCT event_type) AS authors, round(0.6::DOUBLE * tanh(count(*) / 10.0::DOUBLE) + 0.4::DOUBLE * tanh(round(sum(value), 2) / 100.0::DOUBLE), 4) AS heat FROM log GROUP BY symbol", "log"))
def heat(spark: SparkSession, sf: str) -> DataFrame:
    g = log(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("commits"), F.round(F.sum("value"), 2).alias("lines"), F.count_distinct("event_type").alias("authors"))
    return g.withColumn("heat", en.heat(F.col("commits"), F.col("lines")))


@query("stm_06_trailing_window", with_views("SELECT symbol, count(*) AS n FROM log WHERE ts_us > (SELECT max(ts_us) FROM log) - 86400000000 GROUP BY symbol", "log"))
def trailing(spark: SparkSession, sf: str) -> DataFrame:
    e = log(spark, sf)
    last = F.broadcast(e.agg(F.max("ts_us").alias("last")))  # of one row
    return e.crossJoin(last).where("ts_us > last - 86400000000").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("stm_tumbling_windows", with_views("SELECT ts_us // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM log GROUP BY 1, 2", "log"))
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "value")


@query("stm_session_windows", with_views("""WITH s AS (SELECT symbol, ts_us, sum(new) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS session FROM (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) >= 7200000000)::INT AS new FROM log))
    SELECT symbol, min(ts_us) AS start_us, count(*) AS n FROM s GROUP BY symbol, coalesce(session, 0)""", "log"))  # fmt: skip
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "2 hours").alias("w"), F.concat(F.lit("user::"), "user_id").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.unix_micros("w.start").alias("start_us"), "n")


@query("src_15_replay", with_views("WITH n AS (SELECT symbol, event_type, lead(event_type) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS next FROM log) SELECT event_type AS src, next AS dst, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY 1, 2", "log"))
def replay(spark: SparkSession, sf: str) -> DataFrame:
    return lg.transitions(log(spark, sf), "symbol", "event_type").select("src", "dst", "n")


@query("src_17_event_sink", "SELECT event_id, event_type, value FROM events")
def sink(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice, once appended: repeated ids are dropped."""
    from ..tables import save

    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return save(lg.distinct_events(e.unionByName(e)))
