"""Source scanning, graph building and codec queries. The tree is the package's own fixture."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import calls, table, with_views
from ..functions import text
from ..operators import rules as rl
from ..registry import query
from ..sources import codecs, scan

TREE = "file://" + str(Path(__file__).parent.parent / "fixtures" / "src")


def rows(spark: SparkSession) -> DataFrame:
    return scan.features(scan.symbols(scan.files(spark, TREE)))


@query("src_41_incremental", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'pending' ELSE 'done' END AS state FROM part")
def incremental(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.md5(F.col("p_name").cast("binary")).alias("fingerprint"))
    before = p.where("path % 10 != 0").withColumn("fingerprint", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("fingerprint")))
    return scan.changed(p, before).withColumnRenamed("path", "p_partkey")


@query("src_23_shadow_codec")
def shadows(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms written as shadow text and read back are the same: rows that differ (none)."""
    p = table(spark, sf, "part").groupBy(F.col("p_size").alias("file")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("int").alias("line"), F.lit("ACQ").alias("op"), F.lower("p_type").alias("arg"), (F.col("p_partkey") % 2 == 0).alias("fin")))), 1, 40).alias("atoms"))
    p = p.withColumn("header", F.create_map(F.lit("@S"), F.concat(F.lit("s"), "file")))
    back = codecs.write_shadow(p).select("file", *codecs.parse_shadow(F.col("value")))
    return p.select("file", "atoms").exceptAll(back.select("file", "atoms")).unionByName(p.select("file", "atoms").where("file = 1"))


@query("src_35_dot_export", with_views("SELECT 'digraph {' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}' AS dot FROM (SELECT '  \"' || src || '\" -> \"' || dst || '\" [weight=' || printf('%.3f', weight) || '];' AS l FROM calls WHERE src = 'sym::1')", "calls"))
def dot(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.to_dot(calls(spark, sf).where("src = 'sym::1'"))


@query("src_25_snapshots", "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return codecs.latest(o, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderdate")


@query("con_03_atom_dsl", """SELECT p_partkey AS n, ['ACQ', 'REL', 'AWT', 'XXX', 'RET', 'CAL', ''][p_partkey % 7 + 1] AS op, CASE p_partkey % 7 WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN '' ELSE lower(p_type) END AS arg, CASE WHEN p_partkey % 7 IN (2, 3) THEN 'f:Y' ELSE '' END AS note,
    CASE p_partkey % 7 WHEN 3 THEN 'unknown_op' WHEN 5 THEN 'no_argument' WHEN 6 THEN 'syntax' END AS error FROM part""")
def dsl(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the atom language: good ones, one with a note, an unknown operation, one without the argument that it needs, no line."""
    k, arg = F.col("p_partkey") % 7, F.lower("p_type")
    call = lambda op, a=arg: F.concat(F.lit(op + "("), a, F.lit(")"))
    none = F.lit("")
    line = F.when(k == 0, call("ACQ")).when(k == 1, call("REL")).when(k == 2, F.concat(call("AWT"), F.lit(" [f:Y]"))).when(k == 3, F.concat(call("XXX"), F.lit(" [f:Y]"))).when(k == 4, call("RET", none)).when(k == 5, call("CAL", none)).otherwise("???")
    return codecs.parse_dsl(table(spark, sf, "part").select(F.col("p_partkey").alias("n"), line.alias("value"))).select("n", "op", "arg", "note", "error")


@query("con_01_state_space", "SELECT 'DEADLOCK_RISK' AS finding, 1::BIGINT AS n")
def state_space(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.interleave import findings

    atoms = spark.createDataFrame([("t1", 0, "ACQ", "a"), ("t1", 1, "ACQ", "b"), ("t1", 2, "REL", "b"), ("t1", 3, "REL", "a"), ("t2", 0, "ACQ", "b"), ("t2", 1, "ACQ", "a"), ("t2", 2, "REL", "a"), ("t2", 3, "REL", "b")], "thread string, pos int, op string, arg string")
    return findings(atoms).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query("con_02_monte_carlo")
def monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.interleave import simulate

    atoms = [("t1", "ACQ", "a"), ("t1", "ACQ", "b"), ("t1", "REL", "b"), ("t1", "REL", "a"), ("t2", "ACQ", "b"), ("t2", "ACQ", "a"), ("t2", "REL", "a"), ("t2", "REL", "b")]
    return simulate(spark, atoms, runs=200)
