"""Scanning queries on files of many kilobytes."""

import time

import duckdb
import pytest

from kelpgraph import catalog
from kelpgraph.sources import scan

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
KIND = "path string, content binary, length long"


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Ten paths of 120 parts each: files that pass, are ignored (size 3), begin with a zero byte (7, 27) or don't parse (25)."""
    d = tmp_path_factory.mktemp("parts")
    types = ["STANDARD", "PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM"]
    values = ", ".join(f"({k}, 'large red {k % 5}', 'Brand#1', '{types[k % 10 % 6]}', {[1, 3, 7, 25, 4, 5, 27, 2, 6, 8][k % 10]}, 1.0)" for k in range(1200))
    duckdb.sql(f"COPY (SELECT k::BIGINT AS p_partkey, n AS p_name, b AS p_brand, t AS p_type, s::INT AS p_size, c::DOUBLE AS p_retailprice FROM (VALUES {values}) x(k, n, b, t, s, c)) TO '{d}/part.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", [
    "src_01_discover", "src_02_unreadable", "fn_11_behaviour_tags", "res_12_two_phase_scan", "fn_40_intents", "joi_14_registry_mismatch", "joi_16_unbound_references", "fn_13_feature_tags", "fn_17_fidelity",
    "grb_08_aliases", "src_39_call_relations", "src_40_class_signatures",
])
def test_long_files(spark, parts, name):
    df = QUERIES[name](spark, parts)
    got = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    c = duckdb.connect()
    c.sql(f"create view part as from '{parts}/part.parquet'")
    want = c.sql(ORACLES[name])
    places = [want.columns.index(x) for x in sorted(df.columns)]
    assert got == sorted(str(tuple(r[k] for k in places)) for r in want.fetchall())


def test_binary_gate(spark):
    """A zero byte among the first 8,192 bytes, counted in bytes and not in characters."""
    texts = {"none": b"x" * 9000, "first": b"\0" + b"x" * 9000, "last": b"x" * 8191 + b"\0", "beyond": b"x" * 8192 + b"\0", "wide": "é".encode() * 4096 + b"\0", "odd": b"\x10\x01" * 100, "empty": b"", "no": None}
    rows = spark.createDataFrame([(k, v, len(v or b"")) for k, v in texts.items()], KIND)
    assert {r.path for r in scan.gated(rows).where("reason = 'binary'").collect()} == {"first", "last"}


def test_gate_is_linear(spark):
    """1,000 files of 20 KB: a gate that goes through their bytes one by one takes minutes."""
    rows = spark.range(1000).selectExpr("concat('a', id) as path", "cast(repeat('x = 1\n', 3400) as binary) as content", "20400L as length")
    began = time.monotonic()
    assert scan.gated(rows).where("reason is null").count() == 1000
    assert time.monotonic() - began < 15
