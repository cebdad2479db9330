"""Queries on vectors, with components and vectors that the test tables seldom or never hold."""

import math

import duckdb

from kelpgraph import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def both(spark, folder, rows, name):
    """The rows of a query and of its SQL on vectors (id, vector, label), as text: -0.0 and 0.0 differ."""
    kind = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{folder}/embeddings.parquet/*.parquet'")
    df, want = QUERIES[name](spark, str(folder)), c.sql(ORACLES[name])
    places = [want.columns.index(x) for x in df.columns]
    return sorted(str(tuple(r)) for r in df.collect()), sorted(str(tuple(r[k] for k in places)) for r in want.fetchall())


def test_small_negative_components(spark, tmp_path):
    """A component between -5e-7 and 0 is rounded to -0.0; there is about one in a million."""
    rows = [(1, [-1e-7, 1e-7, -0.0, 0.0078125, -0.0078125, math.inf, -math.inf] + [0.123456789] * 57, 1), (2, None, 1), (3, [], 2), (4, [0.5, None, -3e-7], 3), (5, [math.nan], None)]
    got, want = both(spark, tmp_path, rows, "lsh_12_fitted_vectors")
    assert got == want


def test_only_unresolved_are_compared(spark, tmp_path, monkeypatch):
    """Vectors of tokens with a near name aren't compared with all others; one without a label is."""
    from kelpgraph.operators import rules

    asked, compare = [], rules.most_alike
    monkeypatch.setattr(rules, "most_alike", lambda a, *rest: asked.append(a) or compare(a, *rest))
    rows = [(k, [math.sin(k * j + 1.0) for j in range(8)], None if k == 150 else k % 7) for k in range(400)]
    got, want = both(spark, tmp_path, rows, "ref_07_auto_resolve")
    assert got == want and "embedding" in str(got)
    assert [r.a for r in asked[0].collect()] == [150]
