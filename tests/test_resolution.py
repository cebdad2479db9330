"""Names resolved step by step, without tables sent to all executors."""

from kelpgraph.operators import rules, similarity


def test_near_pairs_shuffle(spark):
    """The keys of names are many times their table: neither side is broadcast, whatever its estimated size."""
    names = spark.range(1000).selectExpr("concat('name_', id) as name")
    pairs = similarity.near_pairs(names, names)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert pairs.where("a = 'name_5'").count() == 10 + 9 + 10 - 1  # another last character, one before it, one after it; name_55 is both


def test_resolved_steps(spark):
    names = spark.createDataFrame([("i1", "alpha"), ("i2", "alphabet"), ("i3", "beta"), ("i4", "gamma"), ("i5", "gamme"), ("i6", "Beta")], "id string, name string")
    aliases = spark.createDataFrame([("First", "i1"), ("gamma", "i1")], "name string, id string")
    asked = [" ALPHA", "alph", "alphab", "beta", "first", "gammo", "alphabex", "zz", "gamma", None, "alpha"]
    r = rules.resolved(spark.createDataFrame([(t,) for t in asked], "token string"), names, aliases)
    assert {(x.token, x.status, x.id) for x in r.collect()} == {
        ("alpha", "exact", "i1"), ("alph", "ambiguous", None), ("alphab", "prefix", "i2"), ("beta", "ambiguous", None), ("first", "alias", "i1"), ("gammo", "ambiguous", None),
        ("alphabex", "corrected", "i2"), ("zz", "not_found", None), ("gamma", "exact", "i4"), (None, "not_found", None),
    }
    assert r.count() == 10
