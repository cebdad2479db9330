"""Hand-worked micro-graphs and plain models of the loop operators."""

import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kelpgraph.functions import energy, roles, text
from kelpgraph.operators import similarity, structure
from kelpgraph.operators import fields, regions, rules
from kelpgraph.plans import propagation, traversal
from kelpgraph.plans.interleave import findings, simulate


def graph(spark, edges):
    return spark.createDataFrame([(a, b, "call", float(w)) for a, b, w in edges], "src string, dst string, kind string, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def weights(df):
    return {r.node: round(r.weight, 9) for r in df.collect()}


def test_chain(spark):
    r = propagation.propagate(graph(spark, [("a", "b", 0.8), ("b", "c", 0.8), ("c", "d", 0.5)]), ids(spark, "a"))
    assert weights(r) == {"a": 1, "b": 0.8, "c": 0.64, "d": 0.32}


def test_soft_and_hard_tau(spark):
    g = graph(spark, [("a", "b", 0.04)])
    assert weights(propagation.propagate(g, ids(spark, "a")))["b"] == 0.02
    assert "b" not in weights(propagation.propagate(g, ids(spark, "a"), soft=False))


def test_diamond(spark):
    g = graph(spark, [("a", "b", 0.9), ("a", "c", 0.5), ("b", "d", 0.5), ("c", "d", 0.8)])
    r = {x.node: x for x in propagation.propagate(g, ids(spark, "a")).collect()}
    assert round(r["d"].weight, 9) == 0.45 and r["d"].predecessor == "b"
    p = {x.node: x.path for x in propagation.paths(propagation.propagate(g, ids(spark, "a"))).collect()}
    assert p["d"] == ["a", "b", "d"]


def test_cycle_reports_that_it_does_not_converge(spark):
    g = graph(spark, [("a", "b", 1.0), ("b", "a", 1.0)])
    r = propagation.propagate(g, ids(spark, "a"), bonus=F.lit(0.1), rounds=4).collect()
    assert not any(x.converged for x in r) and max(x.weight for x in r) > 1.2


def test_hub(spark):
    g = graph(spark, [("cat::x", f"n{k}", 0.5) for k in range(11)])
    assert {round(r.weight, 5) for r in structure.normaliser(g).collect()} == {0.46331}


def test_triangles_and_curvature(spark):
    t = {(r.u, r.v): r for r in structure.curvature(graph(spark, [("u", "v", 1), ("v", "w", 1), ("u", "w", 1)])).collect()}
    assert (t["u", "v"].transitive, t["u", "v"].feedback, t["u", "v"].raw, t["u", "v"].norm) == (1, 0, 3, 1)
    f = {(r.u, r.v): r for r in structure.triangles(graph(spark, [("u", "v", 1), ("v", "w", 1), ("w", "u", 1)])).collect()}
    assert (f["u", "v"].transitive, f["u", "v"].feedback) == (0, 1)


def test_friction_caps(spark):
    r = spark.range(1).select(structure.friction(F.lit(-2.0)).alias("a"), structure.friction(F.lit(-20.0)).alias("b")).first()
    assert round(r.a, 5) == 2.71828 and round(r.b, 5) == 148.41316


def test_adaptive_gate(spark):
    rows = spark.createDataFrame([("g", w) for w in (0.2, 0.4, 0.6)], "g string, w double")
    r = structure.adaptive_gate(rows, "g", "w").collect()
    assert {round(x.threshold, 6) for x in r} == {0.514983} and [x.w for x in r if x.passed] == [0.6]


def test_percentiles(spark):
    r = structure.percentiles(spark.createDataFrame([(k, v) for k, v in enumerate([1, 2, 2, 4])], "id int, v int"), "v").collect()
    assert sorted(x.pct_v for x in r) == [0.25, 0.75, 0.75, 1.0]


def test_scc(spark):
    got = {(r.id, r.component) for r in structure.scc(graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "d", 1), ("c", "e", 1), ("x", "y", 1), ("y", "x", 1)])).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph_against_plain_models(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(25)]
    edges = {(rng.choice(names), rng.choice(names)): round(rng.uniform(0.2, 1), 3) for _ in range(60)}
    edges = {k: w for k, w in edges.items() if k[0] != k[1]}
    g = graph(spark, [(a, b, w) for (a, b), w in edges.items()])
    depth, level = {"n00": 0}, ["n00"]
    while level:
        level = sorted({b for (a, b) in edges if a in level and b not in depth})
        depth |= {b: max(depth.values()) + 1 for b in level}
    visits, _ = traversal.bfs(g, ids(spark, "n00"), 30)
    assert {r.node: r.depth for r in visits.collect()} == depth
    best, heap = {}, [(-1.0, "n00")]
    while heap:
        w, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = -w
        for (a, b), x in edges.items():
            if a == n and -w * x >= 0.05:
                heapq.heappush(heap, (w * x, b))
    got = weights(propagation.propagate(g, ids(spark, "n00"), soft=False))
    assert got == {k: round(v, 9) for k, v in best.items()}
    cost, heap = {}, [(0.0, "n00")]
    while heap:
        c, n = heapq.heappop(heap)
        if n in cost:
            continue
        cost[n] = c
        for (a, b), x in edges.items():
            if a == n:
                heapq.heappush(heap, (c + x, b))
    r = propagation.cheapest(g.withColumn("cost", F.col("weight")), ids(spark, "n00"), hops=30)
    assert {x.node: round(x.cost, 9) for x in r.collect()} == {k: round(v, 9) for k, v in cost.items()}


def test_minhash(spark):
    assert not similarity.minhash([]).any() and len(similarity.family()[0]) == 128
    assert (similarity.minhash(["a", "b"]) == similarity.minhash(["b", "a"])).all()
    a, b = (similarity.minhash([f"{p}{k}" for k in range(40)]) for p in "xy")
    assert (a == b).mean() < 0.3
    assert len(similarity.bands(a)) == 16
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["q"])], "id int, tokens array<string>")
    assert {(r.a, r.b, r.similarity) for r in similarity.band_join(similarity.signatures(rows, "id", "tokens"), "id").collect()} == {(1, 2, 1.0), (2, 1, 1.0)}


def test_trust_and_heal(spark):
    one = F.lit(1.0)
    t = energy.trust(one, one, one, one, F.lit(0.5), F.lit(True), one)
    assert spark.range(1).select(t.alias("t")).first().t == 0.0625
    h = [spark.range(1).select(roles.heal(F.lit(a), F.lit(b)).alias("h")).first().h for a, b in ((0.6, -0.04), (0.6, -0.06), (0.4, -0.01), (0.9, -0.02), (0.9, 0.0))]
    assert h == ["accept", "reject", "reject", "review", "accept"]


def test_locks(spark):
    schema = "thread string, pos int, op string, arg string"
    dead = spark.createDataFrame([("t1", 0, "ACQ", "a"), ("t1", 1, "ACQ", "b"), ("t2", 0, "ACQ", "b"), ("t2", 1, "ACQ", "a")], schema)
    assert "DEADLOCK_RISK" in {r.finding for r in findings(dead).collect()}
    leak = spark.createDataFrame([("t1", 0, "ACQ", "a")], schema)
    assert {r.finding for r in findings(leak).collect()} == {"RESOURCE_LEAK"}
    assert rules.deadlocks(rules.lock_order(dead)).count() == 1
    assert {r.failed for r in rules.lock_rules(leak).collect()} == {"must_have_release"}
    got = {r.outcome: r.runs for r in simulate(spark, [("t1", "ACQ", "a"), ("t1", "REL", "a")], runs=20).collect()}
    assert got == {"finished": 20}


def test_text_functions(spark):
    df = spark.createDataFrame([("abc", "a/b/__init__.py")], "t string, p string")
    r = df.select(text.crc_hex(F.col("t")).alias("c"), text.module(F.col("p")).alias("m"), text.language(F.col("p")).alias("l"), text.ignored(F.col("p"), ["a/**", "!a/b/*.py"]).alias("i")).first()
    assert (r.c, r.m, r.l, r.i) == (f"{zlib.crc32(b'abc'):08x}", "a.b", "python", False)


def test_close_names(spark):
    names = spark.createDataFrame([(x,) for x in ("abc", "abd", "ab", "xyz", "abcd")], "n string")
    assert {(r.a, r.b) for r in similarity.close_names(names, 1).collect()} == {("abc", "abd"), ("ab", "abc"), ("ab", "abd"), ("abc", "abcd"), ("abcd", "abd")}


def test_budget_keeps_the_first_that_passes_it_or_not(spark):
    rows = spark.createDataFrame([("a", 0.9, 5), ("b", 0.8, 5), ("c", 0.8, 5)], "id string, weight double, tokens int")
    assert {r.id for r in rules.cut_at(rows, 7, keep_first_over=True).collect()} == {"a", "b"}
    assert {r.id for r in rules.cut_at(rows, 7, keep_first_over=False).collect()} == {"a"}


def test_entropy_and_ranks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "id string, w double")
    assert {r.id: round(r.entropy, 9) for r in fields.entropy(rows, "id", "w").collect()} == {"a": 1.0, "b": 0.0}
    s = spark.createDataFrame([(f"n{k}", float(k % 7)) for k in range(50)], "id string, energy double")
    got = sorted((r.energy_rank, r.id) for r in fields.rank_energy(s).collect())
    assert [i for _, i in got] == [r.id for r in s.orderBy(F.desc("energy"), "id").collect()] and got[0][0] == 0


def test_communities(spark):
    e = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1), ("c", "x", 0.1)]
    c = {r.id: r.community for r in regions.communities(graph(spark, e)).collect()}
    assert len({c[k] for k in "abc"}) == 1 and len({c[k] for k in "xyz"}) == 1
