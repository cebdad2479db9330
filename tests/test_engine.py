"""The engine's methods on a small graph."""

import pytest

from kelpgraph.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    pairs = [("a", "b", 0.9), ("a", "c", 0.5), ("b", "d", 0.5), ("c", "d", 0.8), ("d", "e", 0.7), ("e", "b", 0.3), ("f", "d", 0.9)]
    edges = spark.createDataFrame([(f"sym::{s}", f"sym::{d}", "call", w) for s, d, w in pairs] + [("cat::x", "sym::a", "semantic_similarity", 0.15)], "src string, dst string, kind string, weight double")
    nodes = spark.createDataFrame([(f"sym::{n}", n, "class" if n == "a" else "function", False) for n in "abcdef"], "id string, name string, kind string, is_noisy boolean")
    aliases = spark.createDataFrame([("alpha", "sym::a")], "name string, id string")
    return Engine(spark, nodes, edges, aliases)


def test_lookups(engine):
    assert engine.get_symbol("sym::a").count() == 1
    assert [r.id for r in engine.get_category("x").collect()] == ["sym::a"]
    assert engine.list_symbols(3).count() == 3 and engine.list_categories().count() == 1
    assert engine.get_stats().first().edges == 8


@pytest.mark.parametrize(("token", "status"), [("a", "exact"), ("alpha", "alias"), ("zzzzzz", "not_found")])
def test_resolve(engine, token, status):
    assert engine.resolve(token).first().status == status


def test_queries(engine):
    w = {r.node: round(r.weight, 6) for r in engine.query("sym::a").collect()}
    assert w["sym::d"] == 0.45 and w["sym::b"] == 0.9
    assert engine.query_multi_tier("sym::a").count() > 5
    assert {r.bucket for r in engine.refined("sym::a").collect()} <= {"primary", "secondary", "related"}


def test_traversal(engine):
    assert engine.state("sym::f").first().role == "source"
    assert {r.node for r in engine.query_with_mode("sym::d", "reverse", 1).collect()} == {"sym::d", "sym::b", "sym::c", "sym::f"}
    assert engine.find_upstream("sym::d").count() > 0
    assert engine.escape_sink("sym::d").count() == 1
    assert engine.classify_role().count() == 7
    assert [r.node for r in engine.shortest_path("sym::a", "sym::e").orderBy("pos").collect()] == ["sym::a", "sym::b", "sym::e"]


def test_planning(engine):
    p = engine.plan_trajectory("sym::a", "sym::e").first()
    assert p.path == ["sym::a", "sym::b", "sym::d", "sym::e"] or p.path == ["sym::a", "sym::c", "sym::d", "sym::e"]
    assert engine.plan_alternatives("sym::a", "sym::e", k=2).count() == 2
    assert engine.explore("sym::a", width=2, depth=2).count() == 2


def test_fields_and_regions(engine):
    assert engine.detect_attractors(3).count() == 3
    assert engine.get_field_vector("sym::a").count() == 1
    centers = engine.get_semantic_centers().collect()
    assert sum(r["size"] for r in centers) == 7
    assert engine.get_center_reachability(centers[0].region).count() >= 0


def test_next_nodes_and_intent(spark, engine):
    nodes = engine.nodes.join(spark.createDataFrame([(f"sym::{n}", v) for n, v in {"a": [1.0, 0.0], "b": [1.0, 0.1], "c": [-1.0, 0.0], "d": [1.0, 0.0], "e": [1.0, 0.0]}.items()], "id string, vector array<double>"), "id", "left")
    e = Engine(spark, nodes, engine.edges)
    assert [r.dst for r in e.query_next_nodes("sym::a", [1.0, 0.0]).collect()] == ["sym::b", "sym::c"]
    assert [r.path for r in e.explore("sym::a", intent=[1.0, 0.0], depth=2).collect()] == [["sym::a", "sym::b", "sym::d"]]  # c points away
    assert e.plan_trajectory("sym::a", "sym::d", avoid=["sym::b"]).first().path == ["sym::a", "sym::c", "sym::d"]


def test_phases_and_similar(engine):
    out = engine.phases(depth=2)
    assert list(out) == ["events", "states", "energies", "field", "centers"]
    assert all(f.count() > 0 for f in out.values())
    assert out["events"].where("event_type = 'NODE_VISIT' and depth = 0").count() == 7
    assert engine.similar(0.5).where("a = b").count() == 0


def test_scan_workspace(spark):
    from pathlib import Path

    import kelpgraph

    e = Engine.scan_workspace(spark, "file://" + str(Path(kelpgraph.__file__).parent / "fixtures" / "src"))
    assert {"sym::Worker", "sym::parse", "cat::class"} <= {r.id for r in e.nodes.collect()}
    assert e.edges.where("src = 'sym::main' and dst = 'sym::fetch' and kind = 'call'").count() == 1
    assert e.resolve("Worker").first().id == "sym::Worker"
