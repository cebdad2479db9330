"""Exploration, simple paths and neighbour graphs against plain models."""

import itertools
import math
import random

from kelpgraph.operators import topology
from kelpgraph.plans import beam, propagation
from pyspark.sql import functions as F


def plain_explore(edges, score, start, width, steps, neighbours, alike=0.6):
    strongest = {}
    for s, d, w in edges:
        strongest.setdefault(s, []).append((-w, d))
    strongest = {s: [d for _, d in sorted(v)[:neighbours]] for s, v in strongest.items()}
    beams = [([start], 0.0)]
    for _ in range(steps):
        found = [(p + [d], score[d]) for p, _ in beams for d in strongest.get(p[-1], []) if d not in p and d in score]
        if not found:
            break
        found.sort(key=lambda x: (-x[1], x[0]))
        kept = found
        if len(found) > width:
            kept = []
            for c in found:
                near = any(len(set(c[0]) & set(k[0])) / len(set(c[0]) | set(k[0])) > alike for k in kept)
                if len(kept) < width and not near:
                    kept.append(c)
            if len(kept) < width // 2:
                kept += [c for c in found if c not in kept][: width - len(kept)]
        beams = kept
    return sorted(((p, s) for p, s in beams if len(p) > 1), key=lambda x: (-x[1], x[0]))


def test_explore(spark):
    rng = random.Random(5)
    names = [f"n{k:02d}" for k in range(30)]
    edges = [(a, b, round(rng.random(), 3)) for a in names for b in rng.sample(names, 4) if a != b] + [("x", "y", 0.5), ("lone", "barred", 0.5)]
    score = {n: rng.choice([0.5, 0.7, 0.9]) for n in names[3:]} | {"y": 0.5}
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes = spark.createDataFrame(list(score.items()), "id string, score double")
    starts = [*names, "x", "lone", "none"]
    for width, steps, neighbours in ((5, 5, 20), (3, 4, 2), (8, 2, 20)):
        got = {}
        for r in beam.explore(e, nodes, spark.createDataFrame([(s,) for s in starts], "id string"), width=width, steps=steps, neighbours=neighbours).collect():
            got.setdefault(r.start, []).append((r["rank"], (list(r.path), r.score)))
        for s in starts:
            assert [x for _, x in sorted(got.get(s, []))] == plain_explore(edges, score, s, width, steps, neighbours), s
    assert plain_explore(edges, score, "x", 5, 5, 20) == [(["x", "y"], 0.5)]  # kept, though it ends before the last step


def test_simple_paths(spark):
    rng = random.Random(2)
    edges = {(a, b): round(rng.random(), 3) for a, b in itertools.permutations("abcdefg", 2) if rng.random() < 0.4}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src string, dst string, cost double")
    want = []
    for n in range(0, 4):
        for mid in itertools.permutations("bcdef", n):
            p = ["a", *mid, "g"]
            if all(x in edges for x in itertools.pairwise(p)):
                want.append((round(sum(edges[x] for x in itertools.pairwise(p)), 6), p))
    got = [(round(r.cost, 6), r.path) for r in propagation.simple_paths(df, "a", "g", hops=4, k=6).orderBy("rank").collect()]
    assert got == sorted(want)[:6]


def test_betti(spark):
    ring = [(k, math.cos(k / 30 * math.tau), math.sin(k / 30 * math.tau)) for k in range(30)]
    far = [(100 + k, 10 + math.cos(k / 40 * math.tau), math.sin(k / 40 * math.tau)) for k in range(40)]
    r = topology.betti_1(spark.createDataFrame(ring + far, "id long, x double, y double")).first()
    edges = {(r.u, r.v) for r in topology.knn_graph(spark.createDataFrame(ring + far, "id long, x double, y double")).collect()}
    assert (r.nodes, r.edges, r.components) == (70, len(edges), 2)
    assert r.betti_1 == (len(edges) - 70 + 2) // 2
    assert topology.betti_1(spark.createDataFrame(ring, "id long, x double, y double")).first().betti_1 == 0


def test_labels(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101)]
    got = {r.id: r.component for r in topology.labels(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
