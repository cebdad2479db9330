"""Connected components by contraction rounds and, for what is left, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, save

#: Links that one task's union-find takes (some 100 MB); more are contracted by distributed rounds first.
TASK_LINKS = 1_000_000


def _union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    for frame in frames:
        for u, v in zip(frame.u.tolist(), frame.v.tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for each node of links (u, v): component is the smallest node reachable.

    While there are over task_links links, each node is contracted into the neighbour of least hash (or itself), which
    leaves a fixed share of the nodes whatever the shape; the rest, now bounded, goes through one union-find. No round
    gathers the neighbours of a node: minima are taken before the shuffle.
    """
    links = save(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").distinct())
    steps: list[DataFrame] = []
    number = links.count()
    while number > task_links:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), c.alias("to"))  # noqa: B023, E731
        least = both.groupBy("u").agg(F.min(F.least(rank(F.col("v")), rank(F.col("u")))).alias("m"))
        step = save(least.select(F.col("u").alias("node"), F.col("m.to").alias("to")))
        steps.append(step)
        ends = links.join(step.withColumnsRenamed({"node": "u", "to": "a"}), "u").join(step.withColumnsRenamed({"node": "v", "to": "b"}), "v")
        before, links = links, save(ends.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop(before)
        number = links.count()
    tables = [links]
    roots = links.repartition(1).mapInPandas(_union_find, "node long, root long")
    for step in reversed(steps):
        known = save(roots)
        tables.append(known)
        roots = step.join(known.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    if steps:
        roots = save(roots)
        least = save(roots.groupBy("root").agg(F.min("node").alias("least")))
        tables += [roots, least, *steps]
        roots = roots.join(least, "root").select("node", F.least("least", "node").alias("root"))
    out = save(roots.select("node", F.col("root").alias("component")))
    drop(*tables)
    return out
