"""Best-path weights and costs as fix-points of relaxation rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save


def propagate(edges: DataFrame, starts: DataFrame, *, tau: float = 0.05, soft: bool = True, bonus: Column | None = None, top_k: int | None = None, rounds: int = 50, least_gain: float = 1e-12) -> DataFrame:
    """start, node, weight, predecessor, converged: the greatest weight over paths from each start (column id).

    A step makes w * weight + bonus of the edge; under tau it is halved (soft) or dropped (hard). Only nodes that gained
    are expanded in the next round; equal weights keep the predecessor of the smallest id. top_k keeps the best of each
    start at the end. With bonuses on a cycle weights can rise for ever: then rounds end it and converged is false.
    """
    state = save(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("predecessor")).distinct())
    frontier, converged = state, False
    step = edges.withColumn("bonus", bonus if bonus is not None else F.lit(0.0)).select(F.col("src").alias("node"), "dst", F.col("weight").alias("edge"), "bonus")
    for _ in range(rounds):
        w = F.col("weight") * F.col("edge") + F.col("bonus")
        moved = frontier.join(step, "node").select("start", "dst", w.alias("w"), F.col("node").alias("via"))
        moved = moved.withColumn("w", F.when(F.col("w") < tau, F.col("w") * 0.5).otherwise(F.col("w"))) if soft else moved.where(F.col("w") >= tau)
        best = moved.groupBy("start", F.col("dst").alias("node")).agg(F.max("w").alias("w"), F.min(F.struct((-F.col("w")).alias("n"), "via")).alias("first"))
        new = best.select("start", "node", F.col("w"), F.col("first.via").alias("via")).join(state, ["start", "node"], "left").where(F.col("weight").isNull() | (F.col("w") > F.col("weight") + least_gain))
        frontier = save(new.select("start", "node", F.col("w").alias("weight"), F.col("via").alias("predecessor")))
        if frontier.isEmpty():
            converged = True
            break
        state = save(state.join(frontier, ["start", "node"], "left_anti").unionByName(frontier))
    if top_k is not None:
        state = state.withColumn("rn", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("weight"), "node"))).where(F.col("rn") <= top_k).drop("rn")
    return state.withColumn("converged", F.lit(converged))


def tiers(edges: DataFrame, starts: DataFrame, levels: dict[str, float] | None = None) -> DataFrame:
    """propagate once for each tier's tau: halving below tau makes the results of one no filter of another's."""
    out = None
    for name, tau in (levels or {"core": 0.3, "extended": 0.1, "exploratory": 0.05}).items():
        got = propagate(edges, starts, tau=tau, soft=False).withColumn("tier", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def paths(result: DataFrame) -> DataFrame:
    """start, node, path: the predecessors of each node back to its start."""
    done = save(result.where("predecessor is null").select("start", "node", F.array("node").alias("path")))
    out, rest = done, result.where("predecessor is not null")
    while True:
        new = save(rest.join(done.select("start", F.col("node").alias("predecessor"), "path"), ["start", "predecessor"]).select("start", "node", F.concat("path", F.array("node")).alias("path")))
        if new.isEmpty():
            return out
        out, done = save(out.unionByName(new)), new


def cheapest(edges: DataFrame, starts: DataFrame, *, cost: str = "cost", hops: int = 20) -> DataFrame:
    """start, node, cost, hops, path: the least sum of costs over paths of at most so many edges, ties by the path."""
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("id").alias("path"))
    state = frontier = save(first)
    step = edges.select(F.col("src").alias("node"), "dst", F.col(cost).alias("edge"))
    for k in range(hops):
        moved = frontier.join(step, "node").select("start", "dst", (F.col("cost") + F.col("edge")).alias("c"), F.concat("path", F.array("dst")).alias("p"))
        best = moved.groupBy("start", F.col("dst").alias("node")).agg(F.min(F.struct("c", "p")).alias("b")).select("start", "node", "b.c", "b.p")
        new = best.join(state, ["start", "node"], "left").where(F.col("cost").isNull() | (F.col("c") < F.col("cost") - 1e-12))
        frontier = save(new.select("start", "node", F.col("c").alias("cost"), F.lit(k + 1).alias("hops"), F.col("p").alias("path")))
        if frontier.isEmpty():
            break
        state = save(state.join(frontier, ["start", "node"], "left_anti").unionByName(frontier))
    return state


def simple_paths(edges: DataFrame, src: str, dst: str, *, cost: str = "cost", hops: int = 6, k: int = 5) -> DataFrame:
    """The k cheapest simple paths: rank, path, cost, hops (ties by the path)."""
    spark = edges.sparkSession
    edges = _between(edges, src, dst, hops)
    state = spark.createDataFrame([([src], 0.0)], "path array<string>, cost double").withColumn("node", F.lit(src))
    found = None
    step = edges.select(F.col("src").alias("node"), "dst", F.col(cost).alias("edge"))
    for _ in range(hops):
        state = state.join(step, "node").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("edge")).alias("cost"), F.col("dst").alias("node"))
        state = save(state)
        hit = state.where(F.col("node") == dst)
        found = hit if found is None else found.unionByName(hit)
        state = state.where(F.col("node") != dst)
    top = found.orderBy("cost", "path").limit(k)
    return top.select(F.row_number().over(Window.orderBy("cost", "path")).alias("rank"), "path", "cost", (F.size("path") - 1).alias("hops"))


def _between(edges: DataFrame, src: str, dst: str, hops: int) -> DataFrame:
    """The edges that can lie on a path of at most `hops` from src to dst: distances to their ends and theirs to dst fit."""
    spark = edges.sparkSession

    def reached(start: str, a: str, b: str) -> DataFrame:
        seen = save(spark.createDataFrame([(start, 0)], "node string, far int"))
        last = seen
        for k in range(1, hops):
            new = last.join(edges.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
            last = save(new.withColumn("far", F.lit(k)))
            if last.isEmpty():
                break
            seen = save(seen.unionByName(last))
        return seen

    ahead, behind = reached(src, "src", "dst"), reached(dst, "dst", "src")
    e = edges.join(ahead.select(F.col("node").alias("src"), F.col("far").alias("f")), "src").join(behind.select(F.col("node").alias("dst"), F.col("far").alias("b")), "dst")
    return save(e.where(F.col("f") + F.col("b") + 1 <= hops).drop("f", "b"))
