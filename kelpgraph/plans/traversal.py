"""Bounded breadth-first traversal from many starts at once, and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save


def bfs(edges: DataFrame, starts: DataFrame, depth: int, *, tau: float = 0.0, log_rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(visits, events): start, node, depth of first visits; start, src, dst, kind, weight, depth, passed_gate of edges seen.

    starts has a column id. Edges of weight under tau aren't followed; with log_rejected they are events of
    passed_gate = false, and nodes at the last depth are expanded too. Each level joins the newest nodes alone, drops
    those visited by an anti-join and is written, so the plan of a level doesn't contain those before it.
    """
    frontier = save(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    visits, events = frontier, None
    for level in range(depth + log_rejected):
        seen = frontier.join(edges.withColumnRenamed("src", "node"), "node")
        if not log_rejected:
            seen = seen.where(F.col("weight") >= tau)
        seen = save(seen.select("start", F.col("node").alias("src"), "dst", "kind", "weight", F.lit(level + 1).alias("depth"), (F.col("weight") >= tau).alias("passed_gate")))
        events = seen if events is None else events.unionByName(seen)
        if level == depth:
            break
        new = seen.where("passed_gate").select("start", F.col("dst").alias("node")).distinct()
        frontier = save(new.join(visits, ["start", "node"], "left_anti").withColumn("depth", F.lit(level + 1)))
        visits = visits.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visits, events


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*({"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}.get(c, F.col(c)) for c in edges.columns))


def build_events(visits: DataFrame, events: DataFrame, ts_us: int = 0) -> DataFrame:
    """The event table: query, node-visit and edge-traverse rows, with ids that are hashes of what they say."""
    q = visits.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    none = F.lit(None)
    cols = lambda df, kind, src, dst, w, d, ok: df.select(F.col("start").alias("query_id"), F.lit(kind).alias("event_type"), src.alias("src"), dst.alias("dst"), w.cast("double").alias("weight"), d.alias("depth"), ok.cast("boolean").alias("passed_gate"))
    out = cols(q, "QUERY_METADATA", F.col("start"), none.cast("string"), F.col("n"), F.col("depth"), none)
    out = out.unionByName(cols(visits, "NODE_VISIT", F.col("node"), none.cast("string"), none, F.col("depth"), none))
    out = out.unionByName(cols(events, "EDGE_TRAVERSE", F.col("src"), F.col("dst"), F.col("weight"), F.col("depth"), F.col("passed_gate")))
    key = F.concat_ws("|", "query_id", "event_type", "src", "dst", F.col("depth").cast("string"))
    return out.withColumn("event_id", F.substring(F.sha2(key, 256), 1, 16)).withColumn("ts_us", F.lit(ts_us).cast("long"))


def shortest_path(edges: DataFrame, src: str, dst: str, depth: int = 20) -> DataFrame:
    """pos, node of a path of fewest edges, ties by the smaller parent. Empty if there is none within depth."""
    spark = edges.sparkSession
    state = save(spark.createDataFrame([(src, [src])], "node string, path array<string>"))
    seen = state.select("node")
    for _ in range(depth):
        if not state.where(F.col("node") == dst).isEmpty():
            break
        new = state.join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("to")).agg(F.min_by("path", "node").alias("path"))
        state = save(new.join(seen.withColumnRenamed("node", "to"), "to", "left_anti").select(F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path")))
        if state.isEmpty():
            break
        seen = save(seen.union(state.select("node")))
    return state.where(F.col("node") == dst).select(F.posexplode("path").alias("pos", "node"))


def upstream(edges: DataFrame, target: DataFrame, magnitude: DataFrame, hops: int = 2, k: int = 10) -> DataFrame:
    """Sources within hops of each target: score = weight * magnitude * 0.5 ** distance, first visit wins."""
    visits, events = bfs(reverse(edges), target, hops)
    best = events.groupBy("start", F.col("dst").alias("node"), "depth").agg(F.max("weight").alias("weight"))
    first = visits.where("depth > 0").join(best, ["start", "node", "depth"]).join(magnitude.select(F.col("id").alias("node"), "magnitude"), "node", "left")
    first = first.withColumn("score", F.col("weight") * F.coalesce("magnitude", F.lit(0.0)) * F.pow(F.lit(0.5), F.col("depth")))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "node"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k)


def path_decay(edges: DataFrame, depth: int = 5, tau: float = 0.05) -> DataFrame:
    """start, node, product of paths of over `depth` edges whose product of weights is still tau or more (the best)."""
    state = save(edges.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct().withColumn("product", F.lit(1.0)))
    for _ in range(depth + 1):
        step = state.join(edges.select(F.col("src").alias("node"), "dst", "weight"), "node").withColumn("product", F.col("product") * F.col("weight")).where(F.col("product") >= tau)
        state = save(step.groupBy("start", F.col("dst").alias("node")).agg(F.max("product").alias("product")))
    return state
