"""Regions, couplings and communities of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roles
from ..tables import save


def energy_band(energy: Column, low: float = 2.5, width: float = 0.9, bands: int = 4) -> Column:
    return F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((energy - low) / width))).cast("int")


def assign(states: DataFrame) -> DataFrame:
    """id, region: role and energy band (states: id, role, energy)."""
    return states.select("id", "role", "energy", F.concat_ws("/", "role", energy_band(F.col("energy")).cast("string")).alias("region"))


def merge_small(members: DataFrame, least: int = 50) -> DataFrame:
    """members (id, region) with regions of fewer than `least` put into the largest (ties: first name), all in one step;
    the number of regions is what is small, so the target is found on their counts."""
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    largest = size.agg(F.min(F.struct((-F.col("size")).alias("n"), "region")).alias("m")).select(F.col("m.region").alias("target"))
    joined = members.join(size, "region").crossJoin(F.broadcast(largest))  # of one row
    return joined.withColumn("region", F.when(F.col("size") < least, F.col("target")).otherwise(F.col("region"))).drop("size", "target")


def coupling(edges: DataFrame, members: DataFrame) -> DataFrame:
    """region_a, region_b, crossing, weight: edges between regions by direction."""
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("region").alias(name))
    e = edges.select("src", "dst", "weight").join(side("src", "region_a"), "src").join(side("dst", "region_b"), "dst").where("region_a != region_b")
    return e.groupBy("region_a", "region_b").agg(F.count(F.lit(1)).alias("crossing"), F.sum("weight").alias("weight"))


def stable_id(entries: Column, archetype: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(entries), ","), archetype, roles.size_tier(size)), 256), 1, 12)


def shared_targets(reach: DataFrame, least: int = 2) -> DataFrame:
    """a, b, shared: pairs of starts that reach `least` targets in common (reach: start, node, few for each target)."""
    x, y = reach.select(F.col("start").alias("a"), "node"), reach.select(F.col("start").alias("b"), "node")
    return x.join(y, "node").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by label propagation: each round a node takes the label of most weight around it, ties and itself
    towards the smaller label; deterministic. Sums of weight by (node, label) are made before any shuffle."""
    both = save(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    state = save(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.round("w", 9)).alias("n"), "community")).alias("b"))
        new = save(state.join(best, "id").select("id", F.col("b.community").alias("new"), "community"))
        state = new.select("id", F.col("new").alias("community"))
        if new.where("new != community").isEmpty():
            break
    return state


def dominant(members: DataFrame, by: str, of: str) -> DataFrame:
    """by, <of> (the most frequent, ties: first), purity."""
    n = members.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(by).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), of)).alias("b"))
    return g.select(by, F.col(f"b.{of}").alias(of), (-F.col("b.k") / F.col("total")).alias("purity"))


def entry_points(states: DataFrame, region: str = "region", attractors: int = 3, most: int = 5) -> DataFrame:
    """region, rank, id: up to 3 attractors by energy, then others by centrality * (1 + .1 * min(energy, 5)), 5 in all."""
    score = F.col("centrality") * (1 + 0.1 * F.least(F.col("energy"), F.lit(5.0)))
    a = states.where("attractor").withColumn("rn", F.row_number().over(Window.partitionBy(region).orderBy(F.desc("energy"), "id"))).where(F.col("rn") <= attractors).select(region, "id", "rn")
    rest = states.join(a.select("id"), "id", "left_anti").withColumn("score", F.round(score, 9))
    rest = rest.withColumn("rn", 100 + F.row_number().over(Window.partitionBy(region).orderBy(F.desc("score"), "id"))).where(F.col("rn") <= 100 + most).select(region, "id", "rn")
    rank = F.row_number().over(Window.partitionBy(region).orderBy("rn"))
    return a.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= most).select(region, "rank", "id")


def empty_cells(points: DataFrame, size: int = 10, share: float = 0.1) -> DataFrame:
    """x, y, n of the cells of a size * size grid over the points with fewer than share of the mean."""
    x0, x1, y0, y1, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    cell = lambda c, a, b: F.least(F.lit(size - 1), F.floor((F.col(c) - a) / (((b or 0) - (a or 0)) or 1.0) * size)).cast("int")
    counts = points.groupBy(cell("x", x0 or 0, x1).alias("x"), cell("y", y0 or 0, y1).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = points.sparkSession.range(size * size).select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    return grid.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < share * n / (size * size))
