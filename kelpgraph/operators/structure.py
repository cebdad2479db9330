"""Degrees, centralities, triangles, curvature and roles of a weighted directed graph.

nodes have a column id; edges have src, dst and weight. All measures are groupings with partial aggregation and
equi-joins on node ids; none gathers a node's neighbours, and hubs cost a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save
from .ranks import running_total


def ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: id, o and i (1 for the end that it leaves or enters), and the weight there."""
    none = F.lit(None).cast("double")
    a = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("wo"), none.alias("wi"))
    return a.unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), none.alias("wo"), F.col("weight").alias("wi")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree (edges, repeated ones too), out_weight, in_weight."""
    zero = F.lit(0.0)
    return ends(edges).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.coalesce(F.sum("wo"), zero).alias("out_weight"), F.coalesce(F.sum("wi"), zero).alias("in_weight"))


def with_maximum(rows: DataFrame, *columns: str) -> DataFrame:
    """The greatest of each column beside it as max_<column>: one row, joined, instead of a window over everything."""
    return rows.crossJoin(F.broadcast(rows.agg(*(F.max(c).alias(f"max_{c}") for c in columns))))  # of one row


def proxy_betweenness(i: Column, o: Column) -> Column:
    return F.when(i + o > 0, i * o / (i + o)).otherwise(F.lit(0.0))


def clustering(edges: DataFrame) -> DataFrame:
    """id, links: edges among a node's successors."""
    e = edges.select("src", "dst").distinct()
    a, b = e.select(F.col("src").alias("id"), F.col("dst").alias("x")), e.select(F.col("src").alias("id"), F.col("dst").alias("y"))
    pairs = a.join(b, "id").join(e.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("links"))


def features(edges: DataFrame) -> DataFrame:
    """degrees with centrality (out weight over the greatest), betweenness (its degree proxy, likewise) and clustering."""
    d = degrees(edges).withColumn("proxy", proxy_betweenness(F.col("in_degree"), F.col("out_degree")))
    d = with_maximum(d, "out_weight", "proxy")
    share = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(F.col(x))
    d = d.withColumn("centrality", share("out_weight", "max_out_weight")).withColumn("betweenness", share("proxy", "max_proxy"))
    links = F.coalesce("links", F.lit(0)) / F.greatest(F.lit(1), F.col("out_degree") * (F.col("out_degree") - 1))
    return d.join(clustering(edges), "id", "left").withColumn("clustering", links).drop("proxy", "max_out_weight", "max_proxy", "links")


def variation(edges: DataFrame) -> DataFrame:
    """id, entry_variance (population variance of in-weights over their mean squared) and structural_noise (population
    deviation of out-weights over their mean), both at most 1 and 0 for under two edges."""
    g = ends(edges).groupBy("id").agg(F.count("wi").alias("ni"), F.avg("wi").alias("mi"), F.var_pop("wi").alias("vi"), F.count("wo").alias("no"), F.avg("wo").alias("mo"), F.stddev_pop("wo").alias("so"))
    one = F.lit(1.0)
    entry = F.when((F.col("ni") >= 2) & (F.col("mi") > 0), F.least(one, F.col("vi") / (F.col("mi") * F.col("mi")))).otherwise(0.0)
    noise = F.when((F.col("no") >= 2) & (F.col("mo") > 0), F.least(one, F.col("so") / F.col("mo"))).otherwise(0.0)
    return g.select("id", entry.alias("entry_variance"), noise.alias("structural_noise"))


def states(edges: DataFrame) -> DataFrame:
    """features, variation, tau_persistence (mean out-weight, at most 1) and frequency (a visit count by degrees)."""
    f = features(edges).join(variation(edges), "id", "left")
    tau = F.least(F.lit(1.0), F.col("out_weight") / F.greatest(F.lit(1), F.col("out_degree")))
    return f.withColumn("tau_persistence", tau).withColumn("frequency", F.col("in_degree") * 7 + F.col("out_degree"))


def topology_role(i: Column, o: Column, centrality: Column, betweenness: Column, clustering_: Column) -> tuple[Column, Column]:
    """(role, score): the first greatest of the scores of hub, bridge, sink and leaf."""
    part = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    ratio = F.least(i, o) / F.greatest(i, o)
    scores = {
        "hub": part(o > 10, 0.4) + part(centrality > 0.7, 0.3) + part(clustering_ < 0.3, 0.3),
        "bridge": part(betweenness > 0.5, 0.5) + part((i > 0) & (o > 0), 0.5 * ratio),
        "sink": part((i > 5) & (o < 3), 0.6) + part(i > 2 * o, 0.4),
        "leaf": part(i + o <= 2, 0.7) + part(o == 0, 0.3),
    }
    best = F.greatest(*scores.values())
    role = F.lit("leaf")
    for name in ("sink", "bridge", "hub"):
        role = F.when(scores[name] == best, F.lit(name)).otherwise(role)
    return role, best


def node_role(i: Column, o: Column) -> Column:
    return F.when((i == 0) & (o == 0), "isolated").when(o == 0, "sink").when(i == 0, "source").when((i >= 10) & (o >= 10), "hub").when((i >= 5) & (o >= 5), "bridge").otherwise("leaf")


def triangles(edges: DataFrame) -> DataFrame:
    """For each distinct edge u, v: transitive (common successors) and feedback (w with v to w and w to u)."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    common = e.join(e.select("u", F.col("v").alias("w")), "u").join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("transitive"))
    back = e.join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(e.select(F.col("u").alias("w"), F.col("v").alias("u")), ["w", "u"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("feedback"))
    zero = F.lit(0)
    return e.join(common, ["u", "v"], "left").join(back, ["u", "v"], "left").select("u", "v", F.coalesce("transitive", zero).alias("transitive"), F.coalesce("feedback", zero).alias("feedback"))


def curvature(edges: DataFrame) -> DataFrame:
    """Forman-Ricci curvature of each distinct edge: raw = 4 - degrees + 3 * transitive triangles, norm, boundary."""
    d = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    t = triangles(edges).join(d.withColumnsRenamed({"id": "u", "degree": "du"}), "u").join(d.withColumnsRenamed({"id": "v", "degree": "dv"}), "v")
    raw = 4 - F.col("du") - F.col("dv") + 3 * F.col("transitive")
    t = t.withColumn("raw", raw).withColumn("norm", F.col("raw") / (1 + F.greatest("du", "dv")))
    return t.select("u", "v", "transitive", "feedback", "raw", "norm", (F.col("norm") < -0.5).alias("is_boundary"))


def friction(ricci: Column) -> Column:
    return F.exp(F.least(F.lit(5.0), -0.5 * ricci))


def percentiles(rows: DataFrame, *metrics: str) -> DataFrame:
    """pct_<metric>: the share of values not above the row's.

    Ranks come from counts of distinct values and their running sum, which no single task holds. The rows are written
    first: each metric reads them, and they are joined with all ranks.
    """
    rows = save(rows)
    total = rows.count()
    out = rows
    for m in metrics:
        counts = rows.groupBy(m).agg(F.count(F.lit(1)).alias("k"))
        out = out.join(running_total(counts, m, "k").select(m, (F.col("upto") / F.lit(total)).alias(f"pct_{m}")), m)
    return out


def normaliser(edges: DataFrame) -> DataFrame:
    """Weights of edges out of hubs (over 10 from a category, over 50 from a symbol) divided by log10(out + 1)."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    hub = (F.col("src").startswith("cat::") & (F.col("out") > 10)) | (F.col("src").startswith("sym::") & (F.col("out") > 50))
    return edges.join(d, "src").withColumn("weight", F.when(hub, F.col("weight") / F.log10(F.col("out") + 1.0)).otherwise(F.col("weight"))).drop("out")


def strongest(edges: DataFrame, k: int, only_above: int | None = None) -> DataFrame:
    """Of each node's edges the k of greatest weight (ties: smaller dst), but all if there are no more than only_above."""
    w = Window.partitionBy("src")
    out = edges.withColumn("rn", F.row_number().over(w.orderBy(F.desc("weight"), "dst")))
    if only_above is None:
        return out.where(F.col("rn") <= k).drop("rn")
    return out.withColumn("out", F.count(F.lit(1)).over(w)).where((F.col("rn") <= k) | (F.col("out") <= only_above)).drop("rn", "out")


def adaptive_gate(rows: DataFrame, group: str, value: str, factor: float = 0.5, uniform: float = 0.01) -> DataFrame:
    """threshold = mean + k * deviation with k = factor * (1 + deviation / mean), 0 for a uniform group; passed."""
    s = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))
    k = F.when((F.col("dev") < uniform) | (F.col("mean") == 0), 0.0).otherwise(factor * (1 + F.col("dev") / F.col("mean")))
    s = s.withColumn("threshold", F.col("mean") + k * F.col("dev"))
    return rows.join(s, group).withColumn("passed", F.col(value) >= F.col("threshold"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids (column id)."""
    out = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return out.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def scc(edges: DataFrame) -> DataFrame:
    """Strongly connected components (id, component: its smallest id) of nodes that lie on a cycle.

    First nodes without edges in or out are trimmed until none is left, which is all of an acyclic part; then colours
    (the smallest id that reaches a node) spread forward, and what reaches a colour's root backward within it is a
    component; that is taken out and the rest goes on.
    """
    from ..plans.loops import reach, trimmed

    left, found = trimmed(edges.select("src", "dst").where("src != dst").distinct()), None
    while left is not None and not left.isEmpty():
        colour = reach.colours(left)
        part = reach.back(left, colour)
        found = part if found is None else found.unionByName(part)
        left = trimmed(reach.without(left, part))
    return found if found is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
