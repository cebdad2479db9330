"""Energy and direction fields of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import energy as en
from .ranks import running_total


def entropy(weights: DataFrame, key: str, weight: str, kind: str = "log2") -> DataFrame:
    """key, entropy of the shares of weight within each key.

    log2: normalised by log2 of the number; ln_eps: natural with 1e-9 added, normalised by ln of the number; ln_scaled:
    natural, times 0.3; ln: natural, normalised. Fewer than two edges, or no weight at all, give 0.
    """
    total = weights.groupBy(key).agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("n"))
    p = F.col(weight) / F.col("total")
    term = {"log2": -p * F.log2(p), "ln_eps": -p * F.log(p + 1e-9), "ln_scaled": -p * F.log(p), "ln": -p * F.log(p)}[kind]
    rows = weights.join(total, key).where((F.col("total") > 0) & (F.col(weight) > 0))
    h = rows.groupBy(key, "n").agg(F.sum(term).alias("h"))
    size = F.log(F.greatest(F.col("n"), F.lit(2)))
    value = {"log2": F.col("h") / F.log2(F.greatest(F.col("n"), F.lit(2))), "ln_eps": F.col("h") / size, "ln_scaled": 0.3 * F.col("h"), "ln": F.col("h") / size}[kind]
    return h.select(key, F.when(F.col("n") < 2, 0.0).otherwise(value).alias("entropy"))


def pseudo_neighbours(states: DataFrame, group: str, k: int = 10) -> DataFrame:
    """src, dst: of each node the first k others (by id) of its group. The group's first k + 1 serve all its members."""
    first = states.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("id"))).where(F.col("rn") <= k + 1)
    pairs = states.select(F.col("id").alias("src"), group).join(first.select(F.col("id").alias("dst"), group, "rn"), group).where("src != dst")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("rn"))).where(F.col("place") <= k).select("src", "dst")


def runtime_field(states: DataFrame, edges: DataFrame) -> DataFrame:
    """id, magnitude, kernel_role from energy differences to the neighbours (states: id, energy; edges: src, dst)."""
    d = edges.join(states.select(F.col("id").alias("src"), F.col("energy").alias("a")), "src").join(states.select(F.col("id").alias("dst"), F.col("energy").alias("b")), "dst")
    delta = F.col("b") - F.col("a")
    g = d.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.sum(delta * delta)).alias("magnitude"), F.min(delta).alias("low"), F.max(delta).alias("high"))
    g = states.select("id").join(g, "id", "left")
    role = F.when(F.col("magnitude") > 0.1, "not_critical_point").when(F.col("low") > 0, "stable_attractor").when(F.col("high") < 0, "unstable_repeller").otherwise("saddle")
    return g.select("id", F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"), role.alias("kernel_role"))


def gradient(states: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dx, dy, dz, field_magnitude: sum over out-edges of energy difference * unit vector * weight (states: id, energy, x, y, z)."""
    side = lambda p: states.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "energy", "x", "y", "z")))
    d = edges.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"), F.coalesce("weight", F.lit(0.5)).alias("w")).join(side("a"), "a_id").join(side("b"), "b_id")
    diff = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in ("x", "y", "z")}
    length = F.sqrt(sum((v * v for v in diff.values()), F.lit(0.0)))
    pull = F.when(length > 0, (F.col("b_energy") - F.col("a_energy")) * F.col("w") / length).otherwise(0.0)
    g = d.groupBy(F.col("a_id").alias("id")).agg(*(F.sum(pull * v).alias(f"d{c}") for c, v in diff.items()))
    return g.withColumn("field_magnitude", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))


def backward_tension(edges: DataFrame, gravity: DataFrame) -> DataFrame:
    """id, backward_tension (mean in-weight * gravity of the source, 0.5 where unknown, at most 1) and source_diversity."""
    e = edges.join(gravity.select(F.col("id").alias("src"), "gravity"), "src", "left")
    pull = F.col("weight") * F.coalesce("gravity", F.lit(0.5))
    t = e.groupBy(F.col("dst").alias("id")).agg(F.least(F.lit(1.0), F.avg(pull)).alias("backward_tension"))
    return t.join(entropy(edges.select(F.col("dst").alias("id"), "weight"), "id", "weight", "ln"), "id", "left").withColumnRenamed("entropy", "source_diversity")


def with_energy(states: DataFrame, entropies: DataFrame) -> DataFrame:
    """states with potential, energy (capped softly), friction after energy and total."""
    s = states.join(entropies, "id", "left").withColumn("bonus", 0.3 * F.coalesce("entropy", F.lit(0.0)))
    s = s.withColumn("potential", en.potential(F.col("centrality"), F.col("frequency"), F.col("tau_persistence")))
    s = s.withColumn("energy", en.soft_cap(F.col("potential") + F.col("bonus")))
    return s.withColumn("friction", en.adjusted_friction(en.runtime_friction(F.col("tau_persistence"), F.col("structural_noise")), F.col("energy")))


def simulate(paths: DataFrame, key: str = "path_id", pos: str = "pos", e: str = "energy", f: str = "friction") -> DataFrame:
    """Per path: energy_loss, friction_loss, conservation_error, lyapunov (steps that lose energy), stable, divergence, efficiency."""
    w = Window.partitionBy(key).orderBy(pos)
    s = paths.withColumn("before", F.lag(e).over(w))
    drop = F.col("before") - F.col(e)
    g = s.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.min_by(e, pos).alias("first"), F.max_by(e, pos).alias("last"), F.sum(f).alias("friction_loss"), F.sum((drop >= 0).cast("int")).alias("lyapunov_steps"), F.sum(F.abs(drop)).alias("fluctuation"))
    loss = F.col("first") - F.col("last")
    error = F.greatest(F.abs(loss - F.col("friction_loss")), F.greatest(F.lit(0.01), 0.01 * F.col("first"))) + 0.02 * F.col("steps")
    g = g.withColumn("energy_loss", loss).withColumn("conservation_error", error)
    g = g.withColumn("stable", (F.col("energy_loss") >= 0) & (F.col("conservation_error") < 0.1))
    g = g.withColumn("divergence", F.log1p("conservation_error") / (F.log1p("first") + 0.1)).withColumn("efficiency", 1 - F.col("friction_loss") / (F.col("first") + 1e-10))
    ratio = F.when(F.col("fluctuation") > 0, F.least(F.lit(1.0), F.abs(F.col("energy_loss")) / F.col("fluctuation"))).otherwise(1.0)
    return g.withColumn("conservation_ratio", ratio).drop("first", "last")


def rank_energy(states: DataFrame, column: str = "energy") -> DataFrame:
    """energy_rank: place by falling energy over the number of rows, from 0, ties by id."""
    n = states.count()
    ranked = running_total(states.withColumn("one_", F.lit(1)), column, "one_", descending=True, ties="id")
    return ranked.withColumn("energy_rank", (F.col("upto") - 1) / F.lit(max(n, 1))).drop("one_", "upto")


def clamp01(c: Column) -> Column:
    return en.clamp(c, 0.0, 1.0)
