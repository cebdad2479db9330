"""Costs of steps between states, for planning over energy, direction, friction, distance and intent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import energy as en


def transition_costs(states: DataFrame, edges: DataFrame, intent: list[float] | None = None) -> DataFrame:
    """src, dst, cost, heuristic of each edge between known states (id, energy, friction, mass, vector).

    cost: what the step costs by the vectors' misalignment, the target's friction, the distance and rising energy, less
    the pull of an intent (how far over neutral the target's vector is aligned with it). The heuristic is reported only: paths
    are found by the costs, so they are never dearer than a search's that trusts it.
    """
    side = lambda p: states.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "energy", "friction", "mass", "vector")))
    e = edges.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id")).distinct().join(side("a"), "a_id").join(side("b"), "b_id")
    align, far = en.alignment(F.col("a_vector"), F.col("b_vector")), en.distance(F.col("a_vector"), F.col("b_vector"))
    pull = F.lit(0.0) if intent is None else F.greatest(F.lit(0.0), 2 * en.alignment(F.col("b_vector"), F.array(*(F.lit(float(x)) for x in intent))) - 1)
    cost = en.transition(F.col("b_energy") - F.col("a_energy"), align, F.col("b_friction"), far, pull)
    return e.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.round(cost, 6).alias("cost"), F.round(en.heuristic(far, align, F.col("b_mass"), F.col("b_friction")), 6).alias("heuristic"))


def feasible(states: DataFrame, intent: list[float], most_friction: float = 0.8, least_alignment: float = 0.3, least_coherence: float = 0.2) -> DataFrame:
    """id, score of the states that exploration may enter (id, friction, vector).

    A state without a direction (no vector, or all zeros) is neutral: score 0.5, and friction alone can bar it. Otherwise
    the score is the alignment of its direction with the intent; coherence is the direction's length over 1.5, at most 1.
    """
    wanted = F.array(*(F.lit(float(x)) for x in intent))
    known = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    align, coherence = en.alignment(F.col("vector"), wanted), F.least(F.lit(1.0), en.norm(F.col("vector")) / 1.5)
    good = (F.col("friction") <= most_friction) & (~known | ((align >= least_alignment) & (coherence >= least_coherence)))
    return states.where(good).select("id", F.round(F.when(known, align).otherwise(0.5), 9).alias("score"))
