"""Chains of frame transforms, verified on one row before they run, and normalisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def chain(frame: DataFrame, steps: list[tuple[int, Transform]]) -> DataFrame:
    """Applies the steps in order of their priorities, the lowest first."""
    for _, step in sorted(steps, key=lambda s: s[0]):
        frame = frame.transform(step)
    return frame


def verified(step: Transform, sample: DataFrame, needs: list[str], gives: list[str]) -> Transform:
    """The step, if on an empty frame of the sample's schema it finds what it needs and makes what it promises."""
    missing = [c for c in needs if c not in sample.columns]
    if missing:
        raise ValueError(f"input lacks {missing}")
    made = step(sample.limit(0)).columns
    if absent := [c for c in gives if c not in made]:
        raise ValueError(f"output lacks {absent}")
    return step


def normalised(rows: DataFrame, key: str, value: str) -> DataFrame:
    """minmax and softmax of value within key, from sums made before the shuffle."""
    g = rows.groupBy(key).agg(F.min(value).alias("low_"), F.max(value).alias("high_"), F.sum(F.exp(value)).alias("total_"))
    j = rows.join(g, key)
    minmax = (F.col(value) - F.col("low_")) / F.greatest(F.lit(1e-12), F.col("high_") - F.col("low_"))
    return j.withColumn("minmax", minmax).withColumn("softmax", F.exp(value) / F.col("total_")).drop("low_", "high_", "total_")
