"""Running totals and ranks over a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 200


def running_total(rows: DataFrame, order: str, amount: str, *, descending: bool = False, ties: str | None = None, parts: int = PARTS) -> DataFrame:
    """rows with upto: the sum of amount in order of a numeric column (ties by another) up to and with the row.

    Approximate quantiles cut the order into so many parts of like size; each is summed by itself, and the parts' sums,
    a row each, say where it begins. Equal values of the order share a part.
    """
    bounds = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    part = F.size(F.filter(cuts, lambda b: b < F.col(order)))
    rows = rows.withColumn("part_", -part if descending else part)
    sums = rows.groupBy("part_").agg(F.sum(amount).alias("sum_"))
    before = sums.select("part_", (F.sum("sum_").over(Window.orderBy("part_")) - F.col("sum_")).alias("before_"))  # at most PARTS rows
    by = F.desc(order) if descending else F.asc(order)
    own = Window.partitionBy("part_").orderBy(by, *([ties] if ties else [])).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own_", F.sum(amount).over(own)).join(F.broadcast(before), "part_").withColumn("upto", F.col("own_") + F.col("before_")).drop("part_", "own_", "before_")
