"""Driver loops over tables: each round is a join and a grouping whose result is written, so plans stay flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import save


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame | None], rounds: int) -> tuple[DataFrame, int]:
    """Applies step until it returns None or rounds are over; (state, rounds done)."""
    for k in range(rounds):
        new = step(state, k)
        if new is None:
            return state, k
        state = new
    return state, rounds


def trimmed(edges: DataFrame) -> DataFrame | None:
    """Edges (src, dst) whose ends both have edges in and out, again and again; None if nothing is left."""
    before = -1
    while True:
        edges = save(edges)
        now = edges.count()
        if not now:
            return None
        if now == before:
            return edges
        before = now
        both = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        edges = edges.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi")


class reach:  # noqa: N801
    """Label spreading for strongly connected components."""

    @staticmethod
    def colours(edges: DataFrame) -> DataFrame:
        """id, colour: the smallest id that reaches the node."""
        state = save(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("colour", F.col("id")))
        while True:
            came = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("came"))
            new = save(state.join(came, "id", "left").select("id", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("changed")))
            state = new.select("id", "colour")
            if new.where("changed").isEmpty():
                return state

    @staticmethod
    def back(edges: DataFrame, colour: DataFrame) -> DataFrame:
        """id, component: nodes that reach the root of their colour within it."""
        inside = edges.join(colour.withColumnsRenamed({"id": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"id": "dst", "colour": "b"}), "dst").where("a = b").select("src", "dst")
        inside = save(inside)
        found = save(colour.where("id = colour").withColumnRenamed("colour", "component"))
        last = found
        while True:
            new = save(inside.join(last.select(F.col("id").alias("dst"), "component"), "dst").select(F.col("src").alias("id"), "component").distinct().join(found, "id", "left_anti"))
            if new.isEmpty():
                return found
            found, last = save(found.unionByName(new)), new

    @staticmethod
    def without(edges: DataFrame, part: DataFrame) -> DataFrame:
        gone = part.select("id")
        return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
