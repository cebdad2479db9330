"""Beam exploration: a level is a join with the feasible neighbours and a greedy choice within each start's candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structure as st
from ..tables import save


def explore(edges: DataFrame, nodes: DataFrame, starts: DataFrame, *, width: int = 5, steps: int = 5, neighbours: int = 20, alike: float = 0.6) -> DataFrame:
    """start, rank, path, score: the paths of each start after `steps` levels, or when none could be extended.

    nodes: id and score of those that may be entered (see planner.feasible); a path's score is its last node's. At each
    level every path of the beam is extended to its last node's `neighbours` strongest neighbours that it doesn't hold.
    If more than `width` candidates are left, those whose nodes share over `alike` (Jaccard) with a better one are passed
    over, and if under half the beam is filled then, the best of those fill it. A start whose paths all end keeps them as
    they are; one that can't be left has none. Ties go by the path. A start has at most width * neighbours candidates.
    """

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame.score, frame.path, strict=True), key=lambda x: (-x[0], list(x[1])))
        kept = rows
        if len(rows) > width:
            kept, sets, rest = [], [], []
            for row in rows:
                nodes_ = set(row[1])
                if len(kept) < width and not any(len(nodes_ & k) > alike * len(nodes_ | k) for k in sets):
                    kept.append(row)
                    sets.append(nodes_)
                else:
                    rest.append(row)
            if len(kept) < width // 2:
                kept += rest[: width - len(kept)]
        return pd.DataFrame([(frame.start.iloc[0], list(p), s) for s, p in kept], columns=["start", "path", "score"])

    beams = save(starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.lit(0.0).alias("score")).distinct())
    step = save(st.strongest(edges, neighbours).select(F.col("src").alias("node"), "dst").distinct().join(nodes.select(F.col("id").alias("dst"), F.col("score").alias("s")), "dst"))
    for level in range(steps):
        open_ = beams.where(F.size("path") == level + 1)
        moved = open_.withColumn("node", F.element_at("path", -1)).join(step, "node").where(~F.array_contains("path", F.col("dst")))
        moved = moved.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("s").alias("score"))
        new = save(moved.groupBy("start").applyInPandas(thin, "start string, path array<string>, score double"))
        if new.isEmpty():
            break
        beams = save(beams.join(new.select("start").distinct(), "start", "left_anti").unionByName(new))
    out = beams.where(F.size("path") > 1).groupBy("start").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "path"))).alias("all"))
    return out.select("start", F.posexplode("all").alias("pos", "x")).select("start", (F.col("pos") + 1).alias("rank"), "x.path", (-F.col("x.n")).alias("score"))
