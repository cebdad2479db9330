"""Versions of stored tables: steps from each version to the next, run on what is older."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import roles

#: version -> what brings a registry from the one before to it.
REGISTRY: dict[int, Callable[[DataFrame], DataFrame]] = {
    2: lambda df: df.withColumn("node_type", roles.node_type(F.col("kind"))),
    3: lambda df: df.withColumn("gravity", F.lit(0.5)),
}


def migrate(frame: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, int]:
    """The frame at the newest version, and that version. Steps up to `version` have been done."""
    for to in sorted(v for v in steps if v > version):
        frame, version = steps[to](frame), to
    return frame, version
