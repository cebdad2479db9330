"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session's context, once."""
    context = spark.sparkContext
    if getattr(context, "_kelpgraph_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="kelpgraph-")) / "kelpgraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            if "fixtures" not in file.parts:
                z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(target))
    context._kelpgraph_shipped = True
