"""Intermediate tables in the folder that all executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset on a single machine, as in tests."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kelpgraph-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def save(frame: DataFrame) -> DataFrame:
    """Writes the frame as Parquet and reads it back from there."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes tables that save() returned, once all that reads them is written."""
    for frame in frames:
        jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
        for file in frame.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)
