"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

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


_STORED: dict[tuple[str, str], tuple[str, StructType, str]] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files at a path: it changes when they do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return "|".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found))


def fresh(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name made from the files at source: made and written when the application first asks for it,
    and again when the files have changed or what was written is gone."""
    key, now = (spark.sparkContext.applicationId, f"{name} {source}"), state(spark, source)
    if key not in _STORED or _STORED[key][2] != now or not _exists(spark, _STORED[key][0]):
        frame, path = make(), f"{folder(spark)}/stored-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        _STORED[key] = (path, frame.schema, now)
    path, schema, _ = _STORED[key]
    return spark.read.schema(schema).parquet(path)
