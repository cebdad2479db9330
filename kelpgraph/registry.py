"""Where query modules put their queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def half_up(x: Column, digits: int = 6) -> Column:
    """x rounded as SQL twins do: the double x * 10^digits to the nearest whole number, halves away from zero, and back.
    The sign stays, so a small negative number is -0.0, which Spark's round makes 0.0."""
    y = F.abs(x) * 10.0**digits
    low = F.floor(y).cast("double")
    whole = F.when(y < 2.0**52, low + (y - low >= 0.5).cast("double")).otherwise(y)
    return F.when(F.isnan(x) | (y == float("inf")), x).otherwise(F.signum(x) * whole / 10.0**digits)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})
