"""Folds and bounded samples of rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def thinned(rows: DataFrame, bound: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """About `bound` of the rows (all, if there are no more), chosen by a hash of the id."""
    number = rows.select(id_col).count()
    if number <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), _SCALE) < int(_SCALE * bound / number))


def distinct_sample(rows: DataFrame, bound: int) -> DataFrame:
    """text and label of rows of doc_id, h (a hash of the text), text, label: about `bound` of each label at most, even
    where one id has any number of texts."""
    number = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if all(n <= 2 * bound for n in number.values()):
        return rows.select("text", "label")
    most = F.create_map(*(F.lit(x) for label, n in number.items() for x in (label, int(_SCALE * min(1, bound / n)))))
    return rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "h"), _SCALE) < most[F.col("label")]).select("text", "label")
