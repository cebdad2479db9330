"""Symbols of TypeScript text by patterns: what is declared at the start of a line, without a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
PATTERNS = {
    "class": _START + r"(?:abstract\s+)?class\s+(\w+)",
    "interface": _START + r"interface\s+(\w+)",
    "enum": _START + r"(?:const\s+)?enum\s+(\w+)",
    "type": _START + r"type\s+(\w+)\s*(?:<[^>]*>)?\s*=",
    "async_function": _START + r"async\s+function\s*\*?\s*(\w+)",
    "function": _START + r"function\s*\*?\s*(\w+)",
    "arrow_function": _START + r"(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>",
}
IMPORT = r"""(?m)^\s*import\b[^'"\n]*['"]([^'"]+)['"]"""


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind of each declaration in files of path and text."""

    def declared(kind: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 1), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*map(declared, PATTERNS)))
    return files.select("path", F.inline(found))


def imports(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.regexp_extract_all("text", F.lit(IMPORT), 1)).alias("module"))
