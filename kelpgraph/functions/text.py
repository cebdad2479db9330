"""Text, path and hash functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(token: Column) -> Column:
    return F.lower(F.trim(token))


def fingerprint(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def uid(namespace: Column, name: Column) -> Column:
    h = F.substring(F.sha2(F.concat(namespace, F.lit("::"), name), 256), 1, 16)
    return F.concat_ws("::", F.lit("sym"), F.replace(namespace, F.lit("/"), F.lit(".")), name, h)


def crc_hex(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("py", "pyi"), "python").when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("js", "jsx", "cjs"), "javascript").when(ext == "sql", "sql").otherwise("unknown")


def module(path: Column) -> Column:
    """src/a/b.py is src.a.b; a package's __init__ is the package."""
    dotted = F.replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def short_name(symbol: Column) -> Column:
    parts = F.split(symbol, "::")
    return F.when(F.size(parts) >= 4, F.concat(F.lit("sym::"), F.element_at(parts, 3))).otherwise(symbol)


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: ** any path, * within a part, ? one character."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif pattern[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + (("\\" + pattern[k]) if pattern[k] in r".+()[]{}^$|\\" else pattern[k]), k + 1
    return f"^(?:.*/)?{out}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it; a rule that begins with ! keeps what it matches."""
    out = F.lit(False)
    for rule in rules:
        keep, pattern = rule.startswith("!"), rule.lstrip("!")
        out = F.when(path.rlike(glob(pattern + "**" if pattern.endswith("/") else pattern)), F.lit(not keep)).otherwise(out)
    return out


def fidelity(found: Column, source: Column) -> Column:
    defs = F.regexp_count(source, F.lit(r"(?m)^\s*(?:async\s+def|def|class)\s"))
    return F.when(defs == 0, 1.0).otherwise(F.least(F.lit(1.0), found / defs))
