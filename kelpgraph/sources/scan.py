"""Source trees as rows: file discovery, symbols from Python syntax trees, and graph tables from symbols."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.rules import WEIGHTS, _has, first_failure

SYMBOL = "name string, kind string, path string, line int, signature string, docstring string, calls array<string>, imports array<string>, decorators array<string>, inherits array<string>, attributes array<string>, error string"
#: What a scan leaves out.
DEFAULT_IGNORE = [".git/", "__pycache__/", "*.pyc", ".venv/", "venv/", "node_modules/", "dist/", "build/"]
MOST_BYTES = 10 * 1024 * 1024
#: A file with a zero byte among so many first ones is binary.
HEAD_BYTES = 8192
_BUILTINS = frozenset(dir(builtins))


def files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path (under root), content, reason: null for files that pass the gate, else why not."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{py,pyi}").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^.*" + root.rstrip("/").rpartition("/")[2] + "/", "")
    return gated(raw.select(path.alias("path"), "content", "length"), ignore)


def gated(raw: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """path, content, length and reason of files given as rows of the first three."""
    has_nul = F.contains(F.substring("content", 1, HEAD_BYTES), F.lit(b"\0"))
    reason = first_failure({"ignored": text.ignored(F.col("path"), ignore if ignore is not None else DEFAULT_IGNORE), "too_large": F.col("length") > MOST_BYTES, "binary": has_nul})
    return raw.withColumn("reason", reason)


def _name(node: ast.AST) -> str | None:
    """The last part of a called or named expression."""
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else _name(node.func) if isinstance(node, ast.Call) else None


def _row(node: ast.AST, kind: str, path: str) -> dict:
    inside = list(ast.walk(node)) if kind != "class" else []
    called = {_name(n.func) for n in inside if isinstance(n, ast.Call)} - {None} - _BUILTINS
    imports = {a.name for n in inside if isinstance(n, ast.Import) for a in n.names} | {n.module or "." for n in inside if isinstance(n, ast.ImportFrom)}
    signature = f"class {node.name}" if kind == "class" else f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"
    return {
        "name": node.name, "kind": kind, "path": path, "line": node.lineno, "signature": signature, "docstring": ast.get_docstring(node), "calls": sorted(called), "imports": sorted(imports),
        "decorators": [d for d in (_name(x) for x in node.decorator_list) if d], "inherits": [b for b in (_name(x) for x in getattr(node, "bases", [])) if b],
        "attributes": sorted({n.attr for n in inside if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id != "self"}), "error": None,
    }


def parse(source: str, path: str) -> list[dict]:
    """Rows of the classes, functions and methods of a file; functions anywhere inside a class are methods."""
    rows = []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                rows.append(_row(child, "class", path))
                walk(child, True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if in_class else "async_function" if isinstance(child, ast.AsyncFunctionDef) else "function"
                rows.append(_row(child, kind, path))
                walk(child, in_class)
            else:
                walk(child, in_class)

    walk(ast.parse(source), False)
    return rows


def symbols(found: DataFrame) -> DataFrame:
    """Symbols of the files that passed; a file that can't be read or parsed is one row with its error."""
    names = [c.split()[0] for c in SYMBOL.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    rows += parse(bytes(content).decode(), path)
                except (SyntaxError, ValueError) as e:
                    rows.append(dict.fromkeys(names) | {"path": path, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=names)

    return found.where("reason is null").select("path", "content").mapInPandas(run, SYMBOL)


def features(rows: DataFrame) -> DataFrame:
    """symbols with tags from kind, decorators, imports, calls and name, and the risk of locks in asynchronous code."""
    # fixed values: what modules' names tell
    indicators = {
        "async": ["async", "await", "asyncio", "aiohttp", "aiofiles"], "lock": ["lock", "mutex", "semaphore", "rlock", "condition"], "network": ["http", "socket", "requests", "urllib", "aiohttp"],
        "filesystem": ["file", "path", "open", "read", "write", "pathlib"], "database": ["db", "sql", "query", "postgres", "mysql", "sqlite", "asyncpg", "psycopg"], "memory": ["cache", "pool", "buffer", "memory", "mmap"],
    }

    def found(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.exists("lowered", _has(w))
        return out

    has = lambda c, *names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    name = F.lower("name")
    rows = rows.withColumn("lowered", F.transform("imports", lambda x: F.lower(x)))
    rules = {k: found(v) for k, v in indicators.items()}
    rules["lock"] = rules["lock"] | has("calls", "lock", "acquire", "release") | name.contains("lock") | name.contains("mutex")
    rules["async"] = rules["async"] | (F.col("kind") == "async_function") | F.startswith("signature", F.lit("async "))
    rules |= {"raii": has("calls", "__enter__", "__exit__"), "pool": name.contains("pool"), "manager": name.contains("manager"), "factory": name.contains("factory"), "singleton": name.contains("singleton"), "entry_point": name == "main"}
    rules |= {"static": has("decorators", "staticmethod"), "classmethod": has("decorators", "classmethod"), "property": has("decorators", "property"), "dataclass": has("decorators", "dataclass")}
    tags = F.array_compact(F.array(F.col("kind"), *(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items())))
    risk = F.array_compact(F.array(F.when(F.coalesce(rules["async"] & rules["lock"], F.lit(False)), F.lit("async_lock_pattern"))))
    return rows.withColumn("tags", tags).withColumn("risk_anchors", risk).drop("lowered")


def nodes(rows: DataFrame) -> DataFrame:
    """id, type, tags, metadata: one node for a name, of its last place; categories of the tags."""
    last = Window.partitionBy("name").orderBy(F.desc("path"), F.desc("line"))
    own = rows.where("error is null").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    meta = F.to_json(F.struct("kind", "path", "line", "signature", "docstring"))
    cats = rows.where("error is null").select(F.explode("tags").alias("tag")).distinct()
    cats = cats.select(F.concat(F.lit("cat::"), "tag").alias("id"), F.lit("category").alias("type"), F.array("tag").alias("tags"), F.lit("{}").alias("metadata"))
    return own.select(F.concat(F.lit("sym::"), "name").alias("id"), F.lit("symbol").alias("type"), "tags", meta.alias("metadata")).unionByName(cats)


def aliases(rows: DataFrame) -> DataFrame:
    """name, path, line of all places of names that have several."""
    n = rows.where("error is null").select("name", "path", "line").distinct()
    many = n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return n.join(many, "name")


def edges(rows: DataFrame) -> DataFrame:
    """src, dst, kind, weight, layer: calls, imports, bases and attributes, categories both ways, and classes to methods."""
    s = F.concat(F.lit("sym::"), "name")
    rows = rows.where("error is null")
    parts = [("call", "calls", "structural"), ("import", "imports", "structural"), ("inherits", "inherits", "structural"), ("attr_access", "attributes", "noisy")]
    out = None
    for kind, column, layer in parts:
        e = rows.select(s.alias("src"), F.explode(column).alias("to")).select("src", F.concat(F.lit("sym::"), "to").alias("dst"), F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight"), F.lit(layer).alias("layer"))
        out = e if out is None else out.unionByName(e)
    t = rows.select(s.alias("id"), F.explode("tags").alias("tag")).withColumn("cat", F.concat(F.lit("cat::"), "tag"))
    out = out.unionByName(t.select(F.col("id").alias("src"), F.col("cat").alias("dst"), F.lit("category").alias("kind"), F.lit(0.5).alias("weight"), F.lit("semantic").alias("layer")))
    out = out.unionByName(t.select(F.col("cat").alias("src"), F.col("id").alias("dst"), F.lit("semantic_similarity").alias("kind"), F.lit(0.15).alias("weight"), F.lit("semantic").alias("layer")))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("class", F.last(F.when(F.col("kind") == "class", F.col("name")), ignorenulls=True).over(w)).where("kind = 'method' and class is not null")
    held = own.select(F.concat(F.lit("sym::"), "class").alias("src"), s.alias("dst")).distinct()
    n = held.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(n, "src").select("src", "dst", F.lit("contains").alias("kind"), (F.lit(0.1) / F.col("n")).alias("weight"), F.lit("structural").alias("layer"))
    return out.unionByName(held).distinct()


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, state: new, pending (its content changed), done or gone; now and before have path and fingerprint."""
    j = now.select("path", F.col("fingerprint").alias("a")).join(before.select("path", F.col("fingerprint").alias("b")), "path", "full")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "pending").otherwise("done")
    return j.select("path", state.alias("state"))
