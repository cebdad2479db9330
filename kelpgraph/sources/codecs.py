"""Text formats: shadow files of atoms, rules on atoms, graph exports, and registries by version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import save

MOST_ATOMS = 50


@dataclass
class Shelf:
    """Files kept as a table of rows (file, value, ..): written whole, listed, and less some."""

    rows: DataFrame

    @classmethod
    def write(cls, rows: DataFrame) -> Shelf:
        return cls(save(rows))

    def listed(self) -> DataFrame:
        return self.rows.select("file")

    def without(self, files: DataFrame) -> Shelf:
        return Shelf(save(self.rows.join(files.select("file").distinct(), "file", "left_anti")))


def read_shadows(spark: SparkSession, path: str) -> DataFrame:
    """file, header map, atoms array<struct<line, op, arg, fin>>, truncated of shadow files, one row for each."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return raw.select("file", *parse_shadow(F.col("value")))


def parse_shadow(value: Column) -> tuple[Column, Column, Column]:
    heads = F.regexp_extract_all(value, F.lit(r"(?m)^(@[A-Z]+) "), 1)
    texts = F.regexp_extract_all(value, F.lit(r"(?m)^@[A-Z]+ (.*)$"), 1)
    found = F.regexp_extract_all(value, F.lit(r"(L\d+:[A-Z]+\([^)]*\)(?:\[f:[YN]\])?);"), 1)
    part = lambda a, p: F.regexp_extract(a, p, 1)
    atoms = F.transform(found, lambda a: F.struct(part(a, r"^L(\d+)").cast("int").alias("line"), part(a, r":([A-Z]+)\(").alias("op"), part(a, r"\(([^)]*)\)").alias("arg"), (part(a, r"\[f:([YN])\]") == "Y").alias("fin")))
    return F.map_from_arrays(heads, texts).alias("header"), atoms.alias("atoms"), value.contains("TRUNCATED").alias("truncated")


def write_shadow(rows: DataFrame) -> DataFrame:
    """file, value of rows of file, header (map) and atoms: at most 50 of them, then a mark."""
    head = F.array_join(F.transform(F.array_sort(F.map_entries("header")), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), "\n")
    body = F.array_join(F.transform(F.slice("atoms", 1, MOST_ATOMS), lambda a: F.concat(F.lit("L"), a["line"].cast("string"), F.lit(":"), a["op"], F.lit("("), a["arg"], F.lit(")"), F.when(a["fin"].isNotNull(), F.when(a["fin"], F.lit("[f:Y]")).otherwise(F.lit("[f:N]"))).otherwise(F.lit("")), F.lit(";"))), "\n")
    mark = F.when(F.size("atoms") > MOST_ATOMS, F.lit("\nTRUNCATED")).otherwise(F.lit(""))
    return rows.select("file", F.concat(head, F.lit("\n"), body, mark).alias("value"))


def to_dot(edges: DataFrame) -> DataFrame:
    """One row, dot: lines of the edges in order; for exports of graphs that fit a row."""
    line = F.format_string('  "%s" -> "%s" [weight=%.3f];', "src", "dst", "weight")
    return edges.select(line.alias("l")).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit("\n}")).alias("dot"))


def to_jsonl(edges: DataFrame, path: str) -> None:
    edges.select(F.to_json(F.struct(*edges.columns)).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): malformed lines are kept apart instead of ending the read."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record is null").drop("_corrupt_record"), raw.where("_corrupt_record is not null").select("_corrupt_record")


def latest(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key (snapshots, upserts); ties by the whole row."""
    rest = [c for c in versions.columns if c not in (*key, order)]
    best = versions.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("b"))
    return best.select(*key, F.col(f"b.{order}").alias(order), *(F.col(f"b.{c}").alias(c) for c in rest))


def import_if_empty(target: DataFrame, legacy: DataFrame, valid: Column) -> DataFrame:
    """target, or the valid rows of legacy if it is empty."""
    return legacy.where(valid) if target.isEmpty() else target


def parse_dsl(lines: DataFrame) -> DataFrame:
    """n, op, arg, note, error of lines of the atom language: OP(arg) [note]."""
    op, arg = F.regexp_extract("value", r"^\s*([A-Z]{3})\(", 1), F.regexp_extract("value", r"\(([^)]*)\)", 1)
    error = F.when(op == "", "syntax").when(~op.isin("ACQ", "REL", "AWT", "RET", "CAL", "RD", "WRT"), "unknown_op").when((arg == "") & (op != "RET"), "no_argument")
    return lines.select("n", op.alias("op"), arg.alias("arg"), F.regexp_extract("value", r"\[([^\]]*)\]", 1).alias("note"), error.alias("error"))


def balance(atoms: DataFrame) -> DataFrame:
    """arg, held: acquisitions less releases at the end; and the least on the way."""
    step = F.when(F.col("op") == "ACQ", 1).when(F.col("op") == "REL", -1).otherwise(0)
    run = atoms.withColumn("held", F.sum(step).over(Window.partitionBy("arg").orderBy("n")))
    return run.groupBy("arg").agg(F.max_by("held", "n").alias("held"), F.min("held").alias("least"))


def skeletons(atoms: DataFrame) -> DataFrame:
    """thread, code: a function for each thread, with its operations in order."""
    line = F.concat(F.lit("    "), "arg", F.when(F.col("op") == "ACQ", ".acquire()").otherwise(".release()"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    return atoms.groupBy("thread").agg(body.alias("body")).select("thread", F.concat(F.lit("def "), "thread", F.lit("():\n"), "body").alias("code"))
