"""Scanning queries: each symbol of the tables is written as source text, which is parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import symbols, with_views
from ..functions import code_tags as ct
from ..functions import text
from ..operators import rules as rl
from ..registry import query
from ..sources import scan, typescript
from ..tables import fresh

BODIES = {
    "io": "def {name}(x):\n    import pathlib\n    return x.read_text()\n",
    "network": "def {name}(x):\n    import requests\n    return requests.get(save_{p}(x))\n",
    "database": 'def {name}(x):\n    return x.execute("SELECT 1", save_{p}(x))\n',
    "config": "def {name}(x):\n    import json\n    return json.loads(x)\n",
    "util": '@app.route("/x")\ndef {name}(x):\n    return x\n',
    "test": "@pytest.fixture\ndef {name}(x):\n    import pytest\n    return pytest.mock(x)\n",
}
CLASS = "class {role}_{name}(Base):\n    def save_{s}(self, x):\n        return self.commit(x)\n"
ENTER = "    def __enter__(self):\n        return self\n"
METHOD = "class Of_{k}:\n    def {name}(self):\n        return self.fetch()\n"
ASYNC = "async def {name}(x):\n    import aiohttp\n    async with x.lock() as y:\n        return await fetch(y)\n"


def written(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols with s (the number in their path), k (the number of their id) and code, their text."""
    d = symbols(spark, sf).withColumn("s", F.regexp_extract("path", r"mod_(\d+)", 1)).withColumn("k", F.replace("id", F.lit("sym::"), F.lit("")))

    def fill(template: str) -> Column:
        out = F.lit(template)
        for c, value in {"name": F.col("name"), "s": F.col("s"), "p": (F.col("s").cast("int") - 1).cast("string"), "k": F.col("k"), "role": F.initcap("role")}.items():
            out = F.replace(out, F.lit("{" + c + "}"), value)
        return out

    body = F.lit("")
    for intent, template in BODIES.items():
        body = F.when(F.col("intent") == intent, fill(template)).otherwise(body)
    own = F.concat(fill(CLASS), F.when(F.col("intent") == "database", ENTER).otherwise(""))
    return d.withColumn("code", F.when(F.col("kind") == "class", own).when(F.col("kind") == "method", fill(METHOD)).when(F.col("kind") == "async_function", fill(ASYNC)).otherwise(body))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """path, content, length, reason: a file of the symbols of each path, in order. Some are ignored, some begin with a zero
    byte (further on in a long file the gate, which reads 8 KiB, needn't see it), and some don't parse."""
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "code"))), lambda x: x["code"]), "\n")
    f = written(spark, sf).groupBy("path", F.col("s").cast("int").alias("s")).agg(code.alias("code"))
    f = f.withColumn("code", F.concat(F.when(F.col("s") % 10 == 7, F.chr(F.lit(0))).otherwise(""), "code", F.when(F.col("s") % 25 == 0, "def (:\n").otherwise("")))
    path = F.concat(F.when(F.col("s") % 10 == 3, "build/").otherwise(""), "path")
    return scan.gated(f.select(path.alias("path"), F.col("code").cast("binary").alias("content"), F.octet_length("code").cast("long").alias("length")))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols that the scanner finds in the files; kept, as a scan's rows are."""
    return fresh(spark, "scan", f"{sf}/part.parquet", lambda: scan.features(scan.symbols(sources(spark, sf))))


#: The same from the tables: src, the files; decl, what they declare.
SRC = "src AS (SELECT *, regexp_extract(path, 'mod_([0-9]+)', 1)::INT AS s, replace(id, 'sym::', '') AS k, upper(role[1]) || role[2:] || '_' || name AS class FROM symbols)"
GOOD = "good AS (SELECT * FROM src WHERE s % 10 NOT IN (3, 7) AND s % 25 <> 0)"
NONE = "[]::VARCHAR[]"
DECL = f"""{SRC}, {GOOD}, decl AS (
    SELECT class AS name, 'class' AS kind, path, {NONE} AS calls, {NONE} AS imports, {NONE} AS attrs, class AS own, NULL AS owner, role, intent FROM good WHERE kind = 'class'
    UNION ALL SELECT 'save_' || s, 'method', path, ['commit'], {NONE}, {NONE}, NULL, class, role, intent FROM good WHERE kind = 'class'
    UNION ALL SELECT '__enter__', 'method', path, {NONE}, {NONE}, {NONE}, NULL, class, role, intent FROM good WHERE kind = 'class' AND intent = 'database'
    UNION ALL SELECT 'Of_' || k, 'class', path, {NONE}, {NONE}, {NONE}, NULL, NULL, role, intent FROM good WHERE kind = 'method'
    UNION ALL SELECT name, 'method', path, ['fetch'], {NONE}, {NONE}, NULL, 'Of_' || k, role, intent FROM good WHERE kind = 'method'
    UNION ALL SELECT name, 'async_function', path, ['fetch', 'lock'], ['aiohttp'], ['lock'], NULL, NULL, role, intent FROM good WHERE kind = 'async_function'
    UNION ALL SELECT name, 'function', path,
        CASE intent WHEN 'io' THEN ['read_text'] WHEN 'network' THEN ['get', 'save_' || (s - 1)] WHEN 'database' THEN ['execute', 'save_' || (s - 1)] WHEN 'config' THEN ['loads'] WHEN 'util' THEN ['route'] ELSE ['mock'] END,
        CASE intent WHEN 'io' THEN ['pathlib'] WHEN 'network' THEN ['requests'] WHEN 'config' THEN ['json'] WHEN 'test' THEN ['pytest'] ELSE {NONE} END,
        CASE intent WHEN 'io' THEN ['read_text'] WHEN 'network' THEN ['get'] WHEN 'database' THEN ['execute'] WHEN 'config' THEN ['loads'] WHEN 'util' THEN ['route'] ELSE ['fixture', 'mock'] END,
        NULL, NULL, role, intent FROM good WHERE kind = 'function')"""


def twin(body: str, base: str = DECL) -> str:
    return with_views(f"WITH {base} {body}" if not body.startswith(",") else f"WITH {base}{body}", "symbols")


@query("src_01_discover", twin("SELECT DISTINCT CASE WHEN s % 10 = 3 THEN 'build/' ELSE '' END || path AS path, CASE WHEN s % 10 = 3 THEN 'ignored' WHEN s % 10 = 7 THEN 'binary' ELSE 'passed' END AS reason FROM src", SRC))
def discover(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).select("path", F.coalesce("reason", F.lit("passed")).alias("reason"))


@query("src_02_unreadable", twin("SELECT DISTINCT path, 'SyntaxError' AS error FROM src WHERE s % 25 = 0 AND s % 10 NOT IN (3, 7)", SRC))
def unreadable(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("error is not null").select("path", "error")


@query("src_03_symbols", twin("SELECT name, kind, path FROM decl"))
def found(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("error is null").select("name", "kind", "path")


@query("src_04_memory_store", twin("SELECT kind, count(*) AS n FROM decl GROUP BY kind"))
def memory_store(spark: SparkSession, sf: str) -> DataFrame:
    """A scan kept as a view, and asked in SQL."""
    parsed(spark, sf).where("error is null").createOrReplaceTempView("scanned_symbols")
    return spark.sql("SELECT kind, count(*) AS n FROM scanned_symbols GROUP BY kind")


@query("src_38_imports", twin("SELECT name, unnest(imports) AS module FROM decl"))
def imports(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("name", F.explode("imports").alias("module"))


@query("src_39_call_relations", twin("SELECT DISTINCT caller, callee FROM (SELECT name AS caller, unnest(calls) AS callee FROM decl) WHERE callee IN (SELECT name FROM decl)"))
def call_relations(spark: SparkSession, sf: str) -> DataFrame:
    r = parsed(spark, sf).where("error is null")
    known = r.select(F.col("name").alias("callee")).distinct()
    return r.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct().join(known, "callee", "left_semi").select("caller", "callee")


@query("src_40_class_signatures", twin("SELECT owner AS class, list_sort(list(DISTINCT name)) AS methods FROM decl WHERE owner IS NOT NULL GROUP BY owner"))
def class_signatures(spark: SparkSession, sf: str) -> DataFrame:
    bare = lambda c: F.replace(c, F.lit("sym::"), F.lit(""))
    return scan.edges(parsed(spark, sf)).where("kind = 'contains'").groupBy(bare("src").alias("class")).agg(F.array_sort(F.collect_set(bare("dst"))).alias("methods"))


@query("src_37_typescript", twin("SELECT name, CASE kind WHEN 'class' THEN 'interface' WHEN 'method' THEN 'class' WHEN 'function' THEN CASE WHEN s % 2 = 0 THEN 'function' ELSE 'arrow_function' END ELSE kind END AS kind FROM src", SRC))
def typescript_symbols(spark: SparkSession, sf: str) -> DataFrame:
    w = written(spark, sf)
    fill = lambda before, after: F.concat(F.lit(before), "name", F.lit(after))
    arrow = F.when(F.col("s").cast("int") % 2 == 0, fill("export function ", "(x: number) { return x; }")).otherwise(fill("export const ", " = (x: number): number => x;"))
    code = F.when(F.col("kind") == "class", fill("export interface ", " { id: string; }")).when(F.col("kind") == "method", fill("class ", " extends Base { run() { return 1; } }")).when(F.col("kind") == "async_function", fill("export async function ", "(x) { await x; }")).otherwise(arrow)
    files = w.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(code)), "\n").alias("text"))
    return typescript.symbols(files).select("name", "kind")


@query("joi_16_unbound_references", twin("SELECT class, attribute FROM (SELECT class, unnest(['save_' || s, 'load_' || s, '__enter__']) AS attribute FROM good WHERE kind = 'class') r WHERE NOT EXISTS (SELECT 1 FROM decl WHERE owner = r.class AND name = r.attribute)"))
def unbound(spark: SparkSession, sf: str) -> DataFrame:
    """References of a text for each class to attributes that the class doesn't declare."""
    p = parsed(spark, sf).where("kind = 'class' and name not like 'Of%'").select("name", F.regexp_extract("path", r"mod_(\d+)", 1).alias("s"))
    note = F.concat_ws(" ", *(F.concat("name", F.lit("."), x) for x in (F.concat(F.lit("save_"), "s"), F.concat(F.lit("load_"), "s"), F.lit("__enter__"))))
    refs = p.select(F.explode(F.regexp_extract_all(note, F.lit(r"\b([A-Z]\w*\.\w+)\b"), 1)).alias("r")).select(F.substring_index("r", ".", 1).alias("class"), F.substring_index("r", ".", -1).alias("attribute"))
    bare = lambda c: F.replace(c, F.lit("sym::"), F.lit(""))
    known = scan.edges(parsed(spark, sf)).where("kind = 'contains'").select(bare("src").alias("class"), bare("dst").alias("attribute"))
    return refs.join(known, ["class", "attribute"], "left_anti")


TAGS = """, tags AS (SELECT kind AS tag FROM decl UNION SELECT unnest(['async', 'lock', 'network']) FROM decl WHERE kind = 'async_function' UNION SELECT 'network' FROM decl WHERE list_contains(imports, 'requests')
    UNION SELECT 'filesystem' FROM decl WHERE list_contains(imports, 'pathlib') UNION SELECT 'factory' FROM decl WHERE contains(lower(name), 'factory'))"""


@query("grb_01_nodes", twin(TAGS + " SELECT 'symbol' AS type, count(DISTINCT name) AS n FROM decl UNION ALL SELECT 'category', count(*) FROM tags"))
def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return scan.nodes(parsed(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("grb_04_reference_edges", twin("""SELECT DISTINCT 'sym::' || name AS src, 'sym::' || dst AS dst, kind, weight::DOUBLE AS weight, layer FROM (
    SELECT name, unnest(calls) AS dst, 'call' AS kind, 0.8 AS weight, 'structural' AS layer FROM decl UNION ALL SELECT name, unnest(imports), 'import', 0.5, 'structural' FROM decl
    UNION ALL SELECT name, 'Base', 'inherits', 1.0, 'structural' FROM decl WHERE own IS NOT NULL UNION ALL SELECT name, unnest(attrs), 'attr_access', 0.2, 'noisy' FROM decl)"""))
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    return scan.edges(parsed(spark, sf)).where("kind in ('call', 'import', 'inherits', 'attr_access')")


@query("grb_08_aliases", twin("SELECT DISTINCT name, path FROM decl WHERE name IN (SELECT name FROM decl GROUP BY name HAVING count(*) > 1)"))
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return scan.aliases(parsed(spark, sf)).select("name", "path").distinct()


@query("fn_13_feature_tags", twin("SELECT name, ['async_lock_pattern'] AS risk_anchors FROM decl WHERE kind = 'async_function'"))
def risk(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("size(risk_anchors) > 0").select("name", "risk_anchors")


@query("fn_40_intents", twin("SELECT name, intent FROM decl WHERE kind = 'function'"))
def intents(spark: SparkSession, sf: str) -> DataFrame:
    found_, _ = rl.intent(F.col("name"), F.col("kind"), F.concat("path", F.lit("/"), "name"), F.col("calls"), F.col("imports"))
    return parsed(spark, sf).where("kind = 'function'").select("name", found_.alias("intent"))


@query("fn_41_class_roles", twin("SELECT name, CASE WHEN own IS NULL THEN 'unknown' ELSE role END AS role FROM decl WHERE kind = 'class'"))
def class_roles(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("kind = 'class'").select("name", rl.class_role(F.col("name"), F.col("calls"), F.col("imports"))[0].alias("role"))


@query("fn_17_fidelity", twin("SELECT path, 1.0::DOUBLE AS fidelity, count(*) AS symbols FROM decl GROUP BY path"))
def fidelity(spark: SparkSession, sf: str) -> DataFrame:
    f = sources(spark, sf).where("reason is null").select("path", F.decode("content", "UTF-8").alias("source"))
    n = parsed(spark, sf).where("error is null").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "path").select("path", text.fidelity(F.col("n"), F.col("source")).alias("fidelity"), F.col("n").alias("symbols"))


@query("fn_11_behaviour_tags", twin("""SELECT path, list_sort(list_distinct(flatten(list(CASE kind WHEN 'class' THEN CASE WHEN intent = 'database' THEN ['class', 'context_manager', 'function', 'return'] ELSE ['class', 'function', 'return'] END WHEN 'method' THEN ['class', 'function', 'return']
    WHEN 'async_function' THEN ['async', 'await', 'function', 'import', 'lock', 'return', 'with'] ELSE list_concat(['function', 'return'], CASE WHEN intent IN ('util', 'test') THEN ['decorator'] ELSE [] END, CASE WHEN intent IN ('util', 'database') THEN [] ELSE ['import'] END) END)))) AS tags
    FROM good GROUP BY path""", f"{SRC}, {GOOD}"))
def behaviour(spark: SparkSession, sf: str) -> DataFrame:
    f = sources(spark, sf).where("reason is null and path not rlike 'mod_(25|50)[.]py'").select("path", F.decode("content", "UTF-8").alias("source"))
    return f.select("path", ct.behaviour(F.col("source")).alias("tags"))


@query("fn_12_category_roles", twin("""SELECT id, CASE WHEN kind = 'class' THEN CASE WHEN intent = 'database' THEN ['raii'] ELSE [] END WHEN kind = 'method' THEN [] WHEN kind = 'async_function' THEN ['async']
        ELSE CASE intent WHEN 'io' THEN ['filesystem', 'io_bound'] WHEN 'network' THEN ['network'] WHEN 'database' THEN ['database'] WHEN 'config' THEN ['parse'] WHEN 'util' THEN ['decorator', 'entry_point'] ELSE ['decorator'] END END AS tags,
    CASE WHEN kind = 'class' THEN CASE WHEN intent = 'database' THEN 'resource_manager' WHEN role = 'controller' THEN 'coordinator' ELSE 'container' END
        WHEN kind = 'function' AND intent IN ('io', 'network', 'database') THEN 'io_handler' WHEN kind = 'function' AND intent = 'config' THEN 'transformer' ELSE 'unknown' END AS role FROM src""", SRC))
def category_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Tags and role of each symbol by its own code, name, kind, decorators and number of calls."""
    w = written(spark, sf).withColumn("name", F.when(F.col("kind") == "class", F.concat(F.initcap("role"), F.lit("_"), "name")).otherwise(F.col("name")))
    w = w.withColumn("tags", ct.categories(F.col("code"), F.col("name"), F.col("kind"), ct.decorators(F.col("code"))))
    called = F.regexp_count("code", F.lit(r"\w\("))
    return w.select("id", "tags", ct.role(F.col("kind"), F.col("tags"), F.col("name"), F.col("path"), called).alias("role"))


@query("joi_14_registry_mismatch", twin("""SELECT DISTINCT n AS name, CASE WHEN n IN (SELECT name FROM decl) THEN 'unregistered' ELSE 'missing' END AS problem FROM (SELECT CASE kind WHEN 'class' THEN class ELSE name END AS n FROM src
    UNION ALL SELECT name FROM decl) x WHERE n NOT IN (SELECT name FROM decl) OR n NOT IN (SELECT CASE kind WHEN 'class' THEN class ELSE name END FROM src)"""))
def registry_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the registry that no readable file declares, and declared names that the registry doesn't know."""
    registry = symbols(spark, sf).select(F.when(F.col("kind") == "class", F.concat(F.initcap("role"), F.lit("_"), "name")).otherwise(F.col("name")).alias("name"), F.lit(True).alias("known")).distinct()
    seen = parsed(spark, sf).where("error is null").select("name", F.lit(True).alias("seen")).distinct()
    j = registry.join(seen, "name", "full").where("known is null or seen is null")
    return j.select("name", F.when(F.col("known").isNull(), "unregistered").otherwise("missing").alias("problem"))


@query("joi_17_isolated", twin(", c AS (SELECT DISTINCT caller, callee FROM (SELECT name AS caller, unnest(calls) AS callee FROM decl) WHERE callee IN (SELECT name FROM decl)) SELECT DISTINCT name FROM decl WHERE NOT EXISTS (SELECT 1 FROM c WHERE caller = name OR callee = name)"))
def isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Declared names that no call between declared names leaves or enters."""
    c = call_relations(spark, sf)
    seen = c.select(F.col("caller").alias("name")).union(c.select("callee"))
    return parsed(spark, sf).where("error is null").select("name").distinct().join(seen, "name", "left_anti")
