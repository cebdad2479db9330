"""Registry lookups, artefacts, resolution, transforms and the remaining views."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, categories, contains, log, symbols, table, with_views
from ..engine import Engine
from ..functions import code_tags as ct
from ..functions import energy as en
from ..functions import roles, text
from ..operators import fields as fd
from ..operators import logs as lg
from ..operators import rules as rl
from ..operators import similarity as sm
from ..operators import structure as st
from ..plans import traversal as tv
from ..plans.transforms import chain, normalised
from ..registry import query, r6
from ..sources import codecs
from ..tables import folder, save
from .regions import BASE, base
from .similarity import DOCS, FAMILY, best, signed

# --- registries and artefacts


@query("src_05_registry_lookup", with_views("SELECT s.id, s.kind, c.dst, c.weight FROM symbols s LEFT JOIN calls c ON c.src = s.id", "symbols", "calls"))
def registry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf).select("id", "kind")
    return s.join(calls(spark, sf).select(F.col("src").alias("id"), "dst", "weight"), "id", "left")


@query("src_09_degree_cache", with_views("SELECT id, out_degree, in_degree FROM degrees", "degrees"))
def degree_cache(spark: SparkSession, sf: str) -> DataFrame:
    return save(st.degrees(calls(spark, sf)).select("id", "out_degree", "in_degree"))


@query("src_10_energy_load", with_views("SELECT s.id, coalesce(round(d.out_weight, 6), 0.5) AS gravity, CASE WHEN d.out_degree > 2 THEN 'saddle' ELSE 'not_critical_point' END AS field_role FROM symbols s LEFT JOIN degrees d ON d.id = s.id AND d.out_degree > 2", "symbols", "degrees"))
def energy_load(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf)).where("out_degree > 2").select("id", r6("out_weight").alias("g"))
    j = symbols(spark, sf).select("id").join(d, "id", "left")
    return j.select("id", F.coalesce("g", F.lit(0.5)).alias("gravity"), F.when(F.col("g").isNotNull(), "saddle").otherwise("not_critical_point").alias("field_role"))


@query("src_12_jsonl_round_trip", with_views("SELECT src, dst, weight FROM calls", "calls"))
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{folder(spark)}/edges-{uuid.uuid4().hex}.jsonl"
    codecs.to_jsonl(calls(spark, sf).select("src", "dst", "weight"), path)
    good, _ = codecs.read_jsonl(spark, path, "src string, dst string, weight double")
    return good


@query("src_16_source_selection", "SELECT 'parquet' AS source, TRUE AS available UNION ALL SELECT 'jsonl', FALSE")
def selection(spark: SparkSession, sf: str) -> DataFrame:
    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    found = [("parquet", there(f"{sf}/part.parquet")), ("jsonl", there(f"{sf}/part.jsonl"))]
    return spark.createDataFrame(found, "source string, available boolean")


@query("src_18_event_rows", with_views("SELECT 'EDGE_TRAVERSE' AS event_type, src, dst, weight FROM calls UNION ALL SELECT DISTINCT 'NODE_VISIT', src, NULL, NULL FROM calls", "calls"))
def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    rows_ = tv.build_events(*tv.bfs(e, e.select(F.col("src").alias("id")).distinct(), 1)).where("event_type != 'QUERY_METADATA' and (event_type = 'EDGE_TRAVERSE' or depth = 0)")
    return rows_.select("event_type", "src", "dst", "weight")


@query("src_19_import_if_empty", "SELECT p_partkey FROM part WHERE p_size > 10")
def import_empty(spark: SparkSession, sf: str) -> DataFrame:
    legacy = table(spark, sf, "part").select("p_partkey", "p_size")
    return codecs.import_if_empty(legacy.limit(0), legacy, F.col("p_size") > 10).select("p_partkey")


@query("src_21_registry_best_name", "SELECT p_name, min(p_partkey) AS p_partkey FROM part p WHERE p_retailprice = (SELECT max(p_retailprice) FROM part q WHERE q.p_name = p.p_name) GROUP BY p_name")
def best_name(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy("p_name").agg(F.min(F.struct((-F.col("p_retailprice")).alias("c"), "p_partkey")).alias("b"))
    return g.select("p_name", F.col("b.p_partkey").alias("p_partkey"))


@query("src_22_latest_wins", "SELECT c_nationkey, max(c_custkey) AS version, arg_max(c_acctbal, c_custkey) AS value FROM customer GROUP BY c_nationkey")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("version"), F.col("c_acctbal").alias("value"))
    return codecs.latest(v, ["c_nationkey"], "version")


@query("src_26_git_changes", "SELECT l_suppkey AS file, count(*) AS commits, sum(l_quantity)::DOUBLE AS lines, max(l_shipdate) AS latest FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1")
def git_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem")
    last = F.broadcast(c.agg(F.max("l_shipdate").alias("last")))  # of one row
    return c.crossJoin(last).where(F.col("l_shipdate") > F.col("last") - F.expr("interval 30 days")).groupBy(F.col("l_suppkey").alias("file")).agg(F.count(F.lit(1)).alias("commits"), F.sum("l_quantity").alias("lines"), F.max("l_shipdate").alias("latest"))


@query("src_28_seeds", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k')::INT AS mi FROM events")
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "mi"))
    return e.where("name = 'k'")


@query("src_29_field_load", "SELECT vec_id, embedding[1:3] AS position, coalesce(NULL, 0.5::DOUBLE) AS friction FROM embeddings")
def field_load(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("position"), F.coalesce(F.lit(None).cast("double"), F.lit(0.5)).alias("friction"))


@query("src_33_energy_written_back", with_views("SELECT s.id, s.kind, round(d.out_weight, 6) AS energy FROM symbols s LEFT JOIN degrees d USING (id)", "symbols", "degrees"))
def written_back(spark: SparkSession, sf: str) -> DataFrame:
    e = st.degrees(calls(spark, sf)).select("id", r6("out_weight").alias("energy"))
    return save(symbols(spark, sf).select("id", "kind").join(e, "id", "left"))


@query("src_36_basins", "WITH a AS (SELECT vec_id AS attractor, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings ORDER BY vec_id LIMIT 8), d AS (SELECT v.vec_id, attractor, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(sqrt(pow(embedding[1]::DOUBLE - x, 2) + pow(embedding[2]::DOUBLE - y, 2)), 9), attractor) AS rn FROM embeddings v, a) SELECT vec_id, attractor FROM d WHERE rn = 1")
def basins(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    a = F.broadcast(v.orderBy("vec_id").limit(8).select(F.col("vec_id").alias("attractor"), F.col("x").alias("ax"), F.col("y").alias("ay")))  # of eight rows
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2))), 9)
    return v.crossJoin(a).groupBy("vec_id").agg(F.min(F.struct(d.alias("d"), "attractor")).alias("b")).select("vec_id", F.col("b.attractor").alias("attractor"))


# --- gates and joins


@query("flt_02_simple_ignore", with_views("SELECT DISTINCT path FROM symbols WHERE NOT list_contains(string_split(path, '/'), 'brand_5') AND NOT path LIKE '%/mod_1_.py'", "symbols"))
def simple_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("path").distinct().where(~F.array_contains(F.split("path", "/"), "brand_5") & ~F.col("path").rlike(r"/mod_1[^/]\.py$"))


@query("flt_07_query_gates", "SELECT p_partkey FROM part WHERE lower(p_type) NOT IN ('small', 'large') AND contains(p_name, ' ') ORDER BY p_partkey LIMIT 1000")
def query_gates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(~F.lower("p_type").isin("small", "large", *ct.QUERY_BLACKLIST) & F.col("p_name").contains(" ")).orderBy("p_partkey").limit(1000).select("p_partkey")


@query("flt_13_path_grammar", with_views("SELECT c.src, c.dst FROM calls c JOIN symbols a ON a.id = c.src JOIN symbols b ON b.id = c.dst WHERE b.line % 3 >= a.line % 3", "calls", "symbols"))
def grammar(spark: SparkSession, sf: str) -> DataFrame:
    layer = symbols(spark, sf).select("id", (F.col("line") % 3).alias("layer"))
    e = calls(spark, sf).select("src", "dst").join(layer.withColumnsRenamed({"id": "src", "layer": "a"}), "src").join(layer.withColumnsRenamed({"id": "dst", "layer": "b"}), "dst")
    return e.where("b >= a").select("src", "dst")


@query("joi_03_event_build", with_views("SELECT v.id AS query_id, c.dst AS node, s.kind FROM symbols v JOIN calls c ON c.src = v.id LEFT JOIN symbols s ON s.id = c.dst WHERE v.intent = 'config'", "symbols", "calls"))
def event_build(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf)
    v = s.where("intent = 'config'").select(F.col("id").alias("query_id"))
    e = v.join(calls(spark, sf).select(F.col("src").alias("query_id"), F.col("dst").alias("node")), "query_id")
    return e.join(s.select(F.col("id").alias("node"), "kind"), "node", "left")


@query("joi_05_edge_types", with_views("SELECT kind, CASE kind WHEN 'call' THEN 0.8 WHEN 'category' THEN 0.5 ELSE 0.15 END::DOUBLE AS base, count(*) AS n FROM (SELECT kind FROM calls UNION ALL SELECT kind FROM categories) GROUP BY kind", "calls", "categories"))
def edge_types(spark: SparkSession, sf: str) -> DataFrame:
    types = F.broadcast(spark.createDataFrame(list(rl.WEIGHTS.items()), "kind string, base double"))  # a fixed table
    e = calls(spark, sf).select("kind").unionByName(categories(spark, sf).select("kind"))
    return e.join(types, "kind").groupBy("kind", "base").agg(F.count(F.lit(1)).alias("n"))


@query("joi_11_callee_resolution", with_views("SELECT src, dst, EXISTS (SELECT 1 FROM symbols a JOIN symbols b ON a.path = b.path WHERE a.id = src AND b.id = dst) AS same_file FROM calls", "calls", "symbols"))
def callees(spark: SparkSession, sf: str) -> DataFrame:
    p = symbols(spark, sf).select("id", "path")
    e = calls(spark, sf).select("src", "dst").join(p.withColumnsRenamed({"id": "src", "path": "a"}), "src", "left").join(p.withColumnsRenamed({"id": "dst", "path": "b"}), "dst", "left")
    return e.select("src", "dst", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_file"))


@query("joi_15_deprecated_names", "WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) SELECT doc_id, w AS name FROM t WHERE w IN ('of', 'trash', 'idiot', 'The')")
def deprecated_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.broadcast(spark.createDataFrame([("of",), ("trash",), ("idiot",), ("The",)], "name string"))  # the query's own names
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))).alias("name"))
    return t.join(names, "name").select("doc_id", "name")


@query("joi_07_band_join", f"WITH {FAMILY}, {signed(DOCS)}, {best(0.5, 100).replace('SELECT a, b, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 100', 'SELECT floor(similarity * 10)::BIGINT AS tenth, count(DISTINCT a) AS documents, count(*) AS pairs FROM r WHERE rank <= 100 GROUP BY 1')}")
def band_join(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents have a similar one, by tens of percent, of up to 100 candidates each, the best."""
    w = table(spark, sf, "documents").select("doc_id", sm.word_set(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    j = sm.band_join(sm.signatures(w, "doc_id", "tokens"), "doc_id", least=0.5, top=100)
    return j.groupBy(F.floor(F.col("similarity") * 10).alias("tenth")).agg(F.count_distinct("a").alias("documents"), F.count(F.lit(1)).alias("pairs"))


@query("win_05_top_of_intent", with_views("SELECT intent, id FROM (SELECT intent, id, row_number() OVER (PARTITION BY intent ORDER BY complexity DESC, id) AS rn FROM symbols) WHERE rn <= 3", "symbols"))
def top_of_intent(spark: SparkSession, sf: str) -> DataFrame:
    return rl.top_by_intent(symbols(spark, sf).select("intent", "id", F.col("complexity").alias("score"))).select("intent", "id")


@query("win_13_best_pair", with_views("SELECT src, arg_min(dst, (-weight, dst)) AS best FROM calls GROUP BY src", "calls"))
def best_pair(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy("src").agg(F.min(F.struct((-F.col("weight")).alias("w"), "dst")).alias("b")).select("src", F.col("b.dst").alias("best"))


@query("set_02_frontier", with_views("SELECT DISTINCT dst FROM calls JOIN symbols ON id = src WHERE intent = 'database' OR is_noisy", "calls", "symbols"))
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    now = symbols(spark, sf).where("intent = 'database' or is_noisy").select(F.col("id").alias("src"))
    return calls(spark, sf).join(now, "src", "left_semi").select("dst").distinct()


# --- scalar functions


@query("fn_09_module_of_symbol", with_views("SELECT id, regexp_replace(replace(path, '/', '.'), '\\.py$', '') AS module FROM symbols", "symbols"))
def module_of(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", text.module(F.col("path")).alias("module"))


#: Tasks on parts, by number: words that call for a level, in upper case too, and none.
TASKS = {"Fix the crash of": ("FULL", 0.95), "explain": ("SUMMARY", 0.3), "rename": ("SKELETON", 0.8), "trace dep of": ("HIDDEN", 0.1), "AUDIT": ("SKELETON", 0.6), "design": ("SUMMARY", 0.3), "paint": ("SKELETON", 0.7)}
_CASES = lambda values: "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query("fn_16_detail_levels", "SELECT p_partkey, " + _CASES([f"'{x}'" for x, _ in TASKS.values()]) + " AS level, " + _CASES([f"{x}::DOUBLE" for _, x in TASKS.values()]) + " AS precision FROM part")
def detail(spark: SparkSession, sf: str) -> DataFrame:
    verb = F.element_at(F.array(*map(F.lit, TASKS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    level, alpha = ct.level(F.concat(verb, F.lit(" a "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", level.alias("level"), alpha.alias("precision"))


@query("fn_18_gravity", with_views("SELECT id, round(1 / (1 + exp(-in_degree / 10.0::DOUBLE)), 6) AS gravity FROM degrees", "degrees"))
def gravity(spark: SparkSession, sf: str) -> DataFrame:
    return st.degrees(calls(spark, sf)).select("id", r6(en.gravity(F.col("in_degree"))).alias("gravity"))


@query("fn_20_potential", with_views("SELECT id, round(10 * tanh((0.4::DOUBLE * ln(1 + 1000 * centrality) + 0.3::DOUBLE * ln(1 + in_degree::DOUBLE) + 0.3::DOUBLE * 0.125::DOUBLE) / 10), 5) AS energy FROM features", "features"))
def potential(spark: SparkSession, sf: str) -> DataFrame:
    return st.features(calls(spark, sf)).select("id", F.round(en.soft_cap(en.potential(F.col("centrality"), F.col("in_degree"), F.lit(0.5))), 5).alias("energy"))


@query("fn_30_escape_probability", with_views("SELECT id, round(1 / (1 + exp(-in_degree / 10.0::DOUBLE)) * 0.5::DOUBLE * 0.9::DOUBLE, 6) AS p FROM degrees", "degrees"))
def escape(spark: SparkSession, sf: str) -> DataFrame:
    return st.degrees(calls(spark, sf)).select("id", r6(en.escape_probability(en.gravity(F.col("in_degree")), F.lit(0.5), F.lit(0.1))).alias("p"))


@query("fn_35_dissipation", with_views("SELECT id, CASE WHEN list_has_any(tags, ['economy', 'small']) THEN 0.7 ELSE 0.4 END::DOUBLE AS dissipation FROM symbols", "symbols"))
def dissipation(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.when(F.arrays_overlap("tags", F.array(F.lit("economy"), F.lit("small"))), "utility").otherwise("dependency")
    return symbols(spark, sf).select("id", roles.dissipation(cls).alias("dissipation"))


@query("fn_48_generic_symbols", "SELECT p_partkey, p_partkey % 6 IN (1, 2, 3, 5) AS generic FROM part")
def generic(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as they are, as a handler, in a category, as a callback, with an underscore (that of the name alone
    doesn't count), and a generic name."""
    name, k = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey") % 6
    ident = F.when(k == 0, F.concat(F.lit("sym::"), name)).when(k == 1, F.concat(F.lit("sym::on_"), name, F.lit("_handler"))).when(k == 2, F.concat(F.lit("cat::"), name)).when(k == 3, F.concat(F.lit("sym::"), name, F.lit("_cb"))).when(k == 4, F.concat(F.lit("sym::_"), name)).otherwise("sym::main")
    return table(spark, sf, "part").select("p_partkey", ct.generic(ident).alias("generic"))


@query("fn_55_data_complexity", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'list') OR contains(lower(p_name), 'class') OR contains(lower(p_name), 'dto') OR contains(lower(p_name), 'object') OR contains(lower(p_name), 'dict') THEN 'complex' ELSE 'simple' END AS complexity FROM part")
def data_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ct.data_complexity(F.col("p_name")).alias("complexity"))


def engine(spark: SparkSession, sf: str) -> Engine:
    return Engine(spark, symbols(spark, sf).select("id", "name", "kind", "is_noisy"), calls(spark, sf))


# --- graph building


@query("grb_06_topology_enrichers", with_views("SELECT s.id, coalesce(d.out_degree, 0) > 2 AS wide, coalesce(d.in_degree, 0) AS callers FROM symbols s LEFT JOIN degrees d USING (id)", "symbols", "degrees"))
def topology_enrichers(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf)).select("id", "out_degree", "in_degree")
    wide = lambda df: df.join(d, "id", "left").select("id", (F.coalesce("out_degree", F.lit(0)) > 2).alias("wide"), F.coalesce("in_degree", F.lit(0)).alias("callers"))
    return chain(symbols(spark, sf).select("id"), [(100, wide)])


@query("grb_07_enricher_order", with_views("SELECT id, kind || '>' || role || '>' || intent AS trail FROM symbols", "symbols"))
def enricher_order(spark: SparkSession, sf: str) -> DataFrame:
    add = lambda c: lambda df: df.withColumn("trail", F.concat_ws(">", "trail", c))
    s = symbols(spark, sf).withColumn("trail", F.lit(None).cast("string"))
    return chain(s, [(21, add("intent")), (20, add("role")), (10, add("kind"))]).select("id", "trail")


@query("grb_09_alias_lookup", with_views("SELECT id, 'sym::' || regexp_replace(name, '_[0-9]+$', '') AS bare FROM symbols WHERE regexp_replace(name, '_[0-9]+$', '') = 'red_widget'", "symbols"))
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("name", "_[0-9]+$", "")
    return symbols(spark, sf).where(bare == "red_widget").select("id", F.concat(F.lit("sym::"), bare).alias("bare"))


@query("grb_11_defines", with_views("SELECT 'file::' || path AS src, id AS dst, 'DEFINES' AS kind, 1.0::DOUBLE AS weight FROM symbols UNION ALL SELECT src, dst, 'CALLS', 0.9::DOUBLE FROM calls", "symbols", "calls"))
def defines(spark: SparkSession, sf: str) -> DataFrame:
    d = symbols(spark, sf).select(F.concat(F.lit("file::"), "path").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("kind"), F.lit(1.0).alias("weight"))
    return d.unionByName(calls(spark, sf).select("src", "dst", F.lit("CALLS").alias("kind"), F.lit(0.9).alias("weight")))


# --- traversal and paths


@query("trv_07_module_lookup", with_views("SELECT id FROM symbols WHERE path LIKE 'src/small/brand_2/%'", "symbols"))
def module_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where(F.col("path").startswith("src/small/brand_2/")).select("id")


@query("trv_13_full_query")
def full_query(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved, normalised, pruned, propagated and refined."""
    e = engine(spark, sf)
    start = e.resolve("1").first().id
    return Engine(spark, e.nodes, e.edges).refined(start or "sym::1", 2000).select("id", r6("weight").alias("weight"), "bucket")


@query("trv_18_saddle_escape", with_views("SELECT id, CASE WHEN centrality > 0.5 THEN 'descend' ELSE 'ascend' END AS direction FROM features", "features"))
def saddle_escape(spark: SparkSession, sf: str) -> DataFrame:
    return st.features(calls(spark, sf)).select("id", F.when(F.col("centrality") > 0.5, "descend").otherwise("ascend").alias("direction"))


@query("trv_24_call_graph", with_views("WITH b AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), d1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'sym::9'), d2 AS (SELECT DISTINCT b.dst AS node FROM d1 JOIN b ON b.src = d1.node WHERE b.dst <> 'sym::9' AND b.dst NOT IN (SELECT node FROM d1)) SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2", "calls"))
def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    e = save(tv.both_ways(calls(spark, sf)))
    visits, _ = tv.bfs(e, spark.createDataFrame([("sym::9",)], "id string"), max(1, min(10, 2)))
    return visits.where("depth > 0").select("node", "depth")


@query("pth_09_barrier", with_views(f"WITH {BASE} SELECT src, dst, round(b.energy - a.energy, 6) AS delta, round(greatest(0, b.energy - a.energy) + 0.5::DOUBLE * b.noise, 6) AS barrier FROM calls JOIN base a ON a.id = src JOIN base b ON b.id = dst", "states", "calls"))
def barrier(spark: SparkSession, sf: str) -> DataFrame:
    s = base(spark, sf).select("id", "energy", "noise")
    e = calls(spark, sf).select("src", "dst").join(s.select(F.col("id").alias("src"), F.col("energy").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("energy").alias("b"), "noise"), "dst")
    d = F.col("b") - F.col("a")
    return e.select("src", "dst", r6(d).alias("delta"), r6(en.cumulative_barrier(d, F.col("noise"))).alias("barrier"))


# --- structure and regions


@query("str_06_betweenness_proxy", with_views("SELECT id, round(betweenness, 6) AS betweenness FROM features", "features"))
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return st.features(calls(spark, sf)).select("id", r6("betweenness").alias("betweenness"))


@query("str_07_clustering", with_views("SELECT a.src AS id, count(*) AS links FROM calls a JOIN calls b ON a.src = b.src JOIN calls c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src", "calls"))
def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return st.clustering(calls(spark, sf))


@query("str_20_seeds", with_views(f"WITH {BASE} SELECT role, id FROM (SELECT role, id, row_number() OVER (PARTITION BY role ORDER BY centrality DESC, id) AS rn FROM base) WHERE rn <= 2", "states"))
def region_seeds(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("role").orderBy(F.desc("centrality"), "id")
    return base(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("role", "id")


@query("str_21_region_profile", with_views(f"WITH {BASE} SELECT role, count(*) AS size, round(avg(energy), 5) AS energy, sha256(string_agg(id, ',' ORDER BY id)) AS members FROM base GROUP BY role", "states"))
def region_profile(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("energy"), 5).alias("energy"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("members"))


@query("str_30_betti", """WITH RECURSIVE p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.vec_id AS u, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9), b.vec_id) AS rn FROM p a JOIN p b ON a.vec_id <> b.vec_id),
    e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM n WHERE rn <= 3), both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    comp(id, c) USING KEY (id) AS (SELECT vec_id, vec_id FROM p UNION SELECT n.v, min(n.c) FROM (SELECT both_.v, comp.c FROM comp JOIN both_ ON both_.u = comp.id) n JOIN recurring.comp r ON r.id = n.v WHERE n.c < r.c GROUP BY n.v),
    t AS (SELECT (SELECT count(*) FROM p) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT c) FROM comp) AS components) SELECT nodes, edges, components, CASE WHEN nodes < 50 THEN 0 ELSE greatest(0, (edges - nodes + components) // 2) END AS betti_1 FROM t""")
def betti(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.topology import betti_1

    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return betti_1(p)


@query("str_37_steepest", with_views(f"WITH {BASE}, d AS (SELECT src, dst, round(b.energy - a.energy, 6) AS rise, row_number() OVER (PARTITION BY src ORDER BY round(b.energy - a.energy, 6) DESC, dst) AS rn FROM calls JOIN base a ON a.id = src JOIN base b ON b.id = dst) SELECT src, dst, rise FROM d WHERE rn = 1", "states", "calls"))
def steepest(spark: SparkSession, sf: str) -> DataFrame:
    s = base(spark, sf).select("id", "energy")
    e = calls(spark, sf).select("src", "dst").join(s.select(F.col("id").alias("src"), F.col("energy").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("energy").alias("b")), "dst")
    g = e.groupBy("src").agg(F.min(F.struct((-r6(F.col("b") - F.col("a"))).alias("n"), "dst")).alias("m"))
    return g.select("src", F.col("m.dst").alias("dst"), (-F.col("m.n")).alias("rise"))


# --- similarity, rules, logs


FEATURES = "SELECT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', role, intent, array_to_string(tags, ' '), kind)), '[A-Za-z0-9_]+')) AS w FROM symbols"


@query("lsh_11_semantic_inventory", with_views(f"WITH {FAMILY}, {signed(FEATURES, 'id')}, {best(0.6, 3, 'id')}", "symbols"))
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Of each symbol the three of most similar feature text."""
    t = symbols(spark, sf).select("id", sm.word_set(F.concat_ws(" ", "role", "intent", F.array_join("tags", " "), "kind")).alias("tokens"))
    return sm.band_join(sm.signatures(t, "id", "tokens"), "id", least=0.6, top=3).select("a", "b", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("con_04_code_skeleton", "SELECT 'def ' || lower(p_type) || '():' || chr(10) || string_agg('    lock_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.acquire()' ELSE '.release()' END, chr(10) ORDER BY p_partkey) AS code FROM part GROUP BY p_type")
def code_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    ops = table(spark, sf, "part").select(F.lower("p_type").alias("thread"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, "ACQ").otherwise("REL").alias("op"), F.concat(F.lit("lock_"), "p_size").alias("arg"))
    return codecs.skeletons(ops).select("code")


@query("ref_05_flow_trace", with_views("SELECT 'edges' AS stage, count(*) AS n FROM calls UNION ALL SELECT 'strong', count(*) FROM calls WHERE weight >= 0.5 UNION ALL SELECT 'targets', count(DISTINCT dst) FROM calls WHERE weight >= 0.5", "calls"))
def flow_trace(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    strong = e.where("weight >= 0.5")
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    return reduce(DataFrame.unionByName, [n("edges", e), n("strong", strong), n("targets", strong.select("dst").distinct())])


@query("ref_04_delivery_layers", with_views("SELECT id, CASE WHEN rn <= 3 THEN 'primary' ELSE 'secondary' END AS layer FROM (SELECT id, row_number() OVER (PARTITION BY intent ORDER BY complexity DESC, id) AS rn FROM symbols WHERE NOT is_noisy)", "symbols"))
def delivery(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("intent").orderBy(F.desc("complexity"), "id")
    s = symbols(spark, sf).where(~F.col("is_noisy"))
    return s.select("id", F.when(F.row_number().over(w) <= 3, "primary").otherwise("secondary").alias("layer"))


@query("stm_02_incremental_distillation", with_views("SELECT symbol, count(*) AS frequency, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM log GROUP BY symbol", "log"))
def distillation(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves distilled apart and put together are the whole."""
    e = log(spark, sf)
    part = lambda k: lg.visits(e.where(F.col("event_id") % 2 == k)).drop("burstiness")
    both = part(0).unionByName(part(1))
    return both.groupBy("symbol").agg(F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("stm_03_restart_skip", with_views("SELECT DISTINCT src AS start FROM calls WHERE src NOT LIKE 'sym::1%'", "calls"))
def restart(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.events import unseen

    s = calls(spark, sf).select(F.col("src").alias("start")).distinct()
    return unseen(s, s.where("start like 'sym::1%'"))


@query("udf_01_bonus_column", with_views("SELECT dst AS node, round(max(least(1e9, weight + 0.05::DOUBLE)), 6) AS weight FROM calls WHERE src = 'sym::1' GROUP BY dst UNION ALL SELECT 'sym::1', 1.0", "calls"))
def bonus(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.propagation import propagate

    e = save(calls(spark, sf).where("src = 'sym::1'"))
    r = propagate(e, spark.createDataFrame([("sym::1",)], "id string"), tau=0.0, soft=False, bonus=F.lit(0.05))
    return r.select("node", r6("weight").alias("weight"))


@query("udf_06_normalise", with_views("SELECT src, dst, round((weight - min(weight) OVER w) / greatest(1e-12, max(weight) OVER w - min(weight) OVER w), 6) AS minmax, round(exp(weight) / sum(exp(weight)) OVER w, 6) AS softmax FROM calls WINDOW w AS (PARTITION BY src)", "calls"))
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    return normalised(calls(spark, sf), "src", "weight").select("src", "dst", r6("minmax").alias("minmax"), r6("softmax").alias("softmax"))


@query("res_05_reverse_index", with_views("SELECT dst AS id, count(*) AS references, list_sort(list(src))[1:3] AS first_callers FROM calls GROUP BY dst", "calls"))
def reverse_index(spark: SparkSession, sf: str) -> DataFrame:
    c = calls(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
    return c.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("references"), F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("src")))).alias("first_callers"))


@query("res_06_file_vocabulary", with_views("SELECT path, id, role, intent, row_number() OVER (PARTITION BY path ORDER BY line, id)::INT AS place FROM symbols", "symbols"))
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("path", "id", "role", "intent", F.row_number().over(Window.partitionBy("path").orderBy("line", "id")).alias("place"))


@query("res_10_project_health", with_views("SELECT count(*) AS symbols, count(DISTINCT path) AS files, round(avg(complexity), 6) AS complexity, round(100.0::DOUBLE * count(*) FILTER (is_noisy) / count(*), 4) AS noisy FROM symbols", "symbols"))
def project_health(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files"), r6(F.avg("complexity")).alias("complexity"), F.round(100.0 * F.count_if("is_noisy") / F.count(F.lit(1)), 4).alias("noisy"))


@query("res_26_pipeline_health", with_views("WITH o AS (SELECT src, count(*) AS n FROM calls GROUP BY src) SELECT round(avg(n), 6) AS avg_out, round(avg((n > 50)::INT), 6) AS hub_ratio, avg(n) <= 30 AND avg((n > 50)::INT) <= 0.02 AS healthy FROM o", "calls"))
def pipeline_health(spark: SparkSession, sf: str) -> DataFrame:
    o = calls(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    g = o.agg(F.avg("n").alias("a"), F.avg((F.col("n") > 50).cast("int")).alias("h"))
    return g.select(r6("a").alias("avg_out"), r6("h").alias("hub_ratio"), ((F.col("a") <= 30) & (F.col("h") <= 0.02)).alias("healthy"))


@query("str_16_tree_tension", with_views("SELECT dst AS id, round(least(1, avg(weight * 0.5::DOUBLE)), 9) AS backward_tension FROM contains GROUP BY dst", "contains"))
def tree_tension(spark: SparkSession, sf: str) -> DataFrame:
    t = fd.backward_tension(contains(spark, sf), spark.createDataFrame([], "id string, gravity double"))
    return t.select("id", F.round("backward_tension", 9).alias("backward_tension"))
