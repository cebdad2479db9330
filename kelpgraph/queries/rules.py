"""Gates, audits, refinement and policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, categories, symbols, table, with_views
from ..functions import energy as en
from ..functions import roles, text
from ..operators import rules as rl
from ..operators import structure as st
from ..registry import query, r6

# --- gates


@query("flt_01_file_gate", "SELECT CASE WHEN url NOT LIKE 'http%' THEN 'not_found' WHEN url LIKE '%/fr/%' THEN 'ignored' WHEN length(html) > 6000 THEN 'too_large' WHEN html LIKE '%$$$%' THEN 'binary' ELSE 'passed' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def file_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    reason = rl.first_failure({"not_found": ~F.col("url").startswith("http"), "ignored": F.col("url").contains("/fr/"), "too_large": F.length("html") > 6000, "binary": F.col("html").contains("$$$")})
    return p.groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_03_ignore_rules", with_views("SELECT path, CASE WHEN regexp_matches(path, '^(.*/)?src/[^/]*/brand_7/mod_1[^/]*\\.py$') THEN FALSE WHEN regexp_matches(path, '^(.*/)?brand_7/.*$') THEN TRUE WHEN regexp_matches(path, '^(.*/)?src/small/.*$') THEN TRUE ELSE FALSE END AS ignored FROM (SELECT DISTINCT path FROM symbols)", "symbols"))
def ignore_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = symbols(spark, sf).select("path").distinct()
    return p.select("path", text.ignored(F.col("path"), ["src/small/**", "brand_7/", "!src/*/brand_7/mod_1*.py"]).alias("ignored"))


@query("flt_04_symbol_gate", "SELECT CASE WHEN p_name IN ('red widget', 'small ring') THEN 'blacklisted' WHEN length(p_name) < 2 THEN 'too_short' WHEN p_name LIKE 'test!_%' ESCAPE '!' THEN 'test' ELSE 'passed' END AS reason, count(*) AS n FROM part GROUP BY 1")
def symbol_gate(spark: SparkSession, sf: str) -> DataFrame:
    gate = rl.symbol_gate(F.col("p_name"), ["red widget", "small ring"])
    return table(spark, sf, "part").groupBy(F.coalesce(gate, F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_06_gate_chain", with_views("SELECT CASE WHEN is_noisy THEN 'noisy' WHEN line > 900 THEN 'late' WHEN kind = 'method' AND intent = 'test' THEN 'test_method' ELSE 'passed' END AS reason, count(*) AS n FROM symbols GROUP BY 1", "symbols"))
def gate_chain(spark: SparkSession, sf: str) -> DataFrame:
    reason = rl.first_failure({"noisy": F.col("is_noisy"), "late": F.col("line") > 900, "test_method": (F.col("kind") == "method") & (F.col("intent") == "test")})
    return symbols(spark, sf).groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_08_type_boundary", with_views("SELECT id, list_has_all(tags, ['small']) AND intent NOT IN ('test') AS fits FROM symbols", "symbols"))
def boundary(spark: SparkSession, sf: str) -> DataFrame:
    fits = (F.size(F.array_except(F.array(F.lit("small")), "tags")) == 0) & ~F.col("intent").isin("test")
    return symbols(spark, sf).select("id", fits.alias("fits"))


@query("flt_09_noise_attributes", with_views("SELECT id, list_filter(list_concat(tags, ['log', 'self', name]), lambda t: t NOT IN ('logger', 'log', 'config', 'debug', 'info', 'warn', 'error', '__dict__', 'self', 'assert', 'print', 'exit')) AS attributes FROM symbols", "symbols"))
def noise(spark: SparkSession, sf: str) -> DataFrame:
    a = F.concat("tags", F.array(F.lit("log"), F.lit("self"), F.col("name")))
    return symbols(spark, sf).select("id", F.array_except(a, F.array(*map(F.lit, rl.NOISE))).alias("attributes"))


@query("flt_15_attribute_filter", with_views("SELECT id, path FROM symbols WHERE kind = 'class' AND intent IN ('io', 'network') AND NOT is_noisy AND contains(path, 'brand_1')", "symbols"))
def attribute_filter(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where((F.col("kind") == "class") & F.col("intent").isin("io", "network") & ~F.col("is_noisy") & F.col("path").contains("brand_1")).select("id", "path")


@query("flt_16_endpoint_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '^http://[^/]+/[^/]+/[0-9]+')")
def endpoint_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.col("url").rlike("^http://[^/]+/[^/]+/[0-9]+")).select("page_id")


@query("flt_17_structural_match", with_views("SELECT id FROM symbols WHERE list_has_any(list_filter(string_split(lower('find the Small Ring quickly'), ' '), lambda t: length(t) >= 3 AND t NOT IN ('the', 'find')), string_split(name, '_'))", "symbols"))
def structural_match(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.filter(F.split(F.lower(F.lit("find the Small Ring quickly")), " "), lambda t: (F.length(t) >= 3) & ~t.isin("the", "find"))
    return symbols(spark, sf).where(F.arrays_overlap(tokens, F.split("name", "_"))).select("id")


@query("flt_18_admission_purge", with_views("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN path NOT LIKE '%/%/%' THEN 'flat' WHEN contains(path, '/brand_3/') THEN 'ignored' WHEN line % 10 = 0 THEN 'untracked' ELSE 'kept' END AS reason FROM symbols) GROUP BY 1", "symbols"))
def purge(spark: SparkSession, sf: str) -> DataFrame:
    reason = rl.first_failure({"flat": ~F.col("path").like("%/%/%"), "ignored": F.col("path").contains("/brand_3/"), "untracked": F.col("line") % 10 == 0})
    return symbols(spark, sf).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_19_canonical_tags", with_views("SELECT id, list_sort(list_distinct(list_concat(list_filter(tags, lambda t: length(t) > 6), ['brand']))) AS tags FROM symbols", "symbols"))
def canonical_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.array_sort(F.array_distinct(F.concat(F.filter("tags", lambda t: F.length(t) > 6), F.array(F.lit("brand")))))
    return symbols(spark, sf).select("id", t.alias("tags"))


@query("flt_20_true_aliases", with_views("SELECT id, path FROM symbols WHERE NOT contains(path, 'mod_1') AND NOT contains(path, '/small/')", "symbols"))
def true_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).where(~F.col("path").contains("mod_1") & ~F.col("path").contains("/small/")).select("id", "path")


@query("flt_21_default_intent", with_views("SELECT id, CASE WHEN contains(lower(name), 'ring') THEN 'Test' WHEN contains(lower(name), 'bolt') THEN 'Util' WHEN contains(lower(name), 'widget') THEN 'Config' ELSE 'Core' END AS intent FROM symbols", "symbols"))
def default_intent(spark: SparkSession, sf: str) -> DataFrame:
    n = F.lower("name")
    return symbols(spark, sf).select("id", F.when(n.contains("ring"), "Test").when(n.contains("bolt"), "Util").when(n.contains("widget"), "Config").otherwise("Core").alias("intent"))


@query("flt_05_feature_cap", with_views("SELECT id, list_concat(list_concat([tags[1]], [tags[2]]), [tags[3]]) AS features FROM symbols", "symbols"))
def feature_cap(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda k: F.array(F.element_at("tags", k))
    return symbols(spark, sf).select("id", rl.cap_features(t(1), t(2), t(3)).alias("features"))


# --- scalar functions


@query("fn_01_normalise_token", "SELECT p_partkey, lower(trim('  ' || p_brand || ' ')) AS token FROM part")
def normalise_token(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.normalise(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("token"))


@query("fn_03_fingerprints", with_views("SELECT id, sha256(name || ':' || kind) AS short_print, sha256(name || '|' || kind || '|' || path) AS full_print FROM symbols", "symbols"))
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", text.fingerprint(F.col("name"), F.col("kind"), sep=":").alias("short_print"), text.fingerprint(F.col("name"), F.col("kind"), F.col("path")).alias("full_print"))


@query("fn_04_uid", with_views("SELECT id, 'sym::' || replace(path, '/', '.') || '::' || name || '::' || substr(sha256(path || '::' || name), 1, 16) AS uid FROM symbols", "symbols"))
def uid(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", text.uid(F.col("path"), F.col("name")).alias("uid"))


@query("fn_06_graph_checksum", with_views("SELECT substr(md5(sum(('0x' || substr(md5(src || '>' || dst), 1, 12))::BIGINT)::VARCHAR), 1, 8) AS short, substr(sha256(sum(('0x' || substr(md5(src || '>' || dst), 1, 12))::BIGINT)::VARCHAR), 1, 16) AS long FROM calls", "calls"))
def checksum(spark: SparkSession, sf: str) -> DataFrame:
    """Of the graph whatever the order of its edges: hashes of the edges are summed, and the sum hashed."""
    one = F.conv(F.substring(F.md5(F.concat("src", F.lit(">"), "dst").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    total = calls(spark, sf).agg(F.sum(one).cast("string").alias("t")).select(F.col("t").cast("binary").alias("t"))
    return total.select(F.substring(F.md5("t"), 1, 8).alias("short"), F.substring(F.sha2("t", 256), 1, 16).alias("long"))


#: CRC-32 of ASCII text in SQL: the table of the reflected polynomial, then a reduction over the bytes.
CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_sql(text_: str) -> str:
    return f"printf('%08x', xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text_}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT))"


@query("fn_07_crc", f"WITH {CRC} SELECT p_partkey, {crc_sql('p_name')} AS crc FROM part, crc_table")
def crc(spark: SparkSession, sf: str) -> DataFrame:
    """CRC-32 as eight hex digits."""
    return table(spark, sf, "part").select("p_partkey", text.crc_hex(F.col("p_name")).alias("crc"))


@query("fn_08_language_module", with_views("SELECT id, 'python' AS language, replace(regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), '/', '.') AS module FROM symbols", "symbols"))
def language_module(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", text.language(F.col("path")).alias("language"), text.module(F.col("path")).alias("module"))


@query("fn_57_short_name", with_views("SELECT id, 'sym::' || name AS short FROM symbols", "symbols"))
def short_name(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", text.short_name(text.uid(F.col("path"), F.col("name"))).alias("short"))


@query("fn_15_endpoints", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS endpoint FROM pages")
def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("endpoint"))


@query("fn_14_reference_pattern", "SELECT doc_id, len(regexp_extract_all(text, '\\b([A-Z][a-z]*) ([a-z]+)\\.')) AS found FROM documents")
def references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\b([A-Z][a-z]*) ([a-z]+)\.")).alias("found"))


@query("fn_39_semantic_score", with_views(f"""SELECT id, round(greatest(0, 0.5::DOUBLE + CASE role {" ".join(f"WHEN '{k}' THEN {v}" for k, v in rl.ROLE_BOOST.items())} ELSE 0 END + CASE intent {" ".join(f"WHEN '{k}' THEN {v}" for k, v in rl.INTENT_BOOST.items())} ELSE 0 END
    - CASE WHEN is_noisy THEN 0.4 ELSE 0 END), 6) AS score FROM symbols""", "symbols"))  # fmt: skip
def score(spark: SparkSession, sf: str) -> DataFrame:
    s = rl.semantic_score(F.lit(0.5), F.array("role"), F.col("intent"), F.col("is_noisy"), F.lit(False))
    return symbols(spark, sf).select("id", r6(s).alias("score"))


TRUST = """SELECT c_custkey, round(least((0.4::DOUBLE * f + 0.3::DOUBLE * r + 0.2::DOUBLE * u + 0.1::DOUBLE * c) * pow(d, 4) * CASE WHEN v THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 1.0::DOUBLE), 4) AS trust FROM
    (SELECT c_custkey, (c_custkey % 10) / 10.0::DOUBLE AS f, (c_custkey % 7) / 7.0::DOUBLE AS r, (c_custkey % 5) / 5.0::DOUBLE AS u, (c_custkey % 3) / 3.0::DOUBLE AS c, 1 - (c_custkey % 4) / 10.0::DOUBLE AS d, c_acctbal > 0 AS v FROM customer)"""


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    t = en.trust(k % 10 / 10.0, k % 7 / 7.0, k % 5 / 5.0, k % 3 / 3.0, 1 - k % 4 / 10.0, F.col("c_acctbal") > 0, F.lit(1.0))
    return table(spark, sf, "customer").select("c_custkey", t.alias("trust"))


@query("fn_49_trust", TRUST)
def trust(spark: SparkSession, sf: str) -> DataFrame:
    return trusted(spark, sf)


@query("fn_50_heal_decision", f"WITH t AS ({TRUST}), h AS (SELECT trust, (c_custkey % 21 - 15) / 100.0::DOUBLE AS delta FROM t) SELECT CASE WHEN delta >= 0 THEN 'accept' WHEN trust < 0.5 THEN 'reject' WHEN trust < 0.7 AND delta < -0.05 THEN 'reject' WHEN trust >= 0.7 AND delta < -0.01 THEN 'review' ELSE 'accept' END AS decision, count(*) AS n FROM h GROUP BY 1")
def heal(spark: SparkSession, sf: str) -> DataFrame:
    t = trusted(spark, sf)
    return t.groupBy(rl.heal(F.col("trust"), (F.col("c_custkey") % 21 - 15) / 100.0).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("str_35_upstream_trust", with_views("WITH t AS (SELECT id, round(1 - (line % 10) / 20.0::DOUBLE, 6) AS trust FROM symbols WHERE line % 3 <> 0) SELECT t.id, least(t.trust, coalesce(min(coalesce(u.trust, 1.0::DOUBLE)), 1.0::DOUBLE)) AS trust FROM t LEFT JOIN calls ON src = t.id LEFT JOIN t u ON u.id = dst GROUP BY t.id, t.trust", "symbols", "calls"))
def upstream_trust(spark: SparkSession, sf: str) -> DataFrame:
    t = symbols(spark, sf).where("line % 3 <> 0").select("id", r6(1 - F.col("line") % 10 / 20.0).alias("trust"))
    return rl.upstream_trust(t, calls(spark, sf))


@query("fn_51_containers", with_views("SELECT kind, CASE WHEN kind IN ('class', 'interface', 'module', 'protocol') THEN 'container' ELSE 'executor' END AS node_type, count(*) AS n FROM symbols GROUP BY 1, 2", "symbols"))
def containers(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).groupBy("kind", roles.node_type(F.col("kind")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_54_json", with_views("SELECT id, '{\"kind\":\"' || kind || '\",\"line\":' || line || '}' AS doc, kind AS back FROM symbols", "symbols"))
def json(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.to_json(F.struct("kind", "line"))
    return symbols(spark, sf).select("id", doc.alias("doc"), F.get_json_object(doc, "$.kind").alias("back"))


@query("fn_42_noise_by_collision", "SELECT p_name, count(*) > 1 AS collides FROM part GROUP BY p_name")
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_name").agg((F.count(F.lit(1)) > 1).alias("collides"))


@query("fn_43_hub_tag", with_views("SELECT src AS id, count(*) > 50 AS hub FROM categories GROUP BY src", "categories"))
def hub_tag(spark: SparkSession, sf: str) -> DataFrame:
    return categories(spark, sf).groupBy(F.col("src").alias("id")).agg((F.count(F.lit(1)) > 50).alias("hub"))


# --- refinement

RESULTS = "res AS (SELECT id, kind, CASE WHEN line % 3 = 0 THEN 'structural' ELSE 'semantic' END AS layer, round(1 - line / 1000.0::DOUBLE, 6) AS weight, is_noisy, intent, length(name) AS tokens FROM symbols)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", "kind", F.when(F.col("line") % 3 == 0, "structural").otherwise("semantic").alias("layer"), r6(1 - F.col("line") / 1000.0).alias("weight"), "is_noisy", "intent", F.length("name").alias("tokens"))


@query("ref_01_refine", with_views(f"""WITH {RESULTS}, k AS (SELECT *, CASE WHEN layer = 'structural' AND (kind IN ('class', 'interface', 'protocol', 'module') OR weight >= 0.8) THEN 'primary' WHEN layer = 'structural' THEN 'secondary' ELSE 'related' END AS bucket,
    sum(tokens) OVER (ORDER BY weight DESC, id) - tokens AS before FROM res WHERE NOT is_noisy OR weight >= 0.8) SELECT id, bucket, weight FROM k WHERE before <= 1000""", "symbols"))  # fmt: skip
def refine(spark: SparkSession, sf: str) -> DataFrame:
    return rl.refine(results(spark, sf), 1000).select("id", "bucket", "weight")


@query("ref_02_semantic_groups", with_views(f"""WITH {RESULTS}, g AS (SELECT intent, id, weight AS score, row_number() OVER (PARTITION BY intent ORDER BY weight DESC, id) AS rn FROM res), t AS (SELECT intent, round(sum(score), 6) AS total FROM g WHERE rn <= 3 GROUP BY intent)
    SELECT g.intent, id, rn::INT AS rn, total, place::INT AS place FROM g JOIN (SELECT *, row_number() OVER (ORDER BY total DESC, intent) AS place FROM t) USING (intent) WHERE rn <= 3""", "symbols"))  # fmt: skip
def semantic_groups(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).select("intent", "id", F.col("weight").alias("score"))
    return rl.top_by_intent(r).select("intent", "id", "rn", "total", "place")


@query("win_06_payload_levels", with_views(f"WITH {RESULTS} SELECT id, CASE WHEN rn <= 5 THEN 'full' WHEN rn <= 20 THEN 'stripped' ELSE 'none' END AS payload FROM (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS rn FROM res) WHERE rn <= 40", "symbols"))
def payload_levels(spark: SparkSession, sf: str) -> DataFrame:
    top = results(spark, sf).orderBy(F.desc("weight"), "id").limit(40)
    return top.select("id", rl.payload(F.row_number().over(Window.orderBy(F.desc("weight"), "id"))).alias("payload"))


@query("win_07_token_budget", with_views(f"WITH {RESULTS} SELECT id FROM (SELECT id, sum(tokens) OVER (ORDER BY weight DESC, id) AS upto FROM res) WHERE upto <= 800", "symbols"))
def budget(spark: SparkSession, sf: str) -> DataFrame:
    return rl.cut_at(results(spark, sf), 800, keep_first_over=False).select("id")


@query("ref_03_enrich", with_views("SELECT s.id, coalesce(d.in_degree, 0) AS in_degree, coalesce(round(d.out_weight, 6), 0.5) AS out_weight FROM symbols s LEFT JOIN degrees d USING (id)", "symbols", "degrees"))
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf)).select("id", "in_degree", r6("out_weight").alias("out_weight"))
    return symbols(spark, sf).select("id").join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_weight", F.lit(0.5)).alias("out_weight"))


@query("ref_06_suggestions", with_views("SELECT src AS category, count(*) AS n FROM categories WHERE src LIKE 'cat::%' GROUP BY 1 ORDER BY n DESC, category LIMIT 20", "categories"))
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return categories(spark, sf).where("src like 'cat::%'").groupBy(F.col("src").alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(20)


# --- audits


@query("agg_15_entropy_score", with_views("""WITH o AS (SELECT src, count(*) AS n FROM categories GROUP BY src) SELECT round(0.1::DOUBLE * avg(n) + 100 * avg((n > 50)::INT) + 10 * (SELECT var_samp(weight) FROM categories), 5) AS score FROM o""", "categories"))
def entropy_score(spark: SparkSession, sf: str) -> DataFrame:
    e = categories(spark, sf)
    o = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg((0.1 * F.avg("n") + 100 * F.avg((F.col("n") > 50).cast("int"))).alias("a"))
    return o.crossJoin(e.agg(F.var_samp("weight").alias("v"))).select(F.round(F.col("a") + 10 * F.col("v"), 5).alias("score"))  # one row each


@query("agg_20_index_quality", with_views("""WITH d AS (SELECT id, coalesce(in_degree + out_degree, 0) AS n FROM symbols LEFT JOIN degrees USING (id)), g AS (SELECT round(avg(n), 4) AS average, round(100.0::DOUBLE * avg((n = 0)::INT), 4) AS isolated FROM d)
    SELECT average, isolated, CASE WHEN average >= 10 AND isolated < 10 THEN 'A' WHEN average >= 5 AND isolated < 15 THEN 'B' WHEN average >= 3 AND isolated < 20 THEN 'C' WHEN average >= 1 AND isolated < 30 THEN 'D' ELSE 'F' END AS grade FROM g""", "symbols", "degrees"))  # fmt: skip
def index_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = symbols(spark, sf).select("id").join(st.degrees(calls(spark, sf)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("n")), "id", "left")
    n = F.coalesce("n", F.lit(0))
    g = d.agg(F.round(F.avg(n), 4).alias("average"), F.round(100.0 * F.avg((n == 0).cast("int")), 4).alias("isolated"))
    return g.withColumn("grade", rl.node_kind_grade(F.col("average"), F.col("isolated"), F.lit(100)))


@query("agg_21_registry_quality", with_views("SELECT intent, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (NOT is_noisy) / count(*), 3) AS clean, round(100.0::DOUBLE * count(*) FILTER (kind = 'class') / count(*), 3) AS classes FROM symbols GROUP BY intent", "symbols"))
def registry_quality(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 3)
    return symbols(spark, sf).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), share(~F.col("is_noisy")).alias("clean"), share(F.col("kind") == "class").alias("classes"))


@query("agg_25_type_summary", with_views("SELECT split_part(src, '::', 1) AS type, count(*) AS n FROM categories GROUP BY 1", "categories"))
def type_summary(spark: SparkSession, sf: str) -> DataFrame:
    return categories(spark, sf).groupBy(F.substring_index("src", "::", 1).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_29_documentation_coverage", with_views("WITH core AS (SELECT id, is_noisy FROM symbols WHERE kind = 'class'), documented AS (SELECT DISTINCT dst AS id FROM calls) SELECT count(*) AS core, count(d.id) AS documented, round(count(d.id) / count(*)::DOUBLE, 6) AS coverage FROM core LEFT JOIN documented d USING (id)", "symbols", "calls"))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = calls(spark, sf).select(F.col("dst").alias("id")).distinct().withColumn("d", F.lit(1))
    c = symbols(spark, sf).where("kind = 'class'").select("id").join(d, "id", "left")
    return c.agg(F.count(F.lit(1)).alias("core"), F.count("d").alias("documented"), r6(F.count("d") / F.count(F.lit(1))).alias("coverage"))


@query("agg_30_domain_panorama", with_views("""WITH d AS (SELECT id, CASE WHEN intent = 'io' THEN 'data_persistence' WHEN intent = 'network' THEN 'async_coordination' WHEN intent = 'test' THEN 'error_resilience' ELSE 'data_transformation' END AS domain, complexity FROM symbols),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY complexity DESC, id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM d) SELECT domain, n, id AS anchor FROM r WHERE rn = 1""", "symbols"))  # fmt: skip
def panorama(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("intent")
    domain = F.when(i == "io", "data_persistence").when(i == "network", "async_coordination").when(i == "test", "error_resilience").otherwise("data_transformation")
    g = symbols(spark, sf).groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("complexity")).alias("c"), "id")).alias("b"))
    return g.select("domain", "n", F.col("b.id").alias("anchor"))


@query("str_32_fix_plan", with_views("SELECT 'downweight' AS fix, src AS target, '0.3' AS value FROM categories GROUP BY src HAVING count(*) > 50", "categories"))
def fix_plan(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "region").select("r_name")
    return rl.fix_plan(categories(spark, sf), names)


@query("str_33_plan_filter", with_views("SELECT src AS target FROM categories GROUP BY src HAVING count(*) > 50 AND src NOT LIKE 'cat::brand_1%' AND src <> 'cat::size_7'", "categories"))
def plan_filter(spark: SparkSession, sf: str) -> DataFrame:
    plan = rl.fix_plan(categories(spark, sf), table(spark, sf, "region").select("r_name"))
    done = plan.where("target like 'cat::brand_1%'").select(F.sha2(F.concat_ws("|", "fix", "target", "value"), 256).alias("hash"), "target")
    frozen = plan.sparkSession.range(3).select(F.concat(F.lit("x"), "id").alias("hash"), F.lit("cat::size_7").alias("target"))
    return rl.without_applied(plan, done.unionByName(frozen)).select("target")


@query("str_34_invariants", with_views("SELECT 'out_degree' AS invariant, count(*) AS violations FROM (SELECT src FROM categories GROUP BY src HAVING count(*) > 50) UNION ALL SELECT 'alias_unique', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)", "categories"))
def invariants(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda df, name: df.where("n > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
    out = categories(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 50")
    return n(out, "out_degree").unionByName(n(table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), "alias_unique"))


@query("joi_18_energy_overlay", with_views("WITH o AS (SELECT id, round(out_weight, 6) AS e FROM degrees WHERE out_degree > 2) SELECT s.id, coalesce(o.e, s.complexity) AS energy FROM symbols s LEFT JOIN o USING (id)", "symbols", "degrees"))
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    o = st.degrees(calls(spark, sf)).where("out_degree > 2").select("id", r6("out_weight").alias("e"))
    return symbols(spark, sf).select("id", "complexity").join(o, "id", "left").select("id", F.coalesce("e", "complexity").alias("energy"))


@query("joi_19_mi_merge", with_views("WITH m AS (SELECT id, 0.9::DOUBLE AS mi FROM symbols WHERE line % 5 = 0), t AS (SELECT id, round(out_weight / 10, 6) AS mi FROM degrees WHERE out_degree > 1) SELECT coalesce(m.id, t.id) AS id, coalesce(m.mi, t.mi) AS mi, CASE WHEN m.id IS NOT NULL THEN 'manual' ELSE 'derived' END AS source FROM m FULL JOIN t ON m.id = t.id", "symbols", "degrees"))
def mi_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = symbols(spark, sf).where("line % 5 = 0").select("id", F.lit(0.9).alias("manual"))
    t = st.degrees(calls(spark, sf)).where("out_degree > 1").select("id", r6(F.col("out_weight") / 10).alias("derived"))
    return m.join(t, "id", "full").select("id", F.coalesce("manual", "derived").alias("mi"), F.when(F.col("manual").isNotNull(), "manual").otherwise("derived").alias("source"))


@query("agg_16_success_rate", "SELECT source, count(*) AS n, round(avg(quality), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def success_rate(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("quality")).alias("rate"))


@query("fn_38_mi_blend", "WITH r AS (SELECT source, count(*) AS n, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, round(greatest(0.1::DOUBLE, 1 - n / 100.0::DOUBLE) * 0.5::DOUBLE + (1 - greatest(0.1::DOUBLE, 1 - n / 100.0::DOUBLE)) * rate, 4) AS mi, round(greatest(0.3, least(1, 0.5::DOUBLE + 0.5::DOUBLE * rate)), 4) AS factor FROM r")
def mi_blend(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate"))
    return g.select("source", en.mi_blend(F.lit(0.5), F.col("rate"), F.col("n")).alias("mi"), en.edge_factor(F.col("rate")).alias("factor"))


@query("res_16_confusion", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"), F.count_if(~q & ~t).alias("tn"))


@query("res_04_signature_collisions", "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def signature_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("res_01_garbage_scan", with_views("SELECT 'orphan_edge' AS problem, count(*) AS n FROM calls WHERE dst NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'short_category', count(*) FROM (SELECT DISTINCT src FROM categories WHERE src LIKE 'cat::%' AND length(src) <= 11)", "symbols", "calls", "categories"))
def garbage(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    orphan = calls(spark, sf).join(symbols(spark, sf).select(F.col("id").alias("dst")), "dst", "left_anti")
    short = categories(spark, sf).where("src like 'cat::%' and length(src) <= 11").select("src").distinct()
    return n(orphan, "orphan_edge").unionByName(n(short, "short_category"))


# --- concurrency

ATOMS = """atoms AS (SELECT 't' || conv_id AS thread, turn AS pos, CASE WHEN length(text) % 5 IN (0, 1) THEN 'ACQ' WHEN length(text) % 5 IN (2, 3) THEN 'REL' ELSE 'AWT' END AS op, 'L' || (length(text) % 3) AS arg FROM conversations)"""


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf, "conversations").select(F.concat(F.lit("t"), "conv_id").alias("thread"), F.col("turn").alias("pos"), F.when((n % 5).isin(0, 1), "ACQ").when((n % 5).isin(2, 3), "REL").otherwise("AWT").alias("op"), F.concat(F.lit("L"), n % 3).alias("arg"))


@query("con_05_lock_rules", f"""WITH {ATOMS}, l AS (SELECT thread, arg AS lock, op, sum(CASE op WHEN 'ACQ' THEN 1 ELSE -1 END) OVER (PARTITION BY thread, arg ORDER BY pos) AS held FROM atoms WHERE op IN ('ACQ', 'REL')),
    w AS (SELECT DISTINCT thread FROM (SELECT *, sum(CASE op WHEN 'ACQ' THEN 1 WHEN 'REL' THEN -1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY pos) AS h FROM atoms) WHERE op = 'AWT' AND h > 0),
    g AS (SELECT thread, lock, count(*) FILTER (op = 'ACQ') AS a, count(*) FILTER (op = 'REL') AS r, min(held) AS low FROM l GROUP BY 1, 2)
    SELECT g.thread, lock, CASE WHEN low < 0 THEN 'released_before_held' WHEN a > r THEN 'must_have_release' WHEN r > a THEN 'unmatched_release' WHEN w.thread IS NOT NULL THEN 'waits_while_holding' END AS failed FROM g LEFT JOIN w ON w.thread = g.thread""")
def lock_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rl.lock_rules(atoms(spark, sf))


@query("con_06_lock_order_conflicts", f"""WITH {ATOMS}, held AS (SELECT a.thread, a.arg AS first, a.pos AS p, (SELECT min(r.pos) FROM atoms r WHERE r.op = 'REL' AND r.thread = a.thread AND r.arg = a.arg AND r.pos > a.pos) AS r FROM atoms a WHERE a.op = 'ACQ'),
    o AS (SELECT DISTINCT h.thread, h.first, x.arg AS th FROM held h JOIN atoms x ON x.thread = h.thread AND x.op = 'ACQ' AND x.pos > h.p AND (h.r IS NULL OR x.pos < h.r) AND x.arg <> h.first), n AS (SELECT first, th, count(*) AS threads FROM o GROUP BY 1, 2)
    SELECT a.first, a.th AS "then", a.threads, b.threads AS against FROM n a JOIN n b ON a.first = b.th AND a.th = b.first WHERE a.first < a.th""")
def lock_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Lock pairs taken in both orders, with how many pairs of threads do."""
    order = rl.lock_order(atoms(spark, sf)).groupBy("first", "then").agg(F.count(F.lit(1)).alias("threads"))
    back = order.select(F.col("first").alias("then"), F.col("then").alias("first"), F.col("threads").alias("against"))
    return order.join(back, ["first", "then"]).where("first < then").select("first", "then", "threads", "against")


@query("con_07_unreleased", f"WITH {ATOMS}, a AS (SELECT thread, arg AS lock, count(*) FILTER (op = 'ACQ') - count(*) FILTER (op = 'REL') AS missing, max(pos) FILTER (op = 'ACQ') AS after FROM atoms GROUP BY 1, 2) SELECT thread, lock, missing, after FROM a WHERE missing > 0")
def unreleased(spark: SparkSession, sf: str) -> DataFrame:
    g = atoms(spark, sf).groupBy("thread", F.col("arg").alias("lock")).agg((F.count_if(F.col("op") == "ACQ") - F.count_if(F.col("op") == "REL")).alias("missing"), F.max(F.when(F.col("op") == "ACQ", F.col("pos"))).alias("after"))
    return g.where("missing > 0")


@query("win_12_latest_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("win_08_moving_entropy", "SELECT p_partkey, round(avg(p_retailprice) OVER w, 5) AS mean, coalesce(abs(p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey)) < 5, FALSE) AS stable FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def moving(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    near = F.abs(F.col("p_retailprice") - F.lag("p_retailprice").over(w)) < 5
    return table(spark, sf, "part").select("p_partkey", F.round(F.avg("p_retailprice").over(w.rowsBetween(-4, 0)), 5).alias("mean"), F.coalesce(near, F.lit(False)).alias("stable"))
