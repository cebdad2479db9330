"""Degrees, roles, triangles, curvature, gates and rankings on the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, categories, contains, symbols, table, with_views
from ..operators import structure as st
from ..registry import query, r6, rounded

DEG = "SELECT id, out_degree, in_degree, round(out_weight, 6) AS out_weight, round(in_weight, 6) AS in_weight FROM degrees"


@query("agg_07_degrees", with_views(DEG, "degrees"))
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.degrees(calls(spark, sf)), "out_weight", "in_weight")


NODE_ROLE = """CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN out_degree = 0 THEN 'sink' WHEN in_degree = 0 THEN 'source'
    WHEN in_degree >= 10 AND out_degree >= 10 THEN 'hub' WHEN in_degree >= 5 AND out_degree >= 5 THEN 'bridge' ELSE 'leaf' END"""


@query("fn_31_node_roles", with_views(f"SELECT {NODE_ROLE} AS role, count(*) AS n FROM degrees GROUP BY 1", "degrees"))
def node_roles(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf))
    return d.groupBy(st.node_role(F.col("in_degree"), F.col("out_degree")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("top_02_hubs_and_sinks", with_views(f"""(SELECT 'hub' AS side, id, {NODE_ROLE} AS role, out_degree AS degree FROM degrees ORDER BY out_degree DESC, id LIMIT 20)
    UNION ALL (SELECT 'sink', id, {NODE_ROLE}, in_degree FROM degrees ORDER BY in_degree DESC, id LIMIT 20)""", "degrees"))  # fmt: skip
def hubs(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf)).withColumn("role", st.node_role(F.col("in_degree"), F.col("out_degree")))
    side = lambda name, by: d.orderBy(F.desc(by), "id").limit(20).select(F.lit(name).alias("side"), "id", "role", F.col(by).alias("degree"))
    return side("hub", "out_degree").unionByName(side("sink", "in_degree"))


@query("agg_06_graph_totals", with_views("""SELECT (SELECT count(*) FROM degrees) AS nodes, count(*) AS edges, round(avg(n), 6) AS avg_out, max(n) AS max_out
    FROM (SELECT src, count(*) AS n FROM calls GROUP BY src), (SELECT 1)""", "degrees").replace("count(*) AS edges", "sum(n)::BIGINT AS edges"))  # fmt: skip
def totals(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("edges"), r6(F.avg("n")).alias("avg_out"), F.max("n").alias("max_out"))
    nodes = st.ends(e).agg(F.count_distinct("id").alias("nodes"))
    return out.crossJoin(nodes)  # one row each


@query("str_05_features", with_views("SELECT id, out_degree, in_degree, round(centrality, 6) AS centrality, round(betweenness, 6) AS betweenness, round(clustering, 6) AS clustering FROM features", "features"))
def features(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf)).select("id", "out_degree", "in_degree", "centrality", "betweenness", "clustering")
    return rounded(f, "centrality", "betweenness", "clustering")


SCORES = """(CASE WHEN out_degree > 10 THEN .4 ELSE 0 END + CASE WHEN centrality > .7 THEN .3 ELSE 0 END + CASE WHEN clustering < .3 THEN .3 ELSE 0 END)::DOUBLE AS hub,
    (CASE WHEN betweenness > .5 THEN .5 ELSE 0 END)::DOUBLE + CASE WHEN in_degree > 0 AND out_degree > 0 THEN 0.5::DOUBLE * (least(in_degree, out_degree) / greatest(in_degree, out_degree)::DOUBLE) ELSE 0 END AS bridge,
    (CASE WHEN in_degree > 5 AND out_degree < 3 THEN .6 ELSE 0 END + CASE WHEN in_degree > 2 * out_degree THEN .4 ELSE 0 END)::DOUBLE AS sink,
    (CASE WHEN in_degree + out_degree <= 2 THEN .7 ELSE 0 END + CASE WHEN out_degree = 0 THEN .3 ELSE 0 END)::DOUBLE AS leaf"""
ROLE = "CASE WHEN round(hub, 9) = round(greatest(hub, bridge, sink, leaf), 9) THEN 'hub' WHEN round(bridge, 9) = round(greatest(hub, bridge, sink, leaf), 9) THEN 'bridge' WHEN round(sink, 9) = round(greatest(hub, bridge, sink, leaf), 9) THEN 'sink' ELSE 'leaf' END"


@query("str_08_topology_roles", with_views(f"SELECT id, {ROLE} AS role, round(greatest(hub, bridge, sink, leaf), 6) AS role_confidence FROM (SELECT id, {SCORES} FROM features)", "features"))
def topology_roles(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf))
    role, score = st.topology_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness", "clustering")))
    return f.select("id", role.alias("role"), r6(score).alias("role_confidence"))


@query("agg_08_entry_variance_noise", with_views("SELECT id, round(entry_variance + 1e-9, 6) AS entry_variance, round(structural_noise + 1e-9, 6) AS structural_noise FROM states", "states"))
def variation(spark: SparkSession, sf: str) -> DataFrame:
    v = st.variation(calls(spark, sf))
    return v.select("id", r6(F.col("entry_variance") + 1e-9).alias("entry_variance"), r6(F.col("structural_noise") + 1e-9).alias("structural_noise"))


TRI = """tri AS (SELECT e.src AS u, e.dst AS v, (SELECT count(*) FROM calls a JOIN calls b ON a.dst = b.dst WHERE a.src = e.src AND b.src = e.dst) AS transitive,
    (SELECT count(*) FROM calls a JOIN calls b ON a.dst = b.src WHERE a.src = e.dst AND b.dst = e.src) AS feedback FROM calls e)"""
TRI = """tri AS (SELECT e.src AS u, e.dst AS v, coalesce(t.n, 0) AS transitive, coalesce(f.n, 0) AS feedback FROM calls e
    LEFT JOIN (SELECT a.src AS u, b.src AS v, count(*) AS n FROM calls a JOIN calls b ON a.dst = b.dst JOIN calls c ON c.src = a.src AND c.dst = b.src GROUP BY 1, 2) t ON t.u = e.src AND t.v = e.dst
    LEFT JOIN (SELECT b.dst AS u, a.src AS v, count(*) AS n FROM calls a JOIN calls b ON a.dst = b.src JOIN calls c ON c.src = b.dst AND c.dst = a.src GROUP BY 1, 2) f ON f.u = e.src AND f.v = e.dst)"""
CURV = """curv AS (SELECT u, v, transitive, feedback, 4 - (a.in_degree + a.out_degree) - (b.in_degree + b.out_degree) + 3 * transitive AS raw,
    (4 - (a.in_degree + a.out_degree) - (b.in_degree + b.out_degree) + 3 * transitive) / (1 + greatest(a.in_degree + a.out_degree, b.in_degree + b.out_degree))::DOUBLE AS norm
    FROM tri JOIN degrees a ON a.id = u JOIN degrees b ON b.id = v)"""


@query("str_02_triangles", with_views(f"WITH {TRI} SELECT * FROM tri", "calls"))
def triangles(spark: SparkSession, sf: str) -> DataFrame:
    return st.triangles(calls(spark, sf))


@query("str_03_curvature", with_views(f"WITH {TRI}, {CURV} SELECT u, v, transitive, feedback, raw, round(norm, 6) AS norm, norm < -0.5 AS is_boundary FROM curv", "calls", "degrees"))
def curvature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.curvature(calls(spark, sf)), "norm")


@query("str_04_curvature_lookup", with_views(f"WITH {TRI}, {CURV} SELECT u, v, round(norm, 6) AS norm, round(norm * (1 + greatest(a.in_degree + a.out_degree, b.in_degree + b.out_degree)), 6) AS raw FROM curv JOIN degrees a ON a.id = u JOIN degrees b ON b.id = v", "calls", "degrees"))
def cached_curvature(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    d = st.degrees(e).select("id", (F.col("in_degree") + F.col("out_degree")).alias("n"))
    c = st.curvature(e).select("u", "v", "norm")
    c = c.join(d.withColumnsRenamed({"id": "u", "n": "du"}), "u").join(d.withColumnsRenamed({"id": "v", "n": "dv"}), "v")
    return c.select("u", "v", r6("norm").alias("norm"), r6(F.col("norm") * (1 + F.greatest("du", "dv"))).alias("raw"))


@query("agg_18_curvature_stats", with_views(f"""WITH {TRI}, {CURV} SELECT count(*) AS edges, round(avg(norm), 2) AS mean, round(min(norm), 2) AS low, round(max(norm), 2) AS high,
    round(stddev_pop(norm), 2) AS dev, count(*) FILTER (norm < -0.5) AS boundary FROM curv""", "calls", "degrees"))  # fmt: skip
def curvature_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = st.curvature(calls(spark, sf))
    two = lambda x: F.round(x, 2)
    return c.agg(F.count(F.lit(1)).alias("edges"), two(F.avg("norm")).alias("mean"), two(F.min("norm")).alias("low"), two(F.max("norm")).alias("high"), two(F.stddev_pop("norm")).alias("dev"), F.count_if("is_boundary").alias("boundary"))


@query("fn_22_friction_map", with_views(f"WITH {TRI}, {CURV} SELECT u, v, round(exp(least(5, -0.5::DOUBLE * raw)), 6) AS friction FROM curv", "calls", "degrees"))
def friction(spark: SparkSession, sf: str) -> DataFrame:
    c = st.curvature(calls(spark, sf))
    return c.select("u", "v", r6(st.friction(F.col("raw"))).alias("friction"))


@query("agg_32_quality_report", with_views(f"""WITH {TRI}, {CURV} SELECT count(*) AS edges, (count(DISTINCT u) + count(DISTINCT v))::BIGINT AS nodes_counted_twice, round(avg(transitive), 6) AS triangles_per_edge,
    round(avg((transitive > 0)::INT), 6) AS transitive_share, round(avg(norm), 6) AS mean_curvature, round(avg(exp(least(5, -0.5::DOUBLE * norm))), 6) AS mean_friction FROM curv""", "calls", "degrees"))  # fmt: skip
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    c = st.curvature(calls(spark, sf))
    return c.agg(
        F.count(F.lit(1)).alias("edges"), (F.count_distinct("u") + F.count_distinct("v")).alias("nodes_counted_twice"), r6(F.avg("transitive")).alias("triangles_per_edge"),
        r6(F.avg((F.col("transitive") > 0).cast("int"))).alias("transitive_share"), r6(F.avg("norm")).alias("mean_curvature"), r6(F.avg(st.friction(F.col("norm")))).alias("mean_friction"),
    )


PCT = ", ".join(f"round(cume_dist() OVER (ORDER BY {m}), 6) AS pct_{m}" for m in ("in_degree", "out_degree", "frequency"))


@query("win_01_percentiles", with_views(f"SELECT id, {PCT} FROM states", "states"))
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    names = ["in_degree", "out_degree", "frequency"]
    p = st.percentiles(st.states(calls(spark, sf)).select("id", *names), *names)
    return p.select("id", *(r6(f"pct_{m}").alias(f"pct_{m}") for m in names))


@query("win_02_normalise", with_views("SELECT id, round(out_degree / max(out_degree) OVER ()::DOUBLE, 6) AS out_share, round(in_degree / max(in_degree) OVER ()::DOUBLE, 6) AS in_share FROM degrees", "degrees"))
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = st.with_maximum(st.degrees(calls(spark, sf)), "out_degree", "in_degree")
    return d.select("id", r6(F.col("out_degree") / F.col("max_out_degree")).alias("out_share"), r6(F.col("in_degree") / F.col("max_in_degree")).alias("in_share"))


@query("win_11_topk_prune", with_views("SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM categories) WHERE rn <= 5", "categories"))
def prune(spark: SparkSession, sf: str) -> DataFrame:
    return st.strongest(categories(spark, sf), 5).select("src", "dst", "weight")


@query("win_10_neighbour_cap", with_views("SELECT src, dst, weight FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY src) AS n FROM categories WINDOW w AS (PARTITION BY src ORDER BY weight DESC, dst)) WHERE n <= 12 OR rn <= 10", "categories"))
def cap(spark: SparkSession, sf: str) -> DataFrame:
    return st.strongest(categories(spark, sf), 10, only_above=12).select("src", "dst", "weight")


@query("trv_09_hub_normaliser", with_views("""SELECT src, dst, round(CASE WHEN src LIKE 'cat::%' AND n > 10 OR src LIKE 'sym::%' AND n > 50 THEN weight / log10(n + 1) ELSE weight END, 6) AS weight
    FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM categories)""", "categories"))  # fmt: skip
def normaliser(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.normaliser(categories(spark, sf)).select("src", "dst", "weight"), "weight")


@query("trv_10_edge_pruner", with_views("SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM categories) WHERE rn <= 200", "categories"))
def pruner(spark: SparkSession, sf: str) -> DataFrame:
    return st.strongest(categories(spark, sf), 200).select("src", "dst", "weight")


@query("trv_11_mi_adjacency", with_views("""WITH both_ AS (SELECT src, dst, kind, weight FROM calls UNION ALL SELECT src, dst, kind, weight FROM categories WHERE kind = 'category'),
    mi AS (SELECT id, 0.5::DOUBLE + (substr(id, 6)::INT % 10) / 20.0::DOUBLE AS mi FROM symbols),
    adj AS (SELECT src, dst, kind, round(CASE WHEN kind = 'contains' THEN weight ELSE least(1.0::DOUBLE, weight * coalesce(mi, 1.0::DOUBLE)) END, 6) AS weight FROM both_ LEFT JOIN mi ON id = dst)
    SELECT src, dst, kind, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn, count(*) OVER (PARTITION BY src) AS n FROM adj) WHERE n <= 12 OR rn <= 10""", "calls", "categories"))  # fmt: skip
def mi_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf).unionByName(categories(spark, sf).where("kind = 'category'"))
    mi = symbols(spark, sf).select(F.col("id").alias("dst"), (0.5 + (F.substring("id", 6, 20).cast("int") % 10) / 20.0).alias("mi"))
    w = F.when(F.col("kind") == "contains", F.col("weight")).otherwise(F.least(F.lit(1.0), F.col("weight") * F.coalesce("mi", F.lit(1.0))))
    adj = e.join(mi, "dst", "left").select("src", "dst", "kind", r6(w).alias("weight"))
    return st.strongest(adj, 10, only_above=12)


@query("flt_10_tau_gate", with_views("SELECT src, dst, weight FROM calls WHERE weight >= 0.5", "calls"))
def tau_gate(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).where("weight >= 0.5").select("src", "dst", "weight")


GATE = "SELECT src, avg(weight) AS mean, stddev_pop(weight) AS dev FROM calls GROUP BY src"


@query("flt_11_adaptive_gate", with_views(f"""SELECT src, dst, round(threshold, 6) AS threshold, weight >= threshold - 1e-9 AS passed FROM calls JOIN
    (SELECT src, mean + (CASE WHEN dev < 0.01 OR mean = 0 THEN 0 ELSE 0.5::DOUBLE * (1 + dev / mean) END) * dev AS threshold FROM ({GATE})) USING (src)""", "calls"))  # fmt: skip
def adaptive_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = st.adaptive_gate(calls(spark, sf), "src", "weight")
    return g.select("src", "dst", r6("threshold").alias("threshold"), (F.col("weight") >= F.col("threshold") - 1e-9).alias("passed"))


@query("flt_12_local_tau", with_views(f"SELECT src, round(greatest(0.05::DOUBLE, mean - dev), 6) AS tau FROM ({GATE})", "calls"))
def local_tau(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy("src").agg(r6(F.greatest(F.lit(0.05), F.avg("weight") - F.stddev_pop("weight"))).alias("tau"))


MODULE = "module AS (SELECT id, regexp_extract(path, '^[^/]+/([^/]+)/', 1) AS module FROM symbols)"
MASS = f"""{MODULE}, calling AS (SELECT c.dst AS id, count(DISTINCT m.module) AS modules FROM calls c JOIN module m ON m.id = c.src GROUP BY 1),
    mass AS (SELECT d.id, in_degree, out_degree, ln(1 + in_degree::DOUBLE) * ln(1 + (SELECT count(DISTINCT module) FROM module) / (coalesce(modules, 0) + 1)::DOUBLE) * (1 + ln(1 + out_degree::DOUBLE)) AS mass FROM degrees d LEFT JOIN calling USING (id))"""


def masses(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.energy import cognitive_mass

    e = calls(spark, sf)
    m = symbols(spark, sf).select("id", F.regexp_extract("path", "^[^/]+/([^/]+)/", 1).alias("module"))
    calling = e.join(m.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("module").alias("modules"))
    every = m.agg(F.count_distinct("module").alias("all_modules"))
    d = st.degrees(e).join(calling, "id", "left").crossJoin(F.broadcast(every))  # of one row
    return d.withColumn("mass", cognitive_mass(F.col("in_degree"), F.col("out_degree"), F.coalesce("modules", F.lit(0)), F.col("all_modules")))


@query("str_11_cognitive_mass", with_views(f"WITH {MASS} SELECT id, round(mass, 6) AS mass FROM mass", "symbols", "degrees"))
def cognitive_mass(spark: SparkSession, sf: str) -> DataFrame:
    return masses(spark, sf).select("id", r6("mass").alias("mass"))


@query("top_01_mass_ranking", with_views(f"WITH {MASS} (SELECT 'top' AS side, id, round(mass, 6) AS mass FROM mass ORDER BY round(mass, 6) DESC, id LIMIT 15) UNION ALL (SELECT 'bottom', id, round(mass, 6) AS mass FROM mass ORDER BY round(mass, 6), id LIMIT 15)", "symbols", "degrees"))
def mass_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m = masses(spark, sf).select("id", r6("mass").alias("mass"))
    side = lambda name, by: m.orderBy(by, "id").limit(15).select(F.lit(name).alias("side"), "id", "mass")
    return side("top", F.desc("mass")).unionByName(side("bottom", F.asc("mass")))


@query("flt_14_mass_range", with_views(f"WITH {MASS} SELECT id, in_degree, out_degree FROM mass WHERE mass BETWEEN 3 AND 6 AND in_degree >= 3", "symbols", "degrees"))
def mass_range(spark: SparkSession, sf: str) -> DataFrame:
    return masses(spark, sf).where("mass between 3 and 6 and in_degree >= 3").select("id", "in_degree", "out_degree")


@query("agg_17_index_stats", with_views(f"WITH {MASS} SELECT count(*) AS n, round(avg(mass), 6) AS avg_mass, round(min(mass), 6) AS min_mass, round(max(mass), 6) AS max_mass, round(avg(in_degree), 6) AS avg_in, round(avg(out_degree), 6) AS avg_out FROM mass", "symbols", "degrees"))
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = masses(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mass")).alias("avg_mass"), r6(F.min("mass")).alias("min_mass"), r6(F.max("mass")).alias("max_mass"), r6(F.avg("in_degree")).alias("avg_in"), r6(F.avg("out_degree")).alias("avg_out"))


@query("str_12_structural_metrics", with_views("""SELECT id, round(1 / (1 + exp(-in_degree / 10.0::DOUBLE)), 6) AS gravity, round(least(1, (in_degree + out_degree) / (2.0::DOUBLE * (SELECT max(in_degree + out_degree) FROM degrees))), 6) AS mass,
    round(tanh(complexity / 10.0::DOUBLE), 6) AS friction FROM degrees JOIN symbols USING (id)""", "degrees", "symbols"))  # fmt: skip
def structural_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import energy

    d = st.degrees(calls(spark, sf)).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    d = st.with_maximum(d, "degree").join(symbols(spark, sf).select("id", "complexity"), "id")
    return d.select("id", r6(energy.gravity(F.col("in_degree"))).alias("gravity"), r6(energy.structural_mass(F.col("degree"), F.col("max_degree"))).alias("mass"), r6(energy.structural_friction(F.col("complexity"))).alias("friction"))


@query("agg_19_weighted_stats", with_views("SELECT count(*) AS edges, round(avg(weight), 6) AS avg_weight, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight, count(DISTINCT src) AS sources FROM calls", "calls"))
def weighted_stats(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).agg(F.count(F.lit(1)).alias("edges"), r6(F.avg("weight")).alias("avg_weight"), r6(F.min("weight")).alias("min_weight"), r6(F.max("weight")).alias("max_weight"), F.count_distinct("src").alias("sources"))


@query("set_01_union_endpoints", with_views("SELECT id, count(*) AS n FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) GROUP BY id", "calls"))
def union_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    return e.select(F.col("src").alias("id")).unionAll(e.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_common_successors", with_views("""WITH one AS (SELECT dst FROM calls WHERE src = 'sym::1'), two AS (SELECT dst FROM calls WHERE src IN ('sym::1', 'sym::2', 'sym::3'))
    SELECT 'both' AS part, dst FROM (SELECT dst FROM one INTERSECT SELECT dst FROM two) UNION ALL SELECT 'only', dst FROM (SELECT dst FROM two EXCEPT SELECT dst FROM one)""", "calls"))  # fmt: skip
def common(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    one, two = e.where("src = 'sym::1'").select("dst"), e.where("src in ('sym::1', 'sym::2', 'sym::3')").select("dst")
    return one.intersect(two).select(F.lit("both").alias("part"), "dst").unionByName(two.subtract(one).select(F.lit("only").alias("part"), "dst"))


@query("set_04_node_universe", with_views("SELECT src AS id FROM calls UNION SELECT dst FROM calls", "calls"))
def universe(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query("set_05_subgraph", with_views("SELECT src, dst, weight FROM calls WHERE src IN (SELECT id FROM symbols WHERE kind = 'class') AND dst IN (SELECT id FROM symbols WHERE kind = 'class')", "calls", "symbols"))
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return st.subgraph(calls(spark, sf), symbols(spark, sf).where("kind = 'class'")).select("src", "dst", "weight")


@query("set_06_tag_union", with_views("SELECT path, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM symbols GROUP BY path", "symbols"))
def tag_union(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("path", F.explode("tags").alias("t")).groupBy("path").agg(F.array_sort(F.collect_set("t")).alias("tags"))


@query("set_08_graph_diff", with_views("""WITH a AS (SELECT src, dst FROM calls), b AS (SELECT dst AS src, src AS dst FROM calls)
    SELECT 'removed' AS change, src, dst FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'added', src, dst FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""", "calls"))  # fmt: skip
def graph_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = calls(spark, sf).select("src", "dst")
    b = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return a.exceptAll(b).select(F.lit("removed").alias("change"), "src", "dst").unionByName(b.exceptAll(a).select(F.lit("added").alias("change"), "src", "dst"))


@query("src_08_neighbours", with_views("""(SELECT 'out' AS side, dst AS other, weight FROM calls WHERE src = 'sym::5') UNION ALL (SELECT 'in', src, weight FROM calls WHERE dst = 'sym::5')""", "calls"))
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    return e.where("src = 'sym::5'").select(F.lit("out").alias("side"), F.col("dst").alias("other"), "weight").unionByName(e.where("dst = 'sym::5'").select(F.lit("in").alias("side"), F.col("src").alias("other"), "weight"))


@query("src_06_weighted_scan", with_views("SELECT src, dst, weight FROM categories WHERE weight > 0", "categories"))
def weighted_scan(spark: SparkSession, sf: str) -> DataFrame:
    return categories(spark, sf).where("weight > 0").select("src", "dst", "weight")


@query("src_07_friction_scan", with_views(f"""WITH {TRI}, {CURV} SELECT c.src, c.dst, round(c.weight / CASE WHEN k.norm IS NULL THEN 1.0::DOUBLE ELSE exp(least(5, -0.5::DOUBLE * k.norm)) END, 6) AS weight
    FROM (SELECT src, dst, weight FROM calls UNION ALL SELECT src, dst, weight FROM categories) c LEFT JOIN curv k ON k.u = c.src AND k.v = c.dst""", "calls", "degrees", "categories"))  # fmt: skip
def friction_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    k = st.curvature(e).select(F.col("u").alias("src"), F.col("v").alias("dst"), st.friction(F.col("norm")).alias("f"))
    both = e.unionByName(categories(spark, sf)).join(k, ["src", "dst"], "left")
    return both.select("src", "dst", r6(F.col("weight") / F.coalesce("f", F.lit(1.0))).alias("weight"))


@query("grb_02_category_nodes", with_views("SELECT 'cat::' || tag AS id, count(*) AS symbols FROM (SELECT unnest(tags) AS tag FROM symbols) GROUP BY tag", "symbols"))
def category_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select(F.explode("tags").alias("tag")).groupBy(F.concat(F.lit("cat::"), "tag").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))


@query("grb_03_category_edges", with_views("SELECT src, dst, kind, weight FROM categories", "categories"))
def category_edges(spark: SparkSession, sf: str) -> DataFrame:
    return categories(spark, sf)


@query("grb_05_containment", with_views("SELECT src, dst, weight FROM contains", "contains"))
def containment(spark: SparkSession, sf: str) -> DataFrame:
    return contains(spark, sf).select("src", "dst", "weight")


@query("grb_10_adjacency", with_views("SELECT src AS id, list_sort(list(dst)) AS out_ids FROM calls GROUP BY src", "calls"))
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("out_ids"))


@query("grb_12_asymmetric_weights", with_views("""SELECT src, dst, CASE WHEN a.kind = 'class' AND b.kind = 'method' THEN 0.9 WHEN a.kind = 'class' AND b.kind = 'class' THEN 0.85
    WHEN list_has_any(b.tags, ['economy', 'small']) THEN 0.3 ELSE 0.5 END::DOUBLE AS forward, CASE WHEN a.kind = 'class' AND b.kind = 'method' THEN 'composition' WHEN a.kind = 'class' AND b.kind = 'class' THEN 'inheritance'
    WHEN list_has_any(b.tags, ['economy', 'small']) THEN 'utility' ELSE 'dependency' END AS edge_class FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst""", "calls", "symbols"))  # fmt: skip
def asymmetric(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.roles import edge_class

    s = symbols(spark, sf).select("id", "kind", "tags")
    e = calls(spark, sf).select("src", "dst").join(s.withColumnsRenamed({"id": "src", "kind": "ka", "tags": "ta"}), "src").join(s.withColumnsRenamed({"id": "dst", "kind": "kb", "tags": "tb"}), "dst")
    cls, weight = edge_class(F.col("ka"), F.col("kb"), F.arrays_overlap("tb", F.array(F.lit("economy"), F.lit("small"))))
    return e.select("src", "dst", weight.alias("forward"), cls.alias("edge_class"))


@query("agg_27_edge_classes", with_views("SELECT kind, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT kind, weight FROM calls UNION ALL SELECT kind, weight FROM categories UNION ALL SELECT kind, weight FROM contains) GROUP BY kind", "calls", "categories", "contains"))
def edge_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf).unionByName(categories(spark, sf)).unionByName(contains(spark, sf))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("weight"))


@query("dm_06_edge_audit", with_views("SELECT kind, count(*) FILTER (weight > 0 AND weight <= 1) AS valid, count(*) FILTER (NOT (weight > 0 AND weight <= 1)) AS invalid FROM (SELECT kind, weight FROM calls UNION ALL SELECT kind, weight FROM contains) GROUP BY kind", "calls", "contains"))
def edge_audit(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf).unionByName(contains(spark, sf))
    ok = (F.col("weight") > 0) & (F.col("weight") <= 1)
    return e.groupBy("kind").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("top_07_list_symbols", with_views("SELECT id, name, kind FROM symbols ORDER BY id LIMIT 50", "symbols"))
def list_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", "name", "kind").orderBy("id").limit(50)


@query("agg_31_workspace_stats", with_views("SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT src) FROM categories WHERE src LIKE 'cat::%') AS categories, (SELECT count(*) FROM calls) + (SELECT count(*) FROM categories) AS edges", "symbols", "calls", "categories"))
def workspace_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = categories(spark, sf)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    edges = calls(spark, sf).unionByName(c)
    return n(symbols(spark, sf), "symbols").crossJoin(n(c.where("src like 'cat::%'").select("src").distinct(), "categories")).crossJoin(n(edges, "edges"))  # one row each


@query("joi_04_symbols_files", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 400000")
def joined(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    o = o.where("o_totalprice > 400000")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("joi_06_either_end", with_views("SELECT DISTINCT src, dst, weight FROM calls WHERE src IN (SELECT id FROM symbols WHERE intent = 'test') OR dst IN (SELECT id FROM symbols WHERE intent = 'test')", "calls", "symbols"))
def either_end(spark: SparkSession, sf: str) -> DataFrame:
    e, t = calls(spark, sf).select("src", "dst", "weight"), symbols(spark, sf).where("intent = 'test'").select("id")
    return e.join(t.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(e.join(t.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()


@query("joi_10_region_pairs", with_views("""SELECT a.kind AS kind_a, b.kind AS kind_b, count(*) AS edges, round(sum(weight), 6) AS weight FROM calls JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.kind <> b.kind GROUP BY 1, 2""", "calls", "symbols"))
def region_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf).select("id", "kind")
    e = calls(spark, sf).select("src", "dst", "weight").join(s.withColumnsRenamed({"id": "src", "kind": "kind_a"}), "src").join(s.withColumnsRenamed({"id": "dst", "kind": "kind_b"}), "dst")
    return e.where("kind_a != kind_b").groupBy("kind_a", "kind_b").agg(F.count(F.lit(1)).alias("edges"), r6(F.sum("weight")).alias("weight"))


@query("joi_13_calling_modules", with_views(f"WITH {MODULE} SELECT c.dst AS id, count(DISTINCT c.src) AS callers, count(DISTINCT m.module) AS modules FROM calls c JOIN module m ON m.id = c.src GROUP BY 1", "calls", "symbols"))
def calling_modules(spark: SparkSession, sf: str) -> DataFrame:
    m = symbols(spark, sf).select(F.col("id").alias("src"), F.regexp_extract("path", "^[^/]+/([^/]+)/", 1).alias("module"))
    return calls(spark, sf).join(m, "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"), F.count_distinct("module").alias("modules"))


@query("str_10_modules", with_views(f"WITH {MODULE} SELECT module, count(*) AS n FROM module GROUP BY module", "symbols"))
def modules(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).groupBy(F.regexp_extract("path", "^[^/]+/([^/]+)/", 1).alias("module")).agg(F.count(F.lit(1)).alias("n"))


@query("str_01_cycles", with_views("""RECURSIVE WITH e AS (SELECT src, dst FROM calls WHERE weight >= 0.6), r AS (SELECT src AS u, dst AS v FROM e UNION SELECT u, dst FROM r JOIN e ON src = v), m AS (SELECT DISTINCT a.u, a.v FROM r a JOIN r b ON b.u = a.v AND b.v = a.u),
    c AS (SELECT u AS id, least(u, min(v)) AS component FROM m GROUP BY u), g AS (SELECT component, count(*) AS size, bool_or(intent = 'async') AS a, bool_or(intent IN ('database', 'network')) AS d FROM c LEFT JOIN symbols USING (id) GROUP BY component)
    SELECT component, size, CASE WHEN a THEN 'CRITICAL' WHEN d THEN 'HIGH' WHEN size > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g WHERE size > 1""", "calls", "symbols"))
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Components on cycles with their size and risk; in SQL, what reaches each other."""
    e = calls(spark, sf).where("weight >= 0.6")
    parts = st.scc(e).join(symbols(spark, sf).select("id", "intent"), "id", "left")
    g = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.col("intent") == "async").alias("a"), F.bool_or(F.col("intent").isin("database", "network")).alias("d"))
    return g.where("size > 1").select("component", "size", F.when(F.col("a"), "CRITICAL").when(F.col("d"), "HIGH").when(F.col("size") > 3, "MEDIUM").otherwise("LOW").alias("risk"))


@query("win_04_next_class", with_views("SELECT id, path, line, lead(line, 1, 2147483647) OVER (PARTITION BY path ORDER BY line, id) AS next_line FROM symbols WHERE kind = 'class'", "symbols"))
def next_class(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line", "id")
    return symbols(spark, sf).where("kind = 'class'").select("id", "path", "line", F.lead("line", 1, 2147483647).over(w).alias("next_line"))


@query("joi_12_class_methods", with_views("""WITH c AS (SELECT id, regexp_extract(path, '^[^/]+/[^/]+', 0) AS folder, line, lead(line, 1, 2147483647) OVER (PARTITION BY regexp_extract(path, '^[^/]+/[^/]+', 0) ORDER BY line, id) AS stop FROM symbols WHERE kind = 'class')
    SELECT c.id AS src, m.id AS dst, round(0.1::DOUBLE / count(*) OVER (PARTITION BY c.id), 9) AS weight FROM c JOIN symbols m ON m.kind = 'method' AND regexp_extract(m.path, '^[^/]+/[^/]+', 0) = c.folder AND m.line >= c.line AND m.line < c.stop""", "symbols"))  # fmt: skip
def class_methods(spark: SparkSession, sf: str) -> DataFrame:
    """The class before a method in its file: one pass over the file's symbols in order instead of a range join."""
    s = symbols(spark, sf).where("kind in ('class', 'method')").withColumn("folder", F.regexp_extract("path", "^[^/]+/[^/]+", 0))
    w = Window.partitionBy("folder").orderBy("line", F.col("kind") != "class", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = s.withColumn("src", F.last(F.when(F.col("kind") == "class", F.col("id")), ignorenulls=True).over(w)).where("kind = 'method' and src is not null")
    n = own.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return own.select("src", F.col("id").alias("dst")).join(n, "src").select("src", "dst", F.round(F.lit(0.1) / F.col("n"), 9).alias("weight"))
