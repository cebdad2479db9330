"""Roll-ups of states to roles, regions, couplings and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, symbols, table, with_views
from ..functions import roles
from ..operators import regions as rg
from ..operators import structure as st
from ..registry import query, r6, rounded
from ..tables import save
from .graph import ROLE, SCORES

#: States with a topology role, and an energy from centrality and degrees that spreads over the bands.
BASE = f"""base AS (SELECT id, {ROLE} AS role, out_degree, in_degree, round(centrality, 6) AS centrality, round(betweenness, 6) AS betweenness, round(clustering, 6) AS clustering, round(tau_persistence, 6) AS tau,
    round(structural_noise + 1e-9, 6) AS noise, frequency, round(entry_variance + 1e-9, 6) AS entry_variance, round(2.5::DOUBLE + 4 * centrality * (1 - clustering), 6) AS energy FROM (SELECT *, {SCORES} FROM states))"""


def base(spark: SparkSession, sf: str) -> DataFrame:
    s = st.states(calls(spark, sf))
    role, _ = st.topology_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness", "clustering")))
    return save(s.select(
        "id", role.alias("role"), "out_degree", "in_degree", r6("centrality").alias("centrality"), r6("betweenness").alias("betweenness"), r6("clustering").alias("clustering"), r6("tau_persistence").alias("tau"),
        r6(F.col("structural_noise") + 1e-9).alias("noise"), "frequency", r6(F.col("entry_variance") + 1e-9).alias("entry_variance"), r6(2.5 + 4 * F.col("centrality") * (1 - F.col("clustering"))).alias("energy"),
    ))


def region_of(spark: SparkSession, sf: str) -> DataFrame:
    return rg.assign(base(spark, sf))


REGION = f"{BASE}, reg AS (SELECT *, role || '/' || least(3, greatest(0, floor((energy - 2.5::DOUBLE) / 0.9::DOUBLE)))::INT AS region FROM base)"


@query("str_18_region_assignment", with_views(f"WITH {REGION} SELECT id, region FROM reg", "states"))
def assignment(spark: SparkSession, sf: str) -> DataFrame:
    return region_of(spark, sf).select("id", "region")


MERGED = f"""{REGION}, sz AS (SELECT region, count(*) AS n FROM reg GROUP BY region), mer AS (SELECT reg.* EXCLUDE (region), CASE WHEN n < 20 THEN (SELECT region FROM sz ORDER BY n DESC, region LIMIT 1) ELSE region END AS region FROM reg JOIN sz USING (region))"""


@query("str_19_merge_small", with_views(f"WITH {MERGED} SELECT region, count(*) AS n FROM mer GROUP BY region", "states"))
def merged(spark: SparkSession, sf: str) -> DataFrame:
    return rg.merge_small(region_of(spark, sf), 20).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("str_27_inter_region_edges", with_views(f"""WITH {REGION}, x AS (SELECT a.region AS region_a, b.region AS region_b, count(*) AS crossing, sum(weight) AS weight FROM calls JOIN reg a ON a.id = src JOIN reg b ON b.id = dst WHERE a.region <> b.region GROUP BY 1, 2)
    SELECT region_a, region_b, crossing, round(crossing / sum(crossing) OVER (PARTITION BY region_a)::DOUBLE, 3) AS strength FROM x""", "states", "calls"))  # fmt: skip
def inter_region(spark: SparkSession, sf: str) -> DataFrame:
    c = rg.coupling(calls(spark, sf), region_of(spark, sf))
    out = c.groupBy("region_a").agg(F.sum("crossing").alias("all_"))
    return c.join(out, "region_a").select("region_a", "region_b", "crossing", F.round(F.col("crossing") / F.col("all_"), 3).alias("strength"))


@query("str_26_region_coupling", with_views(f"""WITH {REGION}, sz AS (SELECT region, count(*) AS n FROM reg GROUP BY region), x AS (SELECT least(a.region, b.region) AS a, greatest(a.region, b.region) AS b, count(*) AS edges FROM calls JOIN reg a ON a.id = src JOIN reg b ON b.id = dst WHERE a.region <> b.region GROUP BY 1, 2)
    SELECT a, b, edges, round(edges / least(p.n, q.n)::DOUBLE, 5) AS score FROM x JOIN sz p ON p.region = a JOIN sz q ON q.region = b WHERE edges / least(p.n, q.n)::DOUBLE >= 0.05""", "states", "calls"))  # fmt: skip
def region_coupling(spark: SparkSession, sf: str) -> DataFrame:
    r = region_of(spark, sf)
    c = rg.coupling(calls(spark, sf), r).groupBy(F.least("region_a", "region_b").alias("a"), F.greatest("region_a", "region_b").alias("b")).agg(F.sum("crossing").alias("edges"))
    size = r.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(size.withColumnsRenamed({"region": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"region": "b", "n": "nb"}), "b")
    score = F.col("edges") / F.least("na", "nb")
    return c.where(score >= 0.05).select("a", "b", "edges", F.round(score, 5).alias("score"))


@query("agg_11_role_cells", with_views(f"WITH {BASE} SELECT role, count(*) AS n, round(avg(centrality), 5) AS avg_centrality, round(avg(tau), 5) AS avg_stability, sum(frequency)::BIGINT AS frequency FROM base GROUP BY role", "states"))
def role_cells(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("centrality"), 5).alias("avg_centrality"), F.round(F.avg("tau"), 5).alias("avg_stability"), F.sum("frequency").alias("frequency"))


MAPS = f"""{BASE}, maps AS (SELECT role, avg(centrality) * sum(frequency) / count(*) AS density, var_pop(betweenness) * avg(clustering) AS curvature, avg(out_degree * entry_variance / greatest(0.01::DOUBLE, tau)) AS stress, sum(frequency) AS freq FROM base GROUP BY role),
    normed AS (SELECT role, density / max(density) OVER () AS density, CASE WHEN max(curvature) OVER () > 0 THEN curvature / max(curvature) OVER () ELSE curvature END AS curvature, CASE WHEN max(stress) OVER () > 0 THEN stress / max(stress) OVER () ELSE stress END AS stress, freq FROM maps)"""


def field_maps(spark: SparkSession, sf: str) -> DataFrame:
    stress = F.col("out_degree") * F.col("entry_variance") / F.greatest(F.lit(0.01), F.col("tau"))
    g = base(spark, sf).groupBy("role").agg((F.avg("centrality") * F.sum("frequency") / F.count(F.lit(1))).alias("density"), (F.var_pop("betweenness") * F.avg("clustering")).alias("curvature"), F.avg(stress).alias("stress"), F.sum("frequency").alias("freq"))
    g = st.with_maximum(g, "density", "curvature", "stress")
    return g.select("role", "freq", *(F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(F.col(c)).alias(c) for c in ("density", "curvature", "stress")))


@query("agg_12_field_maps", with_views(f"WITH {MAPS} SELECT role, round(density, 5) AS density, round(curvature, 5) AS curvature, round(stress, 5) AS stress FROM normed", "states"))
def maps(spark: SparkSession, sf: str) -> DataFrame:
    return field_maps(spark, sf).select("role", *(F.round(c, 5).alias(c) for c in ("density", "curvature", "stress")))


@query("str_29_hologram", with_views(f"WITH {MAPS} SELECT role, curvature > 0.7 AND density > 0.7 AS folding, density < 0.3 AND freq < 100 AS void, stress > 0.8 AS risk, stress < 0.3 AND density < 0.5 AS safe FROM normed", "states"))
def hologram(spark: SparkSession, sf: str) -> DataFrame:
    d, c, s = (F.col(x) for x in ("density", "curvature", "stress"))
    return field_maps(spark, sf).select("role", ((c > 0.7) & (d > 0.7)).alias("folding"), ((d < 0.3) & (F.col("freq") < 100)).alias("void"), (s > 0.8).alias("risk"), ((s < 0.3) & (d < 0.5)).alias("safe"))


@query("agg_13_health", with_views(f"""WITH {BASE}, g AS (SELECT 1 - avg(clustering) AS fragmentation, avg(tau) AS coherence, avg(entry_variance) AS pressure FROM base)
    SELECT round(fragmentation, 5) AS fragmentation, round(coherence, 5) AS coherence, round(pressure, 5) AS pressure, CASE WHEN coherence - fragmentation - pressure > .5 THEN 'healthy' WHEN coherence - fragmentation - pressure > .2 THEN 'stable' WHEN coherence - fragmentation - pressure > -.2 THEN 'stressed' ELSE 'critical' END AS health FROM g""", "states"))  # fmt: skip
def health(spark: SparkSession, sf: str) -> DataFrame:
    g = base(spark, sf).agg((1 - F.avg("clustering")).alias("fragmentation"), F.avg("tau").alias("coherence"), F.avg("entry_variance").alias("pressure"))
    x = F.col("coherence") - F.col("fragmentation") - F.col("pressure")
    g = g.withColumn("health", F.when(x > 0.5, "healthy").when(x > 0.2, "stable").when(x > -0.2, "stressed").otherwise("critical"))
    return g.select("health", *(F.round(c, 5).alias(c) for c in ("fragmentation", "coherence", "pressure")))


@query("agg_14_energy_distribution", with_views(f"WITH {BASE} SELECT count(*) AS n, round(avg(energy), 5) AS mean, round(stddev_pop(energy), 5) AS dev, round(min(energy), 5) AS low, round(max(energy), 5) AS high, count(*) FILTER (role = 'hub') AS hubs, count(*) FILTER (role = 'leaf') AS leaves FROM base", "states"))
def energy_distribution(spark: SparkSession, sf: str) -> DataFrame:
    five = lambda x: F.round(x, 5)
    return base(spark, sf).agg(F.count(F.lit(1)).alias("n"), five(F.avg("energy")).alias("mean"), five(F.stddev_pop("energy")).alias("dev"), five(F.min("energy")).alias("low"), five(F.max("energy")).alias("high"), F.count_if(F.col("role") == "hub").alias("hubs"), F.count_if(F.col("role") == "leaf").alias("leaves"))


@query("fn_47_region_archetypes", with_views(f"""WITH {REGION}, g AS (SELECT region, count(*) AS n, avg((role = 'hub')::INT) AS h, avg((role = 'sink')::INT) AS s, avg((role = 'bridge')::INT) AS b, avg((role = 'leaf')::INT) AS l, avg(out_degree) AS fan, avg(clustering) AS cohesion FROM reg GROUP BY region)
    SELECT region, CASE WHEN h > .4 THEN 'radiation' WHEN s > .4 THEN 'convergence' WHEN h > .2 AND s > .2 THEN 'transitional' WHEN b > .3 THEN 'chain' WHEN l > .5 THEN 'fanout' ELSE 'transitional' END AS archetype, CASE WHEN fan > 5 THEN 'high' WHEN fan > 2 THEN 'medium' ELSE 'low' END AS fan,
    CASE WHEN cohesion > .5 THEN 'high' WHEN cohesion > .2 THEN 'medium' ELSE 'low' END AS cohesion, CASE WHEN n >= 1000 THEN 'XL' WHEN n >= 500 THEN 'L' WHEN n >= 100 THEN 'M' ELSE 'S' END AS tier FROM g""", "states"))  # fmt: skip
def archetypes(spark: SparkSession, sf: str) -> DataFrame:
    r = base(spark, sf).withColumn("region", F.concat_ws("/", "role", rg.energy_band(F.col("energy")).cast("string")))
    share = lambda x: F.avg((F.col("role") == x).cast("int"))
    g = r.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *(share(x).alias(x) for x in ("hub", "sink", "bridge", "leaf")), F.avg("out_degree").alias("f"), F.avg("clustering").alias("c"))
    return g.select("region", roles.archetype(F.col("hub"), F.col("sink"), F.col("bridge"), F.col("leaf")).alias("archetype"), roles.level(F.col("f"), 5, 2).alias("fan"), roles.level(F.col("c"), 0.5, 0.2).alias("cohesion"), roles.size_tier(F.col("n")).alias("tier"))


def with_region(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return b.withColumn("region", F.concat_ws("/", "role", rg.energy_band(F.col("energy")).cast("string"))).withColumn("attractor", F.col("energy") > 4)


ENTRY = f"""{REGION}, a AS (SELECT region, id, rn FROM (SELECT region, id, row_number() OVER (PARTITION BY region ORDER BY energy DESC, id) AS rn FROM reg WHERE energy > 4) WHERE rn <= 3),
    o AS (SELECT region, id, 100 + row_number() OVER (PARTITION BY region ORDER BY round(centrality * (1 + 0.1::DOUBLE * least(energy, 5)), 9) DESC, id) AS rn FROM reg WHERE id NOT IN (SELECT id FROM a)),
    ent AS (SELECT region, id, row_number() OVER (PARTITION BY region ORDER BY rn)::INT AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM o))"""


@query("top_11_entry_points", with_views(f"WITH {ENTRY} SELECT region, rank, id FROM ent WHERE rank <= 5", "states"))
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return rg.entry_points(with_region(spark, sf))


@query("fn_05_stable_region_ids", with_views(f"""WITH {ENTRY}, e AS (SELECT region, string_agg(id, ',' ORDER BY id) AS ids FROM ent WHERE rank <= 3 GROUP BY region), n AS (SELECT region, count(*) AS n FROM reg GROUP BY region)
    SELECT region, substr(sha256(ids || '|' || region || '|' || CASE WHEN n >= 1000 THEN 'XL' WHEN n >= 500 THEN 'L' WHEN n >= 100 THEN 'M' ELSE 'S' END), 1, 12) AS stable_id FROM e JOIN n USING (region)""", "states"))  # fmt: skip
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = with_region(spark, sf)
    e = rg.entry_points(s).where("rank <= 3").groupBy("region").agg(F.collect_list("id").alias("ids"))
    n = s.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "region").select("region", rg.stable_id(F.col("ids"), F.col("region"), F.col("n")).alias("stable_id"))


@query("str_22_attractor_candidates", with_views(f"""WITH {REGION}, c AS (SELECT region, id, round(greatest(CASE WHEN energy > 5 THEN 3 ELSE 0 END, CASE WHEN in_degree > 0 AND out_degree <= 3 THEN in_degree / (out_degree + 1)::DOUBLE + CASE WHEN role = 'sink' THEN 1 ELSE 0 END ELSE 0 END, CASE WHEN role = 'sink' AND in_degree >= 2 AND energy > 3.5 THEN energy / 2 ELSE 0 END), 5) AS score FROM reg)
    SELECT region, id, score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, id) AS rn FROM c WHERE score > 0) WHERE rn <= 5""", "states"))  # fmt: skip
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = with_region(spark, sf)
    i, o, e, sink = F.col("in_degree"), F.col("out_degree"), F.col("energy"), F.col("role") == "sink"
    zero = F.lit(0.0)
    score = F.greatest(F.when(e > 5, 3.0).otherwise(0.0), F.when((i > 0) & (o <= 3), i / (o + 1) + F.when(sink, 1).otherwise(0)).otherwise(zero), F.when(sink & (i >= 2) & (e > 3.5), e / 2).otherwise(zero))
    s = s.withColumn("score", F.round(score, 5)).where("score > 0")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "id"))).where("rn <= 5").select("region", "id", "score")


@query("top_05_landscape", with_views(f"WITH {BASE} (SELECT 'attractor' AS list, id, energy FROM base ORDER BY centrality DESC, id LIMIT 20) UNION ALL (SELECT 'repeller', id, energy FROM base ORDER BY centrality, id LIMIT 20) UNION ALL (SELECT 'saddle', id, energy FROM base ORDER BY energy DESC, id LIMIT 20)", "states"))
def landscape(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    top = lambda name, by: b.orderBy(by, "id").limit(20).select(F.lit(name).alias("list"), "id", "energy")
    return top("attractor", F.desc("centrality")).unionByName(top("repeller", F.asc("centrality"))).unionByName(top("saddle", F.desc("energy")))


@query("top_06_type_aware", with_views(f"""WITH {BASE}, n AS (SELECT src, dst, round(CASE WHEN s.kind = 'class' THEN b.energy ELSE c.weight * (1 + b.energy) END, 5) AS score FROM calls c JOIN symbols s ON s.id = c.src JOIN base b ON b.id = c.dst)
    SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM n) WHERE rn <= 2""", "states", "calls", "symbols"))  # fmt: skip
def type_aware(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf).join(symbols(spark, sf).select(F.col("id").alias("src"), F.col("kind").alias("k")), "src").join(base(spark, sf).select(F.col("id").alias("dst"), "energy"), "dst")
    e = e.withColumn("score", F.round(F.when(F.col("k") == "class", F.col("energy")).otherwise(F.col("weight") * (1 + F.col("energy"))), 5))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where("rn <= 2").select("src", "dst", "score")


@query("top_09_landscape_summary", with_views(f"WITH {REGION} SELECT region, count(*) AS size, round(max(energy), 5) AS peak, min(id) AS first FROM reg GROUP BY region ORDER BY size DESC, region LIMIT 20", "states"))
def summary(spark: SparkSession, sf: str) -> DataFrame:
    g = region_of(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.round(F.max("energy"), 5).alias("peak"), F.min("id").alias("first"))
    return g.orderBy(F.desc("size"), "region").limit(20)


@query("str_25_dominant_cluster", with_views(f"""WITH {REGION}, n AS (SELECT region, intent, count(*) AS n FROM reg JOIN symbols USING (id) GROUP BY 1, 2)
    SELECT region, intent, round(n / total::DOUBLE, 5) AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY region) AS total, row_number() OVER (PARTITION BY region ORDER BY n DESC, intent) AS rn FROM n) WHERE rn = 1""", "states", "symbols"))  # fmt: skip
def dominant(spark: SparkSession, sf: str) -> DataFrame:
    m = region_of(spark, sf).join(symbols(spark, sf).select("id", "intent"), "id")
    d = rg.dominant(m, "region", "intent")
    return d.select("region", "intent", F.round("purity", 5).alias("purity"))


@query("joi_09_shared_targets", with_views("SELECT a.src AS a, b.src AS b, count(*) AS shared FROM calls a JOIN calls b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2", "calls"))
def shared(spark: SparkSession, sf: str) -> DataFrame:
    return rg.shared_targets(calls(spark, sf).select(F.col("src").alias("start"), F.col("dst").alias("node")))


def _label_rounds(n: int) -> str:
    """The rounds of label propagation, one after the other."""
    rounds = "".join(
        f""", r{k + 1} AS MATERIALIZED (SELECT id, arg_min(c, (-round(w, 9), c)) AS c FROM (SELECT b.src AS id, r.c, sum(b.weight) AS w FROM b JOIN r{k} r ON r.id = b.dst GROUP BY 1, 2) GROUP BY id)"""
        for k in range(n)
    )
    return f"b AS MATERIALIZED (SELECT src, dst, weight FROM calls UNION ALL SELECT dst, src, weight FROM calls), r0 AS (SELECT DISTINCT src AS id, src AS c FROM b){rounds}"


@query("str_24_communities", with_views(f"WITH {_label_rounds(5)} SELECT c AS community, count(*) AS size FROM r5 GROUP BY c", "calls"))
def communities(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of communities after five rounds of label propagation."""
    c = rg.communities(calls(spark, sf), 5)
    return c.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


@query("str_28_region_document", with_views(f"WITH {REGION} SELECT region, count(*) AS size, round(avg(energy), 5) AS energy, list_sort(list(id))[1:5] AS first_members FROM reg GROUP BY region", "states"))
def document(spark: SparkSession, sf: str) -> DataFrame:
    r = region_of(spark, sf)
    first = r.withColumn("rn", F.row_number().over(Window.partitionBy("region").orderBy("id"))).where("rn <= 5").groupBy("region").agg(F.array_sort(F.collect_list("id")).alias("first_members"))
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("energy"), 5).alias("energy")).join(first, "region")


COG = "role = 'hub' AND centrality > .7"


@query("fn_44_cognitive_roles", with_views(f"""WITH {BASE} SELECT id, CASE WHEN role = 'hub' AND centrality > .7 THEN 'query_anchor' WHEN role = 'bridge' AND betweenness > .5 THEN 'system_critical_connector' WHEN role = 'sink' THEN 'data_aggregation_point' WHEN role = 'leaf' AND centrality < .3 THEN 'safe_to_ignore' ELSE 'moderate_importance' END AS cognitive_role,
    CASE WHEN tau > .8 AND noise < .2 THEN 'core_invariant' WHEN tau > .5 AND noise < .5 THEN 'stable' ELSE 'volatile' END AS stability, CASE WHEN centrality > .7 OR betweenness > .7 THEN 'high' WHEN centrality > .4 OR betweenness > .4 THEN 'medium' ELSE 'low' END AS impact, round(least(1, (noise + entry_variance) / 2), 5) AS sensitivity FROM base""", "states"))  # fmt: skip
def cognitive(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    c, bt = F.col("centrality"), F.col("betweenness")
    return b.select("id", roles.cognitive_role(F.col("role"), c, bt)[0].alias("cognitive_role"), roles.stability(F.col("tau"), F.col("noise"))[0].alias("stability"), roles.impact(c, bt).alias("impact"), F.round(F.least(F.lit(1.0), (F.col("noise") + F.col("entry_variance")) / 2), 5).alias("sensitivity"))


@query("fn_45_affordances", with_views(f"""WITH {BASE} SELECT id, list_filter([CASE WHEN role = 'hub' AND centrality > .7 AND frequency > 100 THEN 'entry_point' END, CASE WHEN betweenness > .6 AND tau > .7 THEN 'debug_anchor' END, CASE WHEN role = 'hub' AND out_degree >= 2 THEN 'workflow_orchestrator' END,
    CASE WHEN role = 'leaf' AND tau > .7 AND centrality < .3 THEN 'safe_refactor' END, CASE WHEN role = 'sink' AND centrality > .4 THEN 'data_transformer' END, CASE WHEN role = 'bridge' AND betweenness > .7 THEN 'critical_bridge' END], lambda x: x IS NOT NULL) AS affordances FROM base""", "states"))  # fmt: skip
def affordances(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return b.select("id", roles.affordances(*(F.col(c) for c in ("role", "centrality", "betweenness", "tau", "frequency", "out_degree"))).alias("affordances"))


@query("fn_46_context_text", with_views(f"WITH {BASE} SELECT id, format('{{}} is a {{}} with {{}} callers and {{}} callees', id, role, in_degree, out_degree) AS summary FROM base", "states"))
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("id", F.format_string("%s is a %s with %d callers and %d callees", "id", "role", "in_degree", "out_degree").alias("summary"))


@query("str_31_empty_cells", "WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM p), c AS (SELECT least(9, floor((x - x0) / (x1 - x0) * 10))::INT AS x, least(9, floor((y - y0) / (y1 - y0) * 10))::INT AS y, count(*) AS n FROM p, m GROUP BY 1, 2), g AS (SELECT (i % 10)::INT AS x, (i // 10)::INT AS y FROM range(100) t(i)) SELECT g.x, g.y, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.x = g.x AND c.y = g.y, m WHERE coalesce(c.n, 0) < 0.1 * m.n / 100")
def empty_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return rg.empty_cells(e.select(F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y")))


@query("top_04_symbols_before_categories", with_views("SELECT id, weight FROM (SELECT src AS id, sum(weight)::DOUBLE AS weight, src LIKE 'cat::%' AS c FROM categories GROUP BY src) ORDER BY c, round(weight, 6) DESC, id LIMIT 30", "categories").replace("SELECT id, weight FROM", "SELECT id, round(weight, 6) AS weight FROM"))
def padded(spark: SparkSession, sf: str) -> DataFrame:
    from ..bindings import categories

    g = categories(spark, sf).groupBy(F.col("src").alias("id")).agg(r6(F.sum("weight")).alias("weight"))
    return g.orderBy(F.col("id").startswith("cat::"), F.desc("weight"), "id").limit(30)
