"""Traversal, propagation and path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, contains, symbols, with_views
from ..functions import energy, roles
from ..operators import structure as st
from ..plans import propagation as pg
from ..plans import traversal as tv
from ..registry import query, r6
from ..tables import save

TAU, DEPTH = 0.05, 3


def starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def everything(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = calls(spark, sf)
    return tv.bfs(e, e.select(F.col("src").alias("id")), DEPTH, tau=TAU)


LEVELS = """v0 AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM calls),
    e1 AS (SELECT v.start, c.src, c.dst, c.weight, 1 AS depth FROM v0 v JOIN calls c ON c.src = v.node WHERE c.weight >= 0.05),
    v1 AS (SELECT DISTINCT start, dst AS node, 1 AS depth FROM e1 WHERE (start, dst) NOT IN (SELECT start, node FROM v0)),
    e2 AS (SELECT v.start, c.src, c.dst, c.weight, 2 AS depth FROM v1 v JOIN calls c ON c.src = v.node WHERE c.weight >= 0.05),
    v2 AS (SELECT DISTINCT e.start, e.dst AS node, 2 AS depth FROM e2 e WHERE NOT EXISTS (SELECT 1 FROM v0 x WHERE x.start = e.start AND x.node = e.dst) AND NOT EXISTS (SELECT 1 FROM v1 x WHERE x.start = e.start AND x.node = e.dst)),
    e3 AS (SELECT v.start, c.src, c.dst, c.weight, 3 AS depth FROM v2 v JOIN calls c ON c.src = v.node WHERE c.weight >= 0.05),
    v3 AS (SELECT DISTINCT e.start, e.dst AS node, 3 AS depth FROM e3 e WHERE NOT EXISTS (SELECT 1 FROM v0 x WHERE x.start = e.start AND x.node = e.dst) AND NOT EXISTS (SELECT 1 FROM v1 x WHERE x.start = e.start AND x.node = e.dst)
        AND NOT EXISTS (SELECT 1 FROM v2 x WHERE x.start = e.start AND x.node = e.dst)),
    visits AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3),
    seen AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)"""
LEVELS = LEVELS.replace("WHERE (start, dst) NOT IN (SELECT start, node FROM v0)", "e WHERE NOT EXISTS (SELECT 1 FROM v0 x WHERE x.start = e.start AND x.node = e.dst)")


@query("trv_01_bfs_visits", with_views(f"WITH {LEVELS} SELECT start, node, depth FROM visits", "calls"))
def bfs_visits(spark: SparkSession, sf: str) -> DataFrame:
    return everything(spark, sf)[0]


@query("trv_01_bfs_edge_events", with_views(f"WITH {LEVELS} SELECT depth, src, dst, count(*) AS events FROM seen GROUP BY ALL", "calls"))
def bfs_events(spark: SparkSession, sf: str) -> DataFrame:
    return everything(spark, sf)[1].groupBy("depth", "src", "dst").agg(F.count(F.lit(1)).alias("events"))


@query("trv_03_event_totals", with_views(f"""WITH {LEVELS} SELECT 'NODE_VISIT' AS event_type, depth, count(*) AS n, NULL::DOUBLE AS weight FROM visits GROUP BY depth
    UNION ALL SELECT 'EDGE_TRAVERSE', depth, count(*), round(sum(weight), 4) FROM seen GROUP BY depth UNION ALL SELECT 'QUERY_METADATA', depth, count(*), round(sum(n), 4) FROM (SELECT start, count(*)::DOUBLE AS n, max(depth) AS depth FROM visits GROUP BY start) GROUP BY depth""", "calls"))  # fmt: skip
def event_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = tv.build_events(*everything(spark, sf))
    return e.groupBy("event_type", "depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("trv_02_bfs_with_rejected", with_views("""WITH v0 AS (SELECT DISTINCT src AS start, src AS node FROM calls),
    e1 AS (SELECT v.start, c.src, c.dst, c.weight >= 0.5 AS ok FROM v0 v JOIN calls c ON c.src = v.node), v1 AS (SELECT DISTINCT start, dst AS node FROM e1 WHERE ok AND start <> dst),
    e2 AS (SELECT v.start, c.src, c.dst, c.weight >= 0.5 AS ok FROM v1 v JOIN calls c ON c.src = v.node)
    SELECT 1 AS depth, ok AS passed_gate, count(*) AS n FROM e1 GROUP BY ok UNION ALL SELECT 2, ok, count(*) FROM e2 GROUP BY ok""", "calls"))  # fmt: skip
def rejected(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    _, events = tv.bfs(e, e.select(F.col("src").alias("id")), 1, tau=0.5, log_rejected=True)
    return events.groupBy("depth", "passed_gate").agg(F.count(F.lit(1)).alias("n"))


@query("agg_01_edge_aggregate", with_views(f"WITH {LEVELS} SELECT src, dst, round(sum(weight), 4) AS weight FROM seen GROUP BY src, dst", "calls"))
def edge_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return everything(spark, sf)[1].groupBy("src", "dst").agg(F.round(F.sum("weight"), 4).alias("weight"))


@query("agg_02_visit_frequency", with_views(f"WITH {LEVELS} SELECT node, count(*) AS frequency, min(depth) AS nearest, max(depth) AS farthest FROM visits GROUP BY node", "calls"))
def visit_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return everything(spark, sf)[0].groupBy("node").agg(F.count(F.lit(1)).alias("frequency"), F.min("depth").alias("nearest"), F.max("depth").alias("farthest"))


@query("agg_04_tau_persistence", with_views(f"""WITH {LEVELS.replace("c.weight >= 0.05", "TRUE")}, per_edge AS (SELECT src, dst, avg((weight >= 0.5)::INT) AS rate FROM seen GROUP BY src, dst)
    SELECT src, round(avg(rate), 6) AS tau_persistence FROM per_edge GROUP BY src""", "calls"))  # fmt: skip
def tau_persistence(spark: SparkSession, sf: str) -> DataFrame:
    _, events = everything(spark, sf)
    per_edge = events.groupBy("src", "dst").agg(F.avg((F.col("weight") >= 0.5).cast("int")).alias("rate"))
    return per_edge.groupBy("src").agg(r6(F.avg("rate")).alias("tau_persistence"))


TREE = """RECURSIVE down AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM down JOIN contains ON src = node)"""


@query("trv_06_dependents", with_views("WITH RECURSIVE down AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM down JOIN contains ON src = node) SELECT node, depth FROM down", "contains").replace("WITH contains", "WITH RECURSIVE contains").replace(", RECURSIVE down", ", down"))
def dependents(spark: SparkSession, sf: str) -> DataFrame:
    e = save(contains(spark, sf))
    return tv.bfs(e, starts(spark, "r1"), 4)[0].select("node", "depth")


@query("trv_06_dependencies", with_views("""WITH u0 AS (SELECT dst AS start, dst AS node, 0 AS depth FROM contains ), u1 AS (SELECT start, src AS node, 1 AS depth FROM u0 JOIN contains ON dst = node),
    u2 AS (SELECT start, src AS node, 2 AS depth FROM u1 JOIN contains ON dst = node), u3 AS (SELECT start, src AS node, 3 AS depth FROM u2 JOIN contains ON dst = node)
    SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3""", "contains"))  # fmt: skip
def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    e = save(contains(spark, sf))
    return tv.bfs(tv.reverse(e), e.select(F.col("dst").alias("id")), 4)[0]


@query("trv_04_both_directions", with_views("""WITH b AS (SELECT src, dst FROM contains UNION ALL SELECT dst, src FROM contains), d1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'n5'),
    d2 AS (SELECT DISTINCT b.dst AS node FROM d1 JOIN b ON b.src = d1.node WHERE b.dst <> 'n5' AND b.dst NOT IN (SELECT node FROM d1))
    SELECT 'n5' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""", "contains"))  # fmt: skip
def both(spark: SparkSession, sf: str) -> DataFrame:
    e = save(contains(spark, sf))
    return tv.bfs(tv.both_ways(e), starts(spark, "n5"), 2)[0].select("node", "depth")


@query("trv_05_shortest_path", with_views("""WITH up AS (SELECT 'o7' AS o, a.src AS c, b.src AS n, d.src AS r FROM contains a JOIN contains b ON b.dst = a.src JOIN contains d ON d.dst = b.src WHERE a.dst = 'o7')
    SELECT 0 AS pos, o AS node FROM up UNION ALL SELECT 1, c FROM up UNION ALL SELECT 2, n FROM up UNION ALL SELECT 3, r FROM up""", "contains"))  # fmt: skip
def path(spark: SparkSession, sf: str) -> DataFrame:
    e = save(tv.both_ways(contains(spark, sf)))
    top = contains(spark, sf)
    up = top.where("dst = 'o7'").select(F.col("src").alias("c")).join(top.withColumnsRenamed({"dst": "c", "src": "n"}).select("c", "n"), "c").join(top.withColumnsRenamed({"dst": "n", "src": "r"}).select("n", "r"), "n").first()
    return tv.shortest_path(e, "o7", up.r if up else "r0")


HARD = """best(node, weight) USING KEY (node) AS (SELECT 'sym::1', 1.0::DOUBLE UNION
    SELECT dst, max(w) FROM (SELECT c.dst, b.weight * c.weight AS w FROM best b JOIN calls c ON b.node = c.src) n LEFT JOIN recurring.best r ON r.node = n.dst
    WHERE w >= 0.2 AND (r.weight IS NULL OR w > r.weight + 1e-12) GROUP BY dst)"""


def recursive(body: str, *views: str) -> str:
    return with_views(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)


@query("trv_08_propagate", recursive(f"WITH {HARD} SELECT node, round(weight, 6) AS weight FROM best", "calls"))
def propagate(spark: SparkSession, sf: str) -> DataFrame:
    r = pg.propagate(calls(spark, sf), starts(spark, "sym::1"), tau=0.2, soft=False)
    return r.select("node", r6("weight").alias("weight"))


SOFT = """best(node, weight, k) USING KEY (node) AS (SELECT 'sym::1', 1.0::DOUBLE, 0 UNION
    SELECT dst, max(w), max(n.k) + 1 FROM (SELECT c.dst, CASE WHEN b.weight * c.weight < 0.05 THEN b.weight * c.weight * 0.5::DOUBLE ELSE b.weight * c.weight END AS w, b.k FROM best b JOIN calls c ON b.node = c.src WHERE b.k < 6) n
    LEFT JOIN recurring.best r ON r.node = n.dst WHERE r.weight IS NULL OR w > r.weight + 1e-12 GROUP BY dst)"""


@query("trv_08_propagate_soft", recursive(f"WITH {SOFT} SELECT node, round(weight, 6) AS weight, (SELECT max(k) FROM best) < 6 AS converged FROM best", "calls"))
def propagate_soft(spark: SparkSession, sf: str) -> DataFrame:
    """Soft tau halves a weight under it and drops nothing; six rounds."""
    r = pg.propagate(calls(spark, sf), starts(spark, "sym::1"), tau=0.05, soft=True, rounds=6)
    return r.select("node", r6("weight").alias("weight"), "converged")


@query("top_03_propagate_topk", recursive(f"WITH {HARD} SELECT node, round(weight, 6) AS weight FROM best ORDER BY round(weight, 6) DESC, node LIMIT 25", "calls"))
def propagate_topk(spark: SparkSession, sf: str) -> DataFrame:
    r = pg.propagate(calls(spark, sf), starts(spark, "sym::1"), tau=0.2, soft=False)
    return r.select("node", r6("weight").alias("weight")).orderBy(F.desc("weight"), "node").limit(25)


@query("agg_28_query_metrics", recursive(f"WITH {HARD} SELECT count(*) AS subgraph_size, round(avg(weight), 6) AS avg_weight, round(min(weight), 6) AS min_weight FROM best", "calls"))
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = pg.propagate(calls(spark, sf), starts(spark, "sym::1"), tau=0.2, soft=False)
    return r.agg(F.count(F.lit(1)).alias("subgraph_size"), r6(F.avg("weight")).alias("avg_weight"), r6(F.min("weight")).alias("min_weight"))


@query("trv_12_paths", recursive(f"WITH {HARD} SELECT node, round(weight, 6) AS weight FROM best", "calls"))
def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path's product of weights is the weight that propagation found."""
    e = calls(spark, sf)
    p = pg.paths(pg.propagate(e, starts(spark, "sym::1"), tau=0.2, soft=False))
    steps = p.select("node", F.explode(F.zip_with("path", F.slice("path", 2, 1000), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("s")).select("node", "s.src", "s.dst").where("dst is not null")
    product = steps.join(e, ["src", "dst"]).groupBy("node").agg(F.product("weight").alias("weight"))
    return p.select("node").join(product, "node", "left").select("node", r6(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def _tier(tau: float) -> str:
    return HARD.replace("best", f"best{int(tau * 100)}").replace("0.2", str(tau))


@query("trv_14_tiers", recursive(f"WITH {_tier(0.3)}, {_tier(0.25)} SELECT 'core' AS tier, node, round(weight, 6) AS weight FROM best30 UNION ALL SELECT 'extended', node, round(weight, 6) FROM best25", "calls"))
def tier(spark: SparkSession, sf: str) -> DataFrame:
    r = pg.tiers(calls(spark, sf), starts(spark, "sym::1"), {"core": 0.3, "extended": 0.25})
    return r.select("tier", "node", r6("weight").alias("weight"))


@query("trv_16_reverse_traversal", with_views("""WITH g AS (SELECT id, 1 / (1 + exp(-in_degree / 10.0::DOUBLE)) AS gravity FROM degrees), top AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS rn FROM calls) WHERE rn <= 10),
    l1 AS (SELECT DISTINCT t.src AS node FROM top t JOIN g ON g.id = 'sym::1' WHERE t.dst = 'sym::1' AND gravity >= 0.55 AND t.src <> 'sym::1'),
    l2 AS (SELECT DISTINCT t.src AS node FROM top t JOIN l1 ON l1.node = t.dst JOIN g ON g.id = l1.node WHERE gravity >= 0.55 AND t.src <> 'sym::1' AND t.src NOT IN (SELECT node FROM l1))
    SELECT node, depth, round(gravity * 0.5::DOUBLE * 0.9::DOUBLE, 6) AS escape FROM (SELECT 'sym::1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2) JOIN g ON g.id = node""", "calls", "degrees"))  # fmt: skip
def reverse_traversal(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    d = save(st.degrees(e).select("id", energy.gravity(F.col("in_degree")).alias("gravity")))
    back = st.strongest(tv.reverse(e), 10).join(d.withColumnRenamed("id", "src"), "src").where("gravity >= 0.55").select("src", "dst", "kind", "weight")
    visits, _ = tv.bfs(save(back), starts(spark, "sym::1"), 2)
    return visits.join(d.withColumnRenamed("id", "node"), "node").select("node", "depth", r6(energy.escape_probability(F.col("gravity"), F.lit(0.5), F.lit(0.1))).alias("escape"))


@query("trv_20_upstream", with_views("""WITH d1 AS (SELECT dst AS start, src AS node, max(weight) AS weight FROM calls WHERE dst IN ('sym::1', 'sym::2', 'sym::3') AND src <> dst GROUP BY 1, 2),
    d2 AS (SELECT d1.start, c.src AS node, max(c.weight) AS weight FROM d1 JOIN calls c ON c.dst = d1.node WHERE c.src <> d1.start GROUP BY 1, 2),
    both_ AS (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2 WHERE NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d2.start AND x.node = d2.node)),
    scored AS (SELECT start, node, depth, round(b.weight * f.centrality * pow(0.5, depth), 6) AS score FROM both_ b JOIN features f ON f.id = b.node)
    SELECT start, node, depth, score FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, node) AS rn FROM scored) WHERE rn <= 10""", "calls", "features"))  # fmt: skip
def upstream(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    f = st.features(e).select("id", F.col("centrality").alias("magnitude"))
    u = tv.upstream(e, starts(spark, "sym::1", "sym::2", "sym::3"), f, k=1_000_000).withColumn("score", r6("score"))
    return u.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "node"))).where("rank <= 10").select("start", "node", "depth", "score")


@query("trv_22_escape_target", with_views("""SELECT sink, arg AS target, score FROM (SELECT c.dst AS sink, c.src AS arg, round(f.betweenness * (1 - f.clustering) * c.weight * 1.5::DOUBLE, 6) AS score,
    row_number() OVER (PARTITION BY c.dst ORDER BY round(f.betweenness * (1 - f.clustering) * c.weight * 1.5::DOUBLE, 6) DESC, c.src) AS rn FROM calls c JOIN features f ON f.id = c.src) WHERE rn = 1""", "calls", "features"))  # fmt: skip
def escape_target(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    f = st.features(e).select(F.col("id").alias("src"), "betweenness", "clustering")
    scored = e.join(f, "src").select(F.col("dst").alias("sink"), "src", r6(F.col("betweenness") * (1 - F.col("clustering")) * F.col("weight") * 1.5).alias("score"))
    best = scored.groupBy("sink").agg(F.min(F.struct((-F.col("score")).alias("n"), "src", "score")).alias("b"))
    return best.select("sink", F.col("b.src").alias("target"), F.col("b.score").alias("score"))


@query("trv_21_sink_escape", with_views("""SELECT id, round(0.6::DOUBLE * least(1, in_weight / greatest(1, in_degree)) + 0.3::DOUBLE * centrality + 0.1::DOUBLE * (1 - clustering), 6) AS score FROM features WHERE in_degree > 2 * out_degree""", "features"))
def sink_escape(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf)).where("in_degree > 2 * out_degree")
    tension = F.least(F.lit(1.0), F.col("in_weight") / F.greatest(F.lit(1), F.col("in_degree")))
    return f.select("id", r6(0.6 * tension + 0.3 * F.col("centrality") + 0.1 * (1 - F.col("clustering"))).alias("score"))


@query("trv_25_path_decay", with_views("""WITH s1 AS (SELECT src AS start, dst AS node, weight AS p FROM calls WHERE weight >= 0.3), s2 AS (SELECT s.start, c.dst AS node, max(p * weight) AS p FROM s1 s JOIN calls c ON c.src = s.node WHERE p * weight >= 0.3 GROUP BY 1, 2),
    s3 AS (SELECT s.start, c.dst AS node, max(p * weight) AS p FROM s2 s JOIN calls c ON c.src = s.node WHERE p * weight >= 0.3 GROUP BY 1, 2), s4 AS (SELECT s.start, c.dst AS node, max(p * weight) AS p FROM s3 s JOIN calls c ON c.src = s.node WHERE p * weight >= 0.3 GROUP BY 1, 2)
    SELECT start, node, round(p, 6) AS product FROM s4""", "calls"))  # fmt: skip
def path_decay(spark: SparkSession, sf: str) -> DataFrame:
    return tv.path_decay(calls(spark, sf), depth=3, tau=0.3).select("start", "node", r6("product").alias("product"))


@query("trv_23_region_reachability", with_views("""WITH e AS (SELECT src FROM (SELECT src, sum(weight) AS w FROM calls GROUP BY src) ORDER BY round(w, 6) DESC, src LIMIT 3), d1 AS (SELECT DISTINCT dst AS node FROM calls JOIN e USING (src) WHERE dst NOT IN (SELECT src FROM e)),
    d2 AS (SELECT DISTINCT c.dst AS node FROM calls c JOIN d1 ON d1.node = c.src WHERE c.dst NOT IN (SELECT src FROM e) AND c.dst NOT IN (SELECT node FROM d1))
    SELECT node, depth FROM (SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2) ORDER BY depth, node LIMIT 50""", "calls"))  # fmt: skip
def region_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    top = e.groupBy("src").agg(r6(F.sum("weight")).alias("w")).orderBy(F.desc("w"), "src").limit(3).select(F.col("src").alias("id"))
    visits, _ = tv.bfs(e, top, 2)
    near = visits.groupBy("node").agg(F.min("depth").alias("depth")).where("depth > 0")
    return near.orderBy("depth", "node").limit(50)


@query("trv_26_coupling_reach", with_views(f"WITH {LEVELS} SELECT start, count(*) AS reached FROM visits GROUP BY start", "calls"))
def coupling_reach(spark: SparkSession, sf: str) -> DataFrame:
    return everything(spark, sf)[0].groupBy("start").agg(F.count(F.lit(1)).alias("reached"))


@query("trv_17_greedy_ascent", with_views("""WITH scored AS (SELECT c.src, c.dst, round((b.centrality - a.centrality) * c.weight, 6) AS score FROM calls c JOIN features a ON a.id = c.src JOIN features b ON b.id = c.dst),
    g AS (SELECT id AS start, id AS node, [id] AS path, 0 AS k FROM features UNION ALL SELECT start, dst, list_append(path, dst), k + 1 FROM (SELECT g.start, s.dst, g.path, g.k, row_number() OVER (PARTITION BY g.start ORDER BY s.score DESC, s.dst) AS rn
        FROM g JOIN scored s ON s.src = g.node WHERE s.score > 0 AND NOT list_contains(g.path, s.dst) AND g.k < 5) WHERE rn = 1)
    SELECT start, arg_max(node, k) AS stop, max(k)::INT AS steps FROM g GROUP BY start""", "calls", "features").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def greedy(spark: SparkSession, sf: str) -> DataFrame:
    """From many starts at once to the best unvisited successor by weight times rise in centrality, at most 5 steps."""
    e = calls(spark, sf)
    f = st.features(e).select("id", "centrality")
    scored = save(e.join(f.withColumnsRenamed({"id": "src", "centrality": "a"}), "src").join(f.withColumnsRenamed({"id": "dst", "centrality": "b"}), "dst").select("src", "dst", r6((F.col("b") - F.col("a")) * F.col("weight")).alias("score")))
    state = save(f.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")))
    done = None
    for _ in range(5):
        move = state.join(scored.withColumnRenamed("src", "node"), "node").where((F.col("score") > 0) & ~F.array_contains("path", F.col("dst")))
        best = move.groupBy("start").agg(F.min(F.struct((-F.col("score")).alias("n"), "dst", "path")).alias("b")).select("start", F.col("b.dst").alias("node"), F.concat("b.path", F.array("b.dst")).alias("path"))
        best = save(best)
        stopped = state.join(best, "start", "left_anti")
        done = stopped if done is None else done.unionByName(stopped)
        state = best
    return done.unionByName(state).select("start", F.col("node").alias("stop"), (F.size("path") - 1).alias("steps"))


MODE = """CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN out_degree = 0 THEN 'reverse' WHEN centrality > 0.6 AND betweenness <= 0.5 THEN 'saddle' WHEN betweenness > 0.5 AND 1 / (1 + exp(-in_degree / 10.0::DOUBLE)) >= 0.7 THEN 'reverse' WHEN centrality < 0.2 THEN 'field' ELSE 'forward' END"""


@query("trv_19_mode_selection", with_views(f"SELECT id, {MODE} AS mode FROM features", "features"))
def modes(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf))
    field = F.when((F.col("centrality") > 0.6) & (F.col("betweenness") <= 0.5), "saddle").when(F.col("betweenness") > 0.5, "attractor").when(F.col("centrality") < 0.2, "repeller").otherwise("neutral")
    role = F.when(F.col("out_degree") == 0, "sink").otherwise("leaf")
    f = f.withColumn("gravity", energy.gravity(F.col("in_degree")))
    return f.select("id", roles.mode((F.col("in_degree") == 0) & (F.col("out_degree") == 0), role, field, F.col("gravity")).alias("mode"))


COST = "costs AS (SELECT src, dst, round(2 - weight, 6) AS cost FROM calls)"
CHEAP = """least_(node, cost) USING KEY (node) AS (SELECT 'sym::1', 0.0::DOUBLE UNION SELECT dst, min(c) FROM (SELECT k.dst, l.cost + k.cost AS c FROM least_ l JOIN costs k ON l.node = k.src) n
    LEFT JOIN recurring.least_ r ON r.node = n.dst WHERE r.cost IS NULL OR c < r.cost - 1e-12 GROUP BY dst)"""


PLANS = """least_(node, cost, path) USING KEY (node) AS (SELECT 'sym::1', 0.0::DOUBLE, ['sym::1'] UNION SELECT dst, min(c), arg_min(p, (c, p)) FROM
    (SELECT k.dst, l.cost + k.cost AS c, list_append(l.path, k.dst) AS p FROM least_ l JOIN costs k ON l.node = k.src) n LEFT JOIN recurring.least_ r ON r.node = n.dst WHERE r.cost IS NULL OR c < r.cost - 1e-12 GROUP BY dst)"""


def costs(spark: SparkSession, sf: str) -> DataFrame:
    return save(calls(spark, sf).select("src", "dst", r6(2 - F.col("weight")).alias("cost")))


@query("pth_01_cheapest_paths", recursive(f"WITH {COST}, {CHEAP} SELECT node, round(cost, 6) AS cost FROM least_", "calls"))
def cheapest(spark: SparkSession, sf: str) -> DataFrame:
    return pg.cheapest(costs(spark, sf), starts(spark, "sym::1"), hops=60).select("node", r6("cost").alias("cost"))


#: States to plan over: energy, friction, mass and a vector of five measures; and what a step costs between them.
PLANNED = """st AS (SELECT id, round(2.5::DOUBLE + 4 * centrality * (1 - clustering), 6) AS energy, round(1 - tau_persistence * 0.5::DOUBLE, 6) AS friction, (in_degree + out_degree)::DOUBLE AS mass,
    [centrality, betweenness, clustering, tau_persistence, entry_variance]::DOUBLE[] AS v FROM states),
    step AS (SELECT DISTINCT src, dst, a.energy AS ae, b.energy AS be, b.friction AS f, b.mass AS m, list_distance(a.v, b.v) AS d,
        CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0 THEN (list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) + 1) / 2 ELSE 0 END AS al FROM calls JOIN st a ON a.id = src JOIN st b ON b.id = dst),
    costs AS (SELECT src, dst, round(greatest(0, (0.35::DOUBLE * (1 - al) + 0.25::DOUBLE / (1 + exp(-3 * (f - 0.5::DOUBLE))) + 0.15::DOUBLE * ln(1 + d) / ln(11.0::DOUBLE) + 0.4::DOUBLE * greatest(0, be - ae)) * (1 + 0.3::DOUBLE * f)), 6) AS cost,
        round(1.3::DOUBLE * (0.15::DOUBLE * ln(1 + d) / ln(11.0::DOUBLE) + 0.3::DOUBLE * (1 - al)) * CASE WHEN m < 5 AND f > 0.5 THEN exp(3 * f) ELSE 1 END, 6) AS heuristic FROM step)"""


def planned(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.planner import transition_costs

    s = st.states(calls(spark, sf))
    vector = F.array(*(F.col(c).cast("double") for c in ("centrality", "betweenness", "clustering", "tau_persistence", "entry_variance")))
    s = s.select("id", r6(2.5 + 4 * F.col("centrality") * (1 - F.col("clustering"))).alias("energy"), r6(1 - F.col("tau_persistence") * 0.5).alias("friction"), (F.col("in_degree") + F.col("out_degree")).cast("double").alias("mass"), vector.alias("vector"))
    return save(transition_costs(save(s), calls(spark, sf)))


@query("pth_02_step_costs", with_views(f"WITH {PLANNED} SELECT src, dst, round(cost, 6) AS cost, round(heuristic, 6) AS heuristic FROM costs", "states", "calls"))
def step_costs(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).select("src", "dst", "cost", "heuristic")


@query("pth_02_plan", recursive(f"WITH {PLANNED}, {CHEAP} SELECT node, round(cost, 6) AS cost, cost <= 10 AS valid FROM least_", "states", "calls"))
def plan(spark: SparkSession, sf: str) -> DataFrame:
    """The least cost of a plan from one symbol to every other."""
    r = pg.cheapest(planned(spark, sf), starts(spark, "sym::1"), hops=60)
    return r.select("node", r6("cost").alias("cost"), (F.col("cost") <= 10).alias("valid"))


@query("pth_03_k_shortest", with_views("""WITH e AS (SELECT src, dst, round(2 - weight, 6) AS cost FROM calls), goal AS (SELECT max(b.dst) AS g FROM calls a JOIN calls b ON b.src = a.dst WHERE a.src = 'sym::1'),
    p1 AS (SELECT [src, dst] AS path, cost, dst AS node FROM e WHERE src = 'sym::1'), p2 AS (SELECT list_append(path, e.dst) AS path, p1.cost + e.cost AS cost, e.dst AS node FROM p1 JOIN e ON e.src = p1.node, goal WHERE NOT list_contains(path, e.dst) AND p1.node <> g),
    p3 AS (SELECT list_append(path, e.dst) AS path, p2.cost + e.cost AS cost, e.dst AS node FROM p2 JOIN e ON e.src = p2.node, goal WHERE NOT list_contains(path, e.dst) AND p2.node <> g),
    p4 AS (SELECT list_append(path, e.dst) AS path, p3.cost + e.cost AS cost, e.dst AS node FROM p3 JOIN e ON e.src = p3.node, goal WHERE NOT list_contains(path, e.dst) AND p3.node <> g),
    hits AS (SELECT path, round(cost, 6) AS cost FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4), goal WHERE node = g)
    SELECT row_number() OVER (ORDER BY cost, path)::INT AS rank, path, cost, (len(path) - 1)::INT AS hops FROM (SELECT * FROM hits ORDER BY cost, path LIMIT 5)""", "calls"))  # fmt: skip
def k_shortest(spark: SparkSession, sf: str) -> DataFrame:
    e = costs(spark, sf)
    goal = e.where("src = 'sym::1'").select(F.col("dst").alias("src")).join(e, "src").agg(F.max("dst")).first()[0]
    p = pg.simple_paths(e, "sym::1", goal or "sym::1", hops=4).withColumn("cost", r6("cost"))
    return p


@query("pth_04_plan_metrics", recursive(f"""WITH {COST}, {PLANS}, s AS (SELECT node, cost, len(path) - 1 AS hops, unnest(path) AS step FROM least_), g AS (SELECT node, cost, hops, avg(1 - centrality) AS risk,
    exp(avg(ln(greatest(1e-9::DOUBLE, (1 - (1 - centrality)) * 0.98::DOUBLE)))) AS coherence FROM s JOIN features ON id = step GROUP BY 1, 2, 3)
    SELECT node, hops::INT AS hops, round(cost, 6) AS cost, round(risk, 6) AS risk, round(coherence, 6) AS coherence, cost <= 10 AND risk <= 0.8 AND coherence > 0.15 AS valid FROM g""", "calls", "features"))  # fmt: skip
def plan_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cheapest path: mean friction (risk), geometric coherence, hops and validity."""
    e = costs(spark, sf)
    p = pg.cheapest(e, starts(spark, "sym::1"), hops=60)
    f = st.features(calls(spark, sf)).select(F.col("id").alias("step"), (1 - F.col("centrality")).alias("friction"))
    s = p.select("node", "cost", "hops", F.explode("path").alias("step")).join(f, "step")
    g = s.groupBy("node", "cost", "hops").agg(F.avg("friction").alias("risk"), F.exp(F.avg(F.log(F.greatest(F.lit(1e-9), (1 - F.col("friction")) * 0.98)))).alias("coherence"))
    return g.select("node", "hops", r6("cost").alias("cost"), r6("risk").alias("risk"), r6("coherence").alias("coherence"), ((F.col("cost") <= 10) & (F.col("risk") <= 0.8) & (F.col("coherence") > 0.15)).alias("valid"))


@query("top_08_landing_hints", recursive(f"""WITH {COST}, {PLANS}, s AS (SELECT node, unnest(path) AS step, unnest(range(len(path))) AS pos FROM least_ WHERE len(path) - 1 BETWEEN 2 AND 4),
    e AS (SELECT node, step, pos, centrality AS energy, in_degree, out_degree, avg(centrality) OVER (PARTITION BY node) AS mean FROM s JOIN features ON id = step),
    x AS (SELECT node, step, round(0.4::DOUBLE * energy / (mean + 1e-6::DOUBLE) + 0.2::DOUBLE * least(out_degree / 20.0::DOUBLE, 1) + 0.2::DOUBLE * in_degree / (out_degree + 1) + 0.2::DOUBLE / (1 + pos), 3) AS score FROM e)
    SELECT node, rank::INT AS rank, step, score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, step) AS rank FROM x) WHERE rank <= 3""", "calls", "features"))  # fmt: skip
def landing_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The three best steps of each cheapest path: energy over its mean, fan-out, convergence and an early place."""
    e = calls(spark, sf)
    p = pg.cheapest(costs(spark, sf), starts(spark, "sym::1"), hops=60).where("hops between 2 and 4")
    f = st.features(e).select(F.col("id").alias("step"), "in_degree", "out_degree", F.col("centrality").alias("energy"))
    s = p.select("node", F.posexplode("path").alias("pos", "step")).join(f, "step")
    mean = s.groupBy("node").agg(F.avg("energy").alias("mean"))
    score = 0.4 * F.col("energy") / (F.col("mean") + 1e-6) + 0.2 * F.least(F.col("out_degree") / 20.0, F.lit(1.0)) + 0.2 * F.col("in_degree") / (F.col("out_degree") + 1) + 0.2 / (1 + F.col("pos"))
    s = s.join(mean, "node").withColumn("score", F.round(score, 3))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "step"))
    return s.withColumn("rank", rank).where("rank <= 3").select("node", "rank", "step", "score")


@query("joi_01_frontier_join", with_views("SELECT v.id, c.dst, c.weight FROM (SELECT id FROM symbols WHERE intent = 'io') v JOIN calls c ON c.src = v.id WHERE c.weight >= 0.05", "calls", "symbols"))
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    v = symbols(spark, sf).where("intent = 'io'").select("id")
    return v.join(calls(spark, sf).withColumnRenamed("src", "id"), "id").where("weight >= 0.05").select("id", "dst", "weight")


@query("joi_02_visited_anti", with_views("SELECT DISTINCT dst FROM calls WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = dst AND s.intent = 'io')", "calls", "symbols"))
def visited(spark: SparkSession, sf: str) -> DataFrame:
    seen = symbols(spark, sf).where("intent = 'io'").select(F.col("id").alias("dst"))
    return calls(spark, sf).select("dst").distinct().join(seen, "dst", "left_anti")


@query("src_30_incoming_edges", with_views("SELECT dst AS id, list_sort(list(src)) AS sources, round(sum(weight), 6) AS weight FROM calls WHERE src LIKE 'sym::%' GROUP BY dst", "calls"))
def incoming(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).where("src like 'sym::%'").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("sources"), r6(F.sum(F.coalesce("weight", F.lit(1.0)))).alias("weight"))
