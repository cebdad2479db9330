"""States, energies, fields and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import calls, symbols, table, with_views
from ..functions import energy as en
from ..functions import roles
from ..operators import fields as fd
from ..operators import structure as st
from ..registry import query, r6, rounded
from ..tables import save
from .graph import ROLE, SCORES


def states(spark: SparkSession, sf: str) -> DataFrame:
    return st.states(calls(spark, sf))


METRICS = ["centrality", "betweenness", "clustering", "tau_persistence", "entry_variance"]
ROUND = ", ".join(f"round({m} + 1e-9, 6) AS {m}" for m in METRICS)
PCT = ", ".join(f"round(cume_dist() OVER (ORDER BY {m}), 6) AS pct_{m}" for m in METRICS)


@query("str_09_manifold_state", with_views(f"WITH m AS (SELECT id, frequency, {ROUND} FROM states) SELECT id, frequency, {', '.join(METRICS)}, {PCT} FROM m", "states"))
def manifold(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf).select("id", "frequency", *(r6(F.col(m) + 1e-9).alias(m) for m in METRICS))
    return rounded(st.percentiles(s, *METRICS), *(f"pct_{m}" for m in METRICS))


@query("str_09_embedding_norm", with_views("SELECT id, round(sqrt(centrality * centrality + betweenness * betweenness + clustering * clustering + tau_persistence * tau_persistence), 5) AS norm FROM states", "states"))
def embedding_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf)
    return s.select("id", F.round(en.norm(F.array("centrality", "betweenness", "clustering", "tau_persistence")), 5).alias("norm"))


OUTW = "SELECT src AS id, weight FROM calls"


def _entropy(kind: str) -> str:
    term = {"log2": "-p * log2(p)", "ln_eps": "-p * ln(p + 1e-9)", "ln_scaled": "-p * ln(p)", "ln": "-p * ln(p)"}[kind]
    value = {"log2": "h / log2(greatest(n, 2))", "ln_eps": "h / ln(greatest(n, 2))", "ln_scaled": "0.3::DOUBLE * h", "ln": "h / ln(greatest(n, 2))"}[kind]
    return f"SELECT id, round(CASE WHEN n < 2 THEN 0 ELSE {value} END, 6) AS entropy FROM (SELECT id, n, sum({term}) AS h FROM (SELECT id, weight / sum(weight) OVER (PARTITION BY id) AS p, count(*) OVER (PARTITION BY id) AS n FROM ({OUTW})) GROUP BY id, n)"


def _entropy_query(kind: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(fd.entropy(calls(spark, sf).select(F.col("src").alias("id"), "weight"), "id", "weight", kind), "entropy")

    return run


for _kind in ("log2", "ln_eps", "ln_scaled", "ln"):
    query(f"agg_10_entropy_{_kind}", with_views(_entropy(_kind), "calls"))(_entropy_query(_kind))

ENERGY = """h AS (SELECT id, CASE WHEN n < 2 THEN 0 ELSE h / ln(greatest(n, 2)) END AS entropy FROM (SELECT id, n, sum(-p * ln(p)) AS h FROM (SELECT src AS id, weight / sum(weight) OVER (PARTITION BY src) AS p, count(*) OVER (PARTITION BY src) AS n FROM calls) GROUP BY id, n)),
    pot AS (SELECT s.*, 0.4::DOUBLE * ln(1 + 1000 * centrality) + 0.3::DOUBLE * ln(1 + frequency::DOUBLE) + 0.3::DOUBLE * tau_persistence * tau_persistence * tau_persistence AS potential, 0.3::DOUBLE * coalesce(entropy, 0) AS bonus FROM states s LEFT JOIN h USING (id)),
    en0 AS (SELECT *, 10 * tanh((potential + bonus) / 10) AS energy, least(1, (1 - tau_persistence) * (1 + structural_noise)) AS raw FROM pot),
    energies AS (SELECT *, greatest(0, least(1, raw * (1 - 0.3::DOUBLE * least(1, energy / 10)))) AS friction FROM en0)"""


def energies(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    return fd.with_energy(st.states(e), fd.entropy(e.select(F.col("src").alias("id"), "weight"), "id", "weight", "ln"))


@query("str_15_energy_states", with_views(f"WITH {ENERGY} SELECT id, round(potential, 5) AS potential, round(energy, 5) AS energy, round(friction, 5) AS friction FROM energies", "states", "calls"))
def energy_states(spark: SparkSession, sf: str) -> DataFrame:
    five = lambda c: F.round(c, 5).alias(c)
    return energies(spark, sf).select("id", five("potential"), five("energy"), five("friction"))


@query("fn_23_runtime_energy", with_views("SELECT id, round(greatest(0, 0.4::DOUBLE * centrality + 0.3::DOUBLE * least(1, frequency / 1000.0::DOUBLE) - 0.5::DOUBLE * tau_persistence + 0.2::DOUBLE * clustering), 5) AS energy, round(least(1, (1 - tau_persistence) * (1 + structural_noise)), 5) AS friction FROM states", "states"))
def runtime(spark: SparkSession, sf: str) -> DataFrame:
    s = states(spark, sf)
    return s.select("id", F.round(en.runtime_energy(F.col("centrality"), F.col("frequency"), F.col("tau_persistence"), F.col("clustering")), 5).alias("energy"), F.round(en.runtime_friction(F.col("tau_persistence"), F.col("structural_noise")), 5).alias("friction"))


@query("fn_21_legacy_energy", with_views("SELECT id, round(0.4::DOUBLE * (1 - 1 / (1 + exp(-in_degree / 10.0::DOUBLE))) + 0.4::DOUBLE * round(0.6::DOUBLE * tanh(in_degree / 10.0::DOUBLE) + 0.4::DOUBLE * tanh(out_degree / 100.0::DOUBLE), 4), 5) AS energy FROM degrees", "degrees"))
def legacy(spark: SparkSession, sf: str) -> DataFrame:
    d = st.degrees(calls(spark, sf))
    return d.select("id", F.round(en.legacy_energy(en.gravity(F.col("in_degree")), en.heat(F.col("in_degree"), F.col("out_degree"))), 5).alias("energy"))


@query("fn_33_field_roles", with_views(f"""WITH {ENERGY} SELECT CASE WHEN energy > 5 AND in_degree + out_degree < 8 AND friction < 0.3 OR is_noisy AND energy > 2 THEN 'attractor' WHEN energy < 1 AND in_degree + out_degree > 5 THEN 'repeller'
    WHEN energy >= 2 AND in_degree + out_degree <= 5 THEN 'saddle' ELSE 'neutral' END AS field_role, count(*) AS n FROM energies JOIN symbols USING (id) GROUP BY 1""".replace("< 8", "< 2"), "states", "calls", "symbols"))  # fmt: skip
def field_roles(spark: SparkSession, sf: str) -> DataFrame:
    s = energies(spark, sf).join(symbols(spark, sf).select("id", "is_noisy"), "id")
    return s.groupBy(roles.field_role(F.col("energy"), F.col("in_degree") + F.col("out_degree"), F.col("friction"), F.col("is_noisy")).alias("field_role")).agg(F.count(F.lit(1)).alias("n"))


KERNEL = """k AS (SELECT c.src AS id, sqrt(sum((b.energy - a.energy) * (b.energy - a.energy))) AS magnitude, min(b.energy - a.energy) AS low, max(b.energy - a.energy) AS high FROM calls c JOIN en a ON a.id = c.src JOIN en b ON b.id = c.dst GROUP BY c.src)"""


@query("str_14_runtime_field", with_views(f"""WITH {ENERGY}, en AS (SELECT id, round(energy, 5) AS energy FROM energies), {KERNEL}
    SELECT en.id, round(coalesce(magnitude, 0), 5) AS magnitude, CASE WHEN magnitude > 0.1 THEN 'not_critical_point' WHEN low > 0 THEN 'stable_attractor' WHEN high < 0 THEN 'unstable_repeller' ELSE 'saddle' END AS kernel_role FROM en LEFT JOIN k USING (id)""", "states", "calls"))  # fmt: skip
def runtime_field(spark: SparkSession, sf: str) -> DataFrame:
    s = energies(spark, sf).select("id", F.round("energy", 5).alias("energy"))
    return fd.runtime_field(s, calls(spark, sf)).withColumn("magnitude", F.round("magnitude", 5))


@query("str_15_gradient", with_views("""WITH p AS (SELECT id, round(out_weight, 6) AS energy, in_degree::DOUBLE AS x, out_degree::DOUBLE AS y, 0.0::DOUBLE AS z FROM degrees),
    d AS (SELECT a.id, (b.energy - a.energy) * weight AS pull, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM calls JOIN p a ON a.id = src JOIN p b ON b.id = dst)
    SELECT id, round(sum(CASE WHEN len > 0 THEN pull / len * dx ELSE 0 END), 5) AS dx, round(sum(CASE WHEN len > 0 THEN pull / len * dy ELSE 0 END), 5) AS dy FROM d GROUP BY id""", "degrees", "calls"))  # fmt: skip
def gradient(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    p = st.degrees(e).select("id", r6("out_weight").alias("energy"), F.col("in_degree").cast("double").alias("x"), F.col("out_degree").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return fd.gradient(p, e).select("id", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"))


@query("str_16_backward_tension", with_views("""WITH g AS (SELECT id, 1 / (1 + exp(-in_degree / 10.0::DOUBLE)) AS gravity FROM degrees),
    h AS (SELECT id, CASE WHEN n < 2 THEN 0 ELSE h / ln(greatest(n, 2)) END AS source_diversity FROM (SELECT id, n, sum(-p * ln(p)) AS h FROM (SELECT dst AS id, weight / sum(weight) OVER (PARTITION BY dst) AS p, count(*) OVER (PARTITION BY dst) AS n FROM calls) GROUP BY id, n))
    SELECT dst AS id, round(least(1, avg(weight * coalesce(gravity, 0.5::DOUBLE))), 6) AS backward_tension, round(any_value(source_diversity), 6) AS source_diversity FROM calls LEFT JOIN g ON g.id = src JOIN h ON h.id = dst GROUP BY dst""", "degrees", "calls"))  # fmt: skip
def tension(spark: SparkSession, sf: str) -> DataFrame:
    e = calls(spark, sf)
    g = st.degrees(e).select("id", en.gravity(F.col("in_degree")).alias("gravity"))
    return rounded(fd.backward_tension(e, g), "backward_tension", "source_diversity")


RANK = "ranked AS (SELECT *, (row_number() OVER (ORDER BY round(centrality, 6) DESC, id) - 1) / count(*) OVER ()::DOUBLE AS energy_rank FROM features)"


@query("win_03_energy_rank", with_views(f"WITH {RANK} SELECT id, round(energy_rank, 6) AS energy_rank FROM ranked", "features"))
def energy_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf)).select("id", r6("centrality").alias("energy"))
    return fd.rank_energy(f).select("id", r6("energy_rank").alias("energy_rank"))


@query("str_17_attractor_bias", with_views(f"""WITH {RANK} SELECT id, CASE WHEN list_has_any(tags, ['small', 'economy']) THEN 0.0 WHEN out_degree = 0 AND intent = 'database' THEN 0.3 WHEN list_has_any(tags, ['large', 'promo']) THEN 0.21 ELSE 0.0 END::DOUBLE AS bias,
    in_degree / (out_degree + 1)::DOUBLE > 2 AND in_degree >= 3 AND out_degree <= 20 AND energy_rank <= 0.3 AS basin FROM ranked JOIN symbols USING (id)""", "features", "symbols"))  # fmt: skip
def bias(spark: SparkSession, sf: str) -> DataFrame:
    f = fd.rank_energy(st.features(calls(spark, sf)).withColumn("energy", r6("centrality"))).join(symbols(spark, sf).select("id", "tags", "intent"), "id")
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    b, basin = roles.attractor_bias(has("small", "economy"), (F.col("out_degree") == 0) & (F.col("intent") == "database"), has("large", "promo"), F.col("in_degree"), F.col("out_degree"), F.col("energy_rank"))
    return f.select("id", b.alias("bias"), basin.alias("basin"))


@query("fn_36_upstream_roles", with_views("""SELECT CASE WHEN in_degree > 5 AND out_degree > 5 THEN 'CONVERTER' WHEN centrality > 0.7 AND betweenness > 0.7 THEN 'CORE_ATTRACTOR' WHEN centrality > 0.7 THEN 'EMITTER' WHEN betweenness > 0.7 THEN 'SINK' ELSE 'TRANSIENT' END AS role, count(*) AS n FROM features GROUP BY 1""", "features"))
def upstream_roles(spark: SparkSession, sf: str) -> DataFrame:
    f = st.features(calls(spark, sf))
    return f.groupBy(roles.upstream_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness"))).alias("role")).agg(F.count(F.lit(1)).alias("n"))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return v.select("vec_id", F.col("e").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")


NEXT = f"WITH {VEC}, p AS (SELECT x.vec_id, x.e AS a, y.e AS b FROM v x JOIN v y ON y.vec_id - 1 = x.vec_id)"


@query("fn_24_cosine_alignment", NEXT + " SELECT vec_id, round((list_cosine_similarity(a, b) + 1) / 2, 5) AS alignment FROM p")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("vec_id", F.round(en.alignment(F.col("a"), F.col("b")), 5).alias("alignment"))


@query("fn_25_dot_alignment", NEXT + " SELECT vec_id, round(greatest(-1, least(1, list_dot_product(a, b))), 5) AS alignment FROM p")
def dot(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("vec_id", F.round(en.raw_alignment(F.col("a"), F.col("b")), 5).alias("alignment"))


@query("fn_26_distances", NEXT + " SELECT vec_id, round(list_distance(a, b), 5) AS distance, round(ln(1 + list_distance(a, b)) / ln(11.0::DOUBLE), 5) AS log_distance, round(1 / (1 + exp(-3 * (list_distance(a, b) - 0.5::DOUBLE))), 5) AS friction FROM p")
def distances(spark: SparkSession, sf: str) -> DataFrame:
    d = pairs(spark, sf).withColumn("d", en.distance(F.col("a"), F.col("b")))
    return d.select("vec_id", F.round("d", 5).alias("distance"), F.round(en.log_norm(F.col("d")), 5).alias("log_distance"), F.round(en.logistic_friction(F.col("d")), 5).alias("friction"))


STEP = "(list_cosine_similarity(a, b) + 1) / 2 AS al, list_distance(a, b) AS d, (vec_id % 10) / 10.0::DOUBLE AS f, (vec_id % 7) / 10.0::DOUBLE - 0.3::DOUBLE AS up, (vec_id % 3) / 4.0::DOUBLE AS it"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    d = pairs(spark, sf)
    return d.select("vec_id", en.alignment(F.col("a"), F.col("b")).alias("al"), en.distance(F.col("a"), F.col("b")).alias("d"), (F.col("vec_id") % 10 / 10.0).alias("f"), (F.col("vec_id") % 7 / 10.0 - 0.3).alias("up"), (F.col("vec_id") % 3 / 4.0).alias("it"))


@query("fn_27_transition_energy", NEXT + f", s AS (SELECT vec_id, {STEP} FROM p) SELECT vec_id, round(greatest(0, (0.35::DOUBLE * (1 - al) + 0.25::DOUBLE / (1 + exp(-3 * (f - 0.5::DOUBLE))) + 0.15::DOUBLE * ln(1 + d) / ln(11.0::DOUBLE) + 0.4::DOUBLE * greatest(0, up) - 0.55::DOUBLE * it) * (1 + 0.3::DOUBLE * f)), 5) AS cost FROM s")
def transition(spark: SparkSession, sf: str) -> DataFrame:
    c = en.transition(*(F.col(c) for c in ("up", "al", "f", "d", "it")))
    return steps(spark, sf).select("vec_id", F.round(c, 5).alias("cost"))


@query("fn_28_heuristic", NEXT + f", s AS (SELECT vec_id, {STEP} FROM p) SELECT vec_id, round(1.3::DOUBLE * (0.15::DOUBLE * ln(1 + d) / ln(11.0::DOUBLE) + 0.3::DOUBLE * (1 - al)) * CASE WHEN it < 5 AND f > 0.5 THEN exp(3 * f) ELSE 1 END, 5) AS h FROM s")
def heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("vec_id", F.round(en.heuristic(*(F.col(c) for c in ("d", "al", "it", "f"))), 5).alias("h"))


@query("fn_29_transition_score", NEXT + f", s AS (SELECT vec_id, {STEP} FROM p) SELECT vec_id, round(1 / (1 + exp(up + 0.4::DOUBLE * f + 0.8::DOUBLE * (1 - al))), 5) AS score FROM s")
def transition_score(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("vec_id", F.round(en.transition_score(*(F.col(c) for c in ("up", "f", "al"))), 5).alias("score"))


@query("fn_53_floored_energy", with_views("SELECT id, round(greatest(0.001::DOUBLE, centrality * betweenness * 2), 6) AS potential, round(greatest(0.001::DOUBLE, centrality * (clustering + tau_persistence) / 2 * 2), 6) AS kinetic FROM states", "states"))
def floored(spark: SparkSession, sf: str) -> DataFrame:
    pot, kin, _ = en.floored(F.col("centrality"), F.col("betweenness"), F.lit(2.0), F.col("clustering"), F.col("tau_persistence"))
    return states(spark, sf).select("id", r6(pot).alias("potential"), r6(kin).alias("kinetic"))


@query("fn_37_mi_score", with_views("SELECT id, round(greatest(0.2, least(1, CASE WHEN betweenness > 0.6 THEN 0.8 WHEN betweenness > 0.4 THEN 0.5 WHEN betweenness > 0.2 THEN 0.3 ELSE 0.5 END::DOUBLE + least(0.2, 0.5::DOUBLE * centrality) + least(0.1, 0.2::DOUBLE * clustering) - 0.1::DOUBLE * structural_noise)), 5) AS mi FROM states", "states"))
def mi_score(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("betweenness")
    role = F.when(b > 0.6, "attractor").when(b > 0.4, "saddle").when(b > 0.2, "repeller").otherwise("other")
    return states(spark, sf).select("id", F.round(en.mi_score(role, F.col("centrality"), F.col("clustering"), 0.1 * F.col("structural_noise")), 5).alias("mi"))


@query("str_13_pseudo_neighbours", with_views("""WITH f AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM symbols), p AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY b.rn) AS place FROM symbols a JOIN f b ON a.kind = b.kind AND b.rn <= 11 AND a.id <> b.id)
    SELECT src, dst FROM p WHERE place <= 10""", "symbols"))  # fmt: skip
def pseudo(spark: SparkSession, sf: str) -> DataFrame:
    return fd.pseudo_neighbours(symbols(spark, sf).select("id", "kind"), "kind")


TURNS = """t AS (SELECT conv_id AS path_id, turn AS pos, (length(text) % 100) / 10.0::DOUBLE AS energy, (length(text) % 17) / 170.0::DOUBLE AS friction FROM conversations)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("path_id"), F.col("turn").alias("pos"), (F.char_length("text") % 100 / 10.0).alias("energy"), (F.char_length("text") % 17 / 170.0).alias("friction"))


@query("pth_06_simulation", f"""WITH {TURNS}, g AS (SELECT path_id, count(*) AS steps, arg_min(energy, pos) AS f, arg_max(energy, pos) AS l, sum(friction) AS friction_loss FROM t GROUP BY 1),
    x AS (SELECT *, f - l AS energy_loss, greatest(abs(f - l - friction_loss), greatest(0.01::DOUBLE, 0.01::DOUBLE * f)) + 0.02::DOUBLE * steps AS err FROM g)
    SELECT path_id, steps, round(energy_loss, 5) AS energy_loss, round(friction_loss, 5) AS friction_loss, round(err, 5) AS conservation_error, energy_loss >= 0 AND err < 0.1 AS stable, round(ln(1 + err) / (ln(1 + f) + 0.1::DOUBLE), 5) AS divergence,
    round(1 - friction_loss / (f + 1e-10::DOUBLE), 5) AS efficiency FROM x""")
def simulation(spark: SparkSession, sf: str) -> DataFrame:
    five = ["energy_loss", "friction_loss", "conservation_error", "divergence", "efficiency"]
    s = fd.simulate(turns(spark, sf))
    return s.select("path_id", "steps", "stable", *(F.round(c, 5).alias(c) for c in five))


@query("win_09_fluctuation", f"""WITH {TURNS}, d AS (SELECT path_id, energy - lag(energy) OVER (PARTITION BY path_id ORDER BY pos) AS d FROM t)
    SELECT path_id, round(coalesce(sum(abs(d)), 0), 5) AS fluctuation, count(*) FILTER (d <= 0) AS falling FROM d GROUP BY path_id""")
def fluctuation(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("energy") - F.lag("energy").over(Window.partitionBy("path_id").orderBy("pos"))
    return turns(spark, sf).withColumn("d", d).groupBy("path_id").agg(F.round(F.coalesce(F.sum(F.abs("d")), F.lit(0.0)), 5).alias("fluctuation"), F.count_if(F.col("d") <= 0).alias("falling"))


@query("pth_07_conservation", f"""WITH {TURNS}, d AS (SELECT path_id, energy - lag(energy) OVER (PARTITION BY path_id ORDER BY pos) AS d FROM t)
    SELECT path_id, round(CASE WHEN coalesce(sum(abs(d)), 0) > 0 THEN least(1, abs(sum(d)) / sum(abs(d))) ELSE 1 END, 5) AS conservation_ratio, coalesce(max(d), 0) > 0.5 AS unstable FROM d GROUP BY path_id""")
def conservation(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("energy") - F.lag("energy").over(Window.partitionBy("path_id").orderBy("pos"))
    g = turns(spark, sf).withColumn("d", d).groupBy("path_id").agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0)).alias("t"), F.sum("d").alias("s"), (F.coalesce(F.max("d"), F.lit(0.0)) > 0.5).alias("unstable"))
    return g.select("path_id", F.round(F.when(F.col("t") > 0, F.least(F.lit(1.0), F.abs("s") / F.col("t"))).otherwise(1.0), 5).alias("conservation_ratio"), "unstable")


@query("fn_52_trajectory_quality", f"""WITH {TURNS}, g AS (SELECT path_id, 1 - avg(friction) AS a, 1 - least(1, avg(energy) / 10) AS b, 1 - least(1, max(friction)) AS c, greatest(0, 1 - count(*) / 20.0::DOUBLE) AS d FROM t GROUP BY 1), q AS (SELECT path_id, round(0.35::DOUBLE * a + 0.25::DOUBLE * b + 0.25::DOUBLE * c + 0.15::DOUBLE * d, 5) AS overall FROM g)
    SELECT path_id, overall, CASE WHEN overall >= .9 THEN 'A' WHEN overall >= .8 THEN 'B' WHEN overall >= .7 THEN 'C' WHEN overall >= .6 THEN 'D' ELSE 'F' END AS grade FROM q""")
def quality(spark: SparkSession, sf: str) -> DataFrame:
    one = F.lit(1.0)
    g = turns(spark, sf).groupBy("path_id").agg((1 - F.avg("friction")).alias("a"), (1 - F.least(one, F.avg("energy") / 10)).alias("b"), (1 - F.least(one, F.max("friction"))).alias("c"), F.greatest(F.lit(0.0), 1 - F.count(F.lit(1)) / 20.0).alias("d"))
    q = g.select("path_id", F.round(0.35 * F.col("a") + 0.25 * F.col("b") + 0.25 * F.col("c") + 0.15 * F.col("d"), 5).alias("overall"))
    return q.withColumn("grade", roles.grade(F.col("overall")))


@query("pth_08_next_nodes", with_views("""WITH s AS (SELECT id, round(centrality, 6) AS energy, round(1 - clustering, 6) AS friction FROM features), sample AS (SELECT * FROM s ORDER BY id LIMIT 20)
    SELECT a.id, b.id AS next, round(greatest(0, b.energy - a.energy) + 0.5::DOUBLE * b.friction, 6) AS cost FROM s a, sample b WHERE a.id <> b.id""", "features"))  # fmt: skip
def next_nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = st.features(calls(spark, sf)).select("id", r6("centrality").alias("energy"), r6(1 - F.col("clustering")).alias("friction"))
    sample = s.orderBy("id").limit(20).select(F.col("id").alias("next"), F.col("energy").alias("e2"), F.col("friction").alias("f2"))  # of 20 rows by definition
    p = s.crossJoin(F.broadcast(sample)).where("id != next")
    return p.select("id", "next", r6(en.cumulative_barrier(F.col("e2") - F.col("energy"), F.col("f2"))).alias("cost"))


INTENT = [1.0, 0.2, -0.5]


@query("pth_05_beam_exploration")
def beam(spark: SparkSession, sf: str) -> DataFrame:
    """From every symbol five steps along states that pass the gates of friction, alignment and coherence. Which paths are
    alike is decided greedily, which SQL can't express: a test compares with a plain model."""
    from ..plans.beam import explore
    from ..plans.planner import feasible

    return explore(calls(spark, sf), feasible(directed(spark, sf), INTENT), symbols(spark, sf).select("id"))


def directed(spark: SparkSession, sf: str) -> DataFrame:
    """id, friction, vector of the symbols: the vector is that of the embedding of the same number, its first three components."""
    f = st.states(calls(spark, sf)).select("id", en.runtime_friction(F.col("tau_persistence") * 0.4, F.col("structural_noise")).alias("friction"))
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("sym::"), "vec_id").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("vector"))
    return save(f.join(v, "id", "left"))


@query("pth_05_feasible_states", with_views("""WITH d AS (SELECT s.id, least(1, (1 - tau_persistence * 0.4::DOUBLE) * (1 + structural_noise)) AS friction, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS v FROM states s LEFT JOIN embeddings ON 'sym::' || vec_id = s.id),
    g AS (SELECT id, friction, v IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0 AS known, (list_cosine_similarity(v, [1.0, 0.2, -0.5]::DOUBLE[]) + 1) / 2 AS al, least(1, sqrt(list_dot_product(v, v)) / 1.5::DOUBLE) AS co FROM d)
    SELECT id, round(CASE WHEN known THEN al ELSE 0.5 END, 6) AS score FROM g WHERE friction <= 0.8 AND (NOT known OR (al >= 0.3 AND co >= 0.2))""", "states"))
def feasible_states(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.planner import feasible

    return feasible(directed(spark, sf), INTENT).select("id", r6("score").alias("score"))
