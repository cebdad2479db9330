"""Views of the test tables as symbols, edges and logs, and their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import fresh

INTENTS = {"STANDARD": "io", "PROMO": "network", "LARGE": "database", "SMALL": "config", "ECONOMY": "util", "MEDIUM": "test"}
KINDS = ["class", "function", "method", "async_function"]
ROLES = ["controller", "service", "repository", "adapter", "factory", "worker"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part."""
    p = table(spark, sf_dir, "part")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    kind = F.lower("p_type")
    intent = F.create_map(*(F.lit(x) for kv in INTENTS.items() for x in kv))[F.col("p_type")]
    return p.select(
        F.concat(F.lit("sym::"), "p_partkey").alias("id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey").alias("name"),
        F.concat(F.lit("src/"), kind, F.lit("/"), brand, F.lit("/mod_"), "p_size", F.lit(".py")).alias("path"),
        (F.col("p_partkey") % 997 + 1).cast("int").alias("line"),
        pick(F.col("p_size") % 4, KINDS).alias("kind"),
        F.array(kind, brand, F.concat(F.lit("size_"), "p_size")).alias("tags"),
        intent.alias("intent"),
        pick(F.col("p_size") % 6, ROLES).alias("role"),
        (F.col("p_partkey") % 17 == 0).alias("is_noisy"),
        (F.col("p_size") / 10.0).alias("complexity"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted calls: a part and the next one of the same order; of each part the three most frequent.

    The edges are stored, as a graph's are: built from the order lines once for each application and
    state of their files, and read from there by every query.
    """
    return fresh(spark, "calls", f"{sf_dir}/lineitem.parquet", lambda: _calls(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", F.lead("l_partkey").over(w).alias("next"))
    pairs = pairs.where("next is not null and next != l_partkey").groupBy("l_partkey", "next").agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy("l_partkey")
    ranked = pairs.withColumn("rn", F.row_number().over(own.orderBy(F.desc("k"), "next"))).where("rn <= 3")
    weight = F.round(0.8 * F.col("k") / F.max("k").over(own), 6)
    return ranked.select(F.concat(F.lit("sym::"), "l_partkey").alias("src"), F.concat(F.lit("sym::"), "next").alias("dst"), F.lit("call").alias("kind"), weight.alias("weight"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between symbols and the categories of their tags, both ways."""
    t = symbols(spark, sf_dir).select("id", F.explode("tags").alias("tag")).withColumn("cat", F.concat(F.lit("cat::"), "tag"))
    there = t.select(F.col("id").alias("src"), F.col("cat").alias("dst"), F.lit("category").alias("kind"), F.lit(0.5).alias("weight"))
    back = t.select(F.col("cat").alias("src"), F.col("id").alias("dst"), F.lit("semantic_similarity").alias("kind"), F.lit(0.15).alias("weight"))
    return there.unionByName(back)


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer, order as a tree of containment, 0.1 over the number of children."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    pairs = (
        n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
        .unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
        .unionByName(o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))
    )
    number = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(number, "src").select("src", "dst", F.lit("contains").alias("kind"), F.round(F.lit(0.1) / F.col("n"), 9).alias("weight"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a visit log: symbol (the user), event type, microseconds, value and payload."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("user::"), "user_id").alias("symbol"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value", "props")


#: The same in DuckDB SQL, by name; later ones use earlier ones.
_VIEWS = {
    "symbols": f"""SELECT 'sym::' || p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
        'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '/mod_' || p_size || '.py' AS path, (p_partkey % 997 + 1)::INT AS line,
        CASE p_size % 4 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS kind,
        [lower(p_type), lower(replace(p_brand, '#', '_')), 'size_' || p_size] AS tags,
        CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INTENTS.items())} END AS intent,
        CASE p_size % 6 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(ROLES))} END AS role, p_partkey % 17 = 0 AS is_noisy, p_size / 10.0::DOUBLE AS complexity FROM part""",
    "calls": """SELECT 'sym::' || src AS src, 'sym::' || dst AS dst, 'call' AS kind, round(0.8::DOUBLE * k / max(k) OVER (PARTITION BY src), 6) AS weight FROM
        (SELECT src, dst, k, row_number() OVER (PARTITION BY src ORDER BY k DESC, dst) AS rn FROM
        (SELECT src, dst, count(*) AS k FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
        WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst)) WHERE rn <= 3""",
    "categories": """SELECT id AS src, 'cat::' || tag AS dst, 'category' AS kind, 0.5::DOUBLE AS weight FROM (SELECT id, unnest(tags) AS tag FROM symbols)
        UNION ALL SELECT 'cat::' || tag, id, 'semantic_similarity', 0.15::DOUBLE FROM (SELECT id, unnest(tags) AS tag FROM symbols)""",
    "contains": """SELECT src, dst, 'contains' AS kind, round(0.1::DOUBLE / count(*) OVER (PARTITION BY src), 9) AS weight FROM
        (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)""",
    "log": """SELECT event_id, 'user::' || user_id AS symbol, event_type, epoch_us(ts) AS ts_us, value, props FROM events""",
    "ends": "SELECT src AS id, 1 AS o, 0 AS i, weight AS wo, NULL::DOUBLE AS wi, dst AS other FROM calls UNION ALL SELECT dst, 0, 1, NULL, weight, src FROM calls",
    "degrees": "SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, coalesce(sum(wo), 0) AS out_weight, coalesce(sum(wi), 0) AS in_weight FROM ends GROUP BY id",
    "features": """SELECT d.*, out_weight / max(out_weight) OVER () AS centrality,
        (CASE WHEN in_degree + out_degree > 0 THEN in_degree * out_degree / (in_degree + out_degree)::DOUBLE ELSE 0 END)
            / max(CASE WHEN in_degree + out_degree > 0 THEN in_degree * out_degree / (in_degree + out_degree)::DOUBLE ELSE 0 END) OVER () AS betweenness,
        coalesce(links, 0) / greatest(1, out_degree * (out_degree - 1))::DOUBLE AS clustering FROM degrees d
        LEFT JOIN (SELECT a.src AS id, count(*) AS links FROM calls a JOIN calls b ON a.src = b.src JOIN calls c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src) USING (id)""",
    "states": """SELECT f.*, coalesce(CASE WHEN n_in < 2 OR mean_in <= 0 THEN 0 ELSE least(1, vi / (mean_in * mean_in)) END, 0) AS entry_variance,
        coalesce(CASE WHEN n_out < 2 OR mean_out <= 0 THEN 0 ELSE least(1, so / mean_out) END, 0) AS structural_noise, least(1.0, out_weight / greatest(1, out_degree)) AS tau_persistence,
        in_degree * 7 + out_degree AS frequency FROM features f LEFT JOIN (SELECT id, count(wi) AS n_in, avg(wi) AS mean_in, var_pop(wi) AS vi, count(wo) AS n_out, avg(wo) AS mean_out, stddev_pop(wo) AS so FROM ends GROUP BY id) USING (id)""",
}
_NEEDS = {"categories": ["symbols"], "ends": ["calls"], "degrees": ["ends"], "features": ["degrees", "calls"], "states": ["features", "ends"]}


def with_views(body: str, *names: str) -> str:
    """body with the views it names before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    views = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in order)
    recursive = "RECURSIVE " if body.lstrip().upper().startswith("RECURSIVE ") else ""
    body = body.lstrip()[len(recursive) :] if recursive else body.lstrip()
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{views}, {body[5:]}"
    return f"WITH {recursive}{views} {body}"
