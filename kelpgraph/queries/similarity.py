"""MinHash, near names and set similarity over the documents and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import symbols, table, with_views
from ..operators import similarity as sm
from ..registry import query
from ..tables import save

WORDS = "list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'))"


def words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", sm.word_set(F.col("text")).alias("tokens"))


@query("lsh_02_token_hash", f"SELECT DISTINCT token, ('0x' || substr(sha256(token), 7, 2) || substr(sha256(token), 5, 2) || substr(sha256(token), 3, 2) || substr(sha256(token), 1, 2))::BIGINT AS h FROM (SELECT unnest({WORDS}) AS token FROM documents)")
def token_hash(spark: SparkSession, sf: str) -> DataFrame:
    t = words(spark, sf).select(F.explode("tokens").alias("token")).distinct()
    return t.select("token", sm.token_hash(F.col("token")).alias("h"))


#: The family's pairs (a, b), and tokens' hashes, as SQL.
A, B = (f"[{', '.join(map(str, x))}]" for x in sm.family())
FAMILY = f"f AS (SELECT unnest({A})::BIGINT AS a, unnest({B})::BIGINT AS b, unnest(range(128)) AS k)"
HASH = "('0x' || substr(sha256(token), 7, 2) || substr(sha256(token), 5, 2) || substr(sha256(token), 3, 2) || substr(sha256(token), 1, 2))::BIGINT"


def signed(tokens: str, key: str = "doc_id", name: str = "m") -> str:
    """SQL of (key, k, v): the slots of the signatures of rows (key, w: a list of distinct tokens)."""
    return f"{name}_t AS (SELECT {key}, unnest(w) AS token FROM ({tokens})), {name}_h AS (SELECT token, {HASH} AS h FROM (SELECT DISTINCT token FROM {name}_t)), {name}_p AS (SELECT token, k, (a * h + b) % 2147483647 AS v FROM {name}_h, f), {name} AS (SELECT {key}, k, min(v)::BIGINT AS v FROM {name}_t JOIN {name}_p USING (token) GROUP BY 1, 2)"


DOCS = f"SELECT doc_id, {WORDS} AS w FROM documents"


def best(least: float, top: int, key: str = "doc_id") -> str:
    """SQL of a, b, rank, similarity from the slots m, by comparing all rows."""
    return f"""sigs AS (SELECT {key}, list(v ORDER BY k) AS s FROM m GROUP BY 1), c AS (SELECT s, row_number() OVER () AS cl, list_sort(list({key})) AS ids FROM sigs GROUP BY s),
    x AS (SELECT cl, unnest(s) AS v, unnest(range(128)) AS k FROM c), n AS (SELECT p.cl AS p, q.cl AS q, count(*) / 128.0::DOUBLE AS similarity FROM x p JOIN x q USING (k, v) GROUP BY 1, 2 HAVING count(*) >= {least} * 128),
    y AS (SELECT p, unnest(ids[1:{top + 1}]) AS b, similarity FROM n JOIN c ON cl = q), z AS (SELECT unnest(ids) AS a, cl FROM c),
    r AS (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM z JOIN y ON p = cl AND a <> b)
    SELECT a, b, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= {top}"""


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return sm.signatures(words(spark, sf).where("size(tokens) > 0"), "doc_id", "tokens")


@query("lsh_01_hash_family", f"WITH {FAMILY}, t AS (SELECT DISTINCT unnest({WORDS}) AS token FROM documents), h AS (SELECT {HASH} AS h FROM t) SELECT k, min((a * h + b) % 2147483647) AS least, max((a * h + b) % 2147483647) AS greatest FROM h, f GROUP BY k")
def hash_family(spark: SparkSession, sf: str) -> DataFrame:
    """What each function of the family makes of all tokens of the corpus: the least and the greatest value."""
    t = words(spark, sf).select(F.explode("tokens").alias("token")).distinct().select(sm.token_hash(F.col("token")).alias("h"))
    values = [(F.lit(a) * F.col("h") + F.lit(b)) % sm.PRIME for a, b in zip(*sm.family(), strict=True)]
    g = t.agg(*(f(v).alias(f"{n}{k}") for k, v in enumerate(values) for n, f in (("l", F.min), ("g", F.max))))
    return g.select(F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"l{k}").alias("least"), F.col(f"g{k}").alias("greatest")) for k in range(sm.PERMUTATIONS)))))


@query("lsh_03_minhash", f"WITH {FAMILY}, {signed(DOCS)} SELECT doc_id, list(v ORDER BY k) AS signature FROM m GROUP BY doc_id")
def minhash(spark: SparkSession, sf: str) -> DataFrame:
    return signatures(spark, sf).select("doc_id", "signature")


@query("lsh_04_bands", f"""WITH {FAMILY}, {signed(DOCS)}, b AS (SELECT doc_id, k // 8 AS band, list(v ORDER BY k) AS value FROM m GROUP BY 1, 2), n AS (SELECT band, value, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT band::INT AS band, count(*) AS buckets, sum(n)::BIGINT AS documents FROM n GROUP BY band""")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a band's key, by band; a test compares the keys with a plain model."""
    b = signatures(spark, sf).select(F.posexplode("bands").alias("band", "value"))
    return b.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("band").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("documents"))


@query("lsh_08_similar_documents", f"WITH {FAMILY}, {signed(DOCS)}, {best(0.7, 10)}")
def similar(spark: SparkSession, sf: str) -> DataFrame:
    """For each document the ten most similar by signature, similarity >= .7: all of them, as by comparing all."""
    return sm.band_join(signatures(spark, sf), "doc_id").select("a", "b", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


PROBE = """p AS (SELECT doc_id, k // 8 AS band, list(v ORDER BY k) AS value FROM m GROUP BY 1, 2), hits AS (SELECT DISTINCT a.doc_id AS query_id, b.doc_id FROM p a JOIN p b USING (band, value)
    WHERE a.doc_id % 20 = 0 AND (b.doc_id % 3 > 0 OR b.doc_id % 4 = 0) AND b.doc_id % 5 > 0 AND a.doc_id <> b.doc_id)"""


@query("lsh_07_index", f"WITH {FAMILY}, {signed(DOCS)}, {PROBE} SELECT query_id, hits.doc_id, count(*) FILTER (x.v = y.v) / 128.0::DOUBLE AS similarity FROM hits JOIN m x ON x.doc_id = query_id JOIN m y ON y.doc_id = hits.doc_id AND y.k = x.k GROUP BY 1, 2 HAVING count(*) FILTER (x.v = y.v) >= 64")
def index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of two thirds of the documents, into which others go and from which some are taken; ids divisible by 20 ask."""
    s = save(signatures(spark, sf))
    held = sm.insert(sm.index(s.where("doc_id % 3 > 0"), "doc_id"), sm.index(s.where("doc_id % 4 = 0"), "doc_id"), "doc_id")
    held = sm.remove(held, s.where("doc_id % 5 = 0").select("doc_id"), "doc_id")
    return sm.probe(held, s.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), "query_id", "doc_id", 0.5)


@query("lsh_05_jaccard", f"""WITH {FAMILY}, {signed(DOCS)}, p AS (SELECT doc_id, k // 8 AS band, list(v ORDER BY k) AS value FROM m GROUP BY 1, 2), firsts AS (SELECT band, value, min(doc_id) AS first FROM p GROUP BY 1, 2),
    pairs AS (SELECT DISTINCT first, doc_id FROM p JOIN firsts USING (band, value) WHERE first <> doc_id), d AS ({DOCS}), e AS (SELECT first, pairs.doc_id, count(*) FILTER (x.v = y.v) / 128.0::DOUBLE AS estimate FROM pairs JOIN m x ON x.doc_id = first JOIN m y ON y.doc_id = pairs.doc_id AND y.k = x.k GROUP BY 1, 2)
    SELECT first, e.doc_id, round(estimate, 6) AS estimate, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM e JOIN d a ON a.doc_id = first JOIN d b ON b.doc_id = e.doc_id""")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated and true similarity of each document to the first of every bucket that it shares."""
    w = words(spark, sf).where("size(tokens) > 0")
    s = save(sm.signatures(w, "doc_id", "tokens"))
    b = s.select("doc_id", F.posexplode("bands").alias("band", "value"))
    pairs = b.join(b.groupBy("band", "value").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), ["band", "value"]).where("first != doc_id").select("first", "doc_id").distinct()
    told = s.select("doc_id", "signature").join(w, "doc_id")
    both = pairs.join(told, "doc_id").join(told.select(F.col("doc_id").alias("first"), F.col("signature").alias("s"), F.col("tokens").alias("t")), "first")
    return both.select("first", "doc_id", F.round(sm.agreement(F.col("signature"), F.col("s")), 6).alias("estimate"), F.round(sm.jaccard(F.col("tokens"), F.col("t")), 6).alias("jaccard"))


@query("lsh_06_signature_text", f"WITH {FAMILY}, {signed(DOCS)} SELECT doc_id, string_agg(printf('%08x', v), '' ORDER BY k) AS written, list(v ORDER BY k) AS parsed FROM m GROUP BY doc_id")
def signature_text(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures written as text, and parsed again from that."""
    s = signatures(spark, sf).select("doc_id", sm.to_text(F.col("signature")).alias("written"))
    return s.withColumn("parsed", sm.from_text(F.col("written")))


def versions(text: str) -> str:
    return f"SELECT doc_id, list_distinct(regexp_extract_all(lower({text}), '[A-Za-z0-9_]+')) AS w FROM documents"


@query("lsh_10_drift", f"""WITH {FAMILY}, {signed(versions("text"))}, {signed(versions("substr(text, 1, length(text) - 40)"), name="o")},
    d AS (SELECT m.doc_id, m.k // 8 AS band, bool_or(m.v <> coalesce(o.v, 0)) AS differs FROM m LEFT JOIN o ON o.doc_id = m.doc_id AND o.k = m.k GROUP BY 1, 2)
    SELECT doc_id, round(count(*) FILTER (differs) / 16.0::DOUBLE, 6) AS drift, count(*) FILTER (differs) / 16.0::DOUBLE < 0.3 AS stable FROM d GROUP BY doc_id""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    """Bands in which each document's signature differs from that of its version without the last 40 characters."""
    d = table(spark, sf, "documents")
    before = sm.word_set(F.expr("substring(text, 1, length(text) - 40)"))
    old = sm.signatures(d.select("doc_id", before.alias("tokens")), "doc_id", "tokens").select("doc_id", F.col("bands").alias("before"))
    now = signatures(spark, sf).select("doc_id", "bands").join(old, "doc_id")
    x = sm.drift(F.col("before"), F.col("bands"))
    return now.select("doc_id", F.round(x, 6).alias("drift"), (x < 0.3).alias("stable"))


@query("lsh_10_drifted", f"""WITH {FAMILY}, {signed(versions("text"))}, {signed(versions("substr(text, 1, length(text) - 40)"), name="o")},
    d AS (SELECT m.doc_id, m.k // 8 AS band, bool_or(m.v <> coalesce(o.v, 0)) AS differs FROM m LEFT JOIN o ON o.doc_id = m.doc_id AND o.k = m.k GROUP BY 1, 2) SELECT doc_id FROM d GROUP BY doc_id HAVING count(*) FILTER (differs) / 16.0::DOUBLE >= 0.3""")
def drifted(spark: SparkSession, sf: str) -> DataFrame:
    return drift(spark, sf).where(~F.col("stable")).select("doc_id")


@query("set_07_path_jaccard", "WITH c AS (SELECT c_custkey AS id, list_distinct(list(o_orderpriority)) AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT x.id, round(len(list_intersect(x.p, y.p)) / len(list_distinct(list_concat(x.p, y.p)))::DOUBLE, 6) AS jaccard FROM c x JOIN c y ON y.id = x.id + 1")
def path_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("p"))
    j = c.join(c.select((F.col("id") - 1).alias("id"), F.col("p").alias("q")), "id")
    return j.select("id", F.round(sm.jaccard(F.col("p"), F.col("q")), 6).alias("jaccard"))


@query("fn_10_tokenizers", f"SELECT doc_id, len({WORDS}) AS words, len(list_filter(list_distinct(regexp_split_to_array(lower(trim(text)), '[ \\t\\r\\n]+')), lambda t: t <> '')) AS spaced FROM documents")
def tokenizers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(sm.word_set(F.col("text"))).alias("words"), F.size(sm.space_set(F.col("text"))).alias("spaced"))


NAMES = "n AS (SELECT DISTINCT substr(lower(c_mktsegment), 1, 3) || (c_custkey % 300) AS name FROM customer)"


@query("joi_08_close_names", f"WITH {NAMES} SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 1")
def close_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").select(F.concat(F.substring(F.lower("c_mktsegment"), 1, 3), F.col("c_custkey") % 300).alias("name"))
    return sm.close_names(n, 1)


@query("fn_02_bounded_edit_distance", "WITH t AS (SELECT p_partkey, p_name, lead(p_name) OVER (ORDER BY p_partkey) AS q FROM part) SELECT p_partkey, CASE WHEN levenshtein(p_name, q) <= 5 THEN levenshtein(p_name, q) ELSE -1 END::INT AS distance FROM t WHERE q IS NOT NULL")
def edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    j = p.select("p_partkey", "p_name").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("q")), "p_partkey")
    return j.select("p_partkey", F.levenshtein("p_name", "q", 5).alias("distance"))


TYPOS = "t AS (SELECT 'standart' AS token UNION ALL SELECT 'promos' UNION ALL SELECT 'larg' UNION ALL SELECT 'zzzzzz'), v AS (SELECT DISTINCT lower(p_type) AS word FROM part)"


@query("top_10_fuzzy_token", f"WITH {TYPOS} SELECT token, word, round(1 - d / 3.0::DOUBLE, 6) AS confidence FROM (SELECT token, word, levenshtein(token, word) AS d, row_number() OVER (PARTITION BY token ORDER BY levenshtein(token, word), word) AS rn FROM t, v) WHERE rn = 1 AND d < 3")
def fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    t = F.broadcast(spark.createDataFrame([("standart",), ("promos",), ("larg",), ("zzzzzz",)], "token string"))  # the query's own tokens
    v = table(spark, sf, "part").select(F.lower("p_type").alias("word")).distinct()
    d = v.crossJoin(t).withColumn("d", F.levenshtein("token", "word", 2)).where("d >= 0")
    best = d.groupBy("token").agg(F.min(F.struct("d", "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("word"), F.round(1 - F.col("b.d") / 3.0, 6).alias("confidence"))


@query("lsh_09_feature_text", with_views("SELECT id, 'role:' || role || ' intent:' || intent || ' ' || array_to_string(list_transform(tags, lambda t: 'tag:' || t), ' ') || ' name:' || name AS feature_text FROM symbols", "symbols"))
def feature_text(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("tag:"), t)), " ")
    return symbols(spark, sf).select("id", F.concat_ws(" ", F.concat(F.lit("role:"), "role"), F.concat(F.lit("intent:"), "intent"), tags, F.concat(F.lit("name:"), "name")).alias("feature_text"))


@query("fn_58_band_mismatch", f"""WITH {FAMILY}, {signed(DOCS)}, p AS (SELECT doc_id, k // 8 AS band, list(v ORDER BY k) AS value FROM m GROUP BY 1, 2), pairs AS (SELECT l_orderkey, min(l_partkey % (SELECT count(*) FROM documents)) AS a, max(l_partkey % (SELECT count(*) FROM documents)) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(count(*) FILTER (x.value <> y.value) / 16.0::DOUBLE, 6) AS mismatch FROM pairs JOIN p x ON x.doc_id = a JOIN p y ON y.doc_id = b AND y.band = x.band GROUP BY l_orderkey""")
def band_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Bands that differ, place by place, for a pair of documents of each order."""
    n = table(spark, sf, "documents").count()
    pairs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_partkey") % n).alias("a"), F.max(F.col("l_partkey") % n).alias("b"))
    s = save(signatures(spark, sf).select("doc_id", "bands"))
    j = pairs.join(s.withColumnsRenamed({"doc_id": "a", "bands": "x"}), "a").join(s.withColumnsRenamed({"doc_id": "b", "bands": "y"}), "b")
    return j.select("l_orderkey", F.round(sm.drift(F.col("x"), F.col("y")), 6).alias("mismatch"))
