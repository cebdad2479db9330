"""Mixing sources to target weights, in DataFrame operations alone.

Method. Leaves are (domain, language, source). The token budget goes down the tree: at each node it is shared among the
children by weight, none getting more than its whole subtree can give (max_epochs times its tokens); what a full child
can't take goes to its siblings, and only what they can't take either has already been left to the node's own siblings,
because the node's capacity is the sum of theirs. A level is one window over its nodes sorted by capacity per weight.

A leaf takes whole epochs while its budget allows, then a prefix of one more, in an order seeded by epoch and document.
The prefix isn't a running sum over the leaf: documents fall into buckets by the first bits of their place in that
order, sums of buckets find the one where the budget ends, and only its documents are sorted. A leaf of n documents has
about sqrt(n) buckets of sqrt(n) documents, so neither sorting grows with the leaf as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Weights:
    """Integer weights of the nodes by name, one for names that aren't listed. The budget is tokens * share[0] / share[1]."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    share: tuple[int, int] = (3, 5)
    max_epochs: int = 2
    seed: int = 7


PRODUCTION = Weights({"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1})


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number that its name ends with, modulo 4; `other` without one."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("other"))


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(name == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """budget of each node from its parent's (column `total`), its weight and its capacity."""
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("weight")), name)
    whole = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("before", before).withColumn("after", after)
    nodes = nodes.withColumn("full", _wide(F.col("capacity")) * _wide(F.col("after")) <= _wide(F.col("total") - F.col("before")) * _wide(F.col("weight")))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    nodes = nodes.withColumn("left", left).withColumn("rest", rest)
    nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("cast(left as decimal(20,0)) * cast(weight as decimal(10,0)) div cast(rest as decimal(18,0))").cast("long")))
    return nodes.drop("before", "after", "full", "left", "rest")


def budgets(leaves: DataFrame, weights: Weights) -> DataFrame:
    """domain, lang, source, tokens, budget of the leaves (rows of domain, lang, source, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * weights.max_epochs).withColumn("weight", _weight(F.col("source"), weights.sources, weights.other))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col("lang"), weights.langs, weights.other))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col("domain"), weights.domains, weights.other))
    every = Window.partitionBy(F.lit(0))
    whole = F.sum("capacity").over(every)
    domains = domains.withColumn("whole", whole).withColumn("total", F.expr(f"least(whole, cast(whole div {weights.max_epochs} as decimal(20,0)) * {weights.share[0]} div {weights.share[1]})").cast("long")).drop("whole")
    domains = _share(domains, ["total"], "domain")
    langs = _share(langs.join(domains.select("domain", F.col("budget").alias("total")), "domain"), ["domain"], "lang")
    leaves = _share(leaves.join(langs.select("domain", "lang", F.col("budget").alias("total")), ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.select("domain", "lang", "source", "tokens", "budget")


def place(seed: int, epoch: Column, doc: Column) -> Column:
    """The document's place in an epoch's order: 60 bits of md5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(documents: DataFrame, weights: Weights = PRODUCTION, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The chosen documents: id, domain, lang, source, n_tokens and copies (epochs that take it, times repeated rows).

    Tokens are words. A leaf's prefix ends with the first document that reaches its budget, so it may pass it by part of
    one document; budgets are whole numbers, rounded down. A null lang or source is `unknown` (its domain `other`).
    Documents without words (null, empty) give no tokens and are not chosen. Repeated rows of equal id, leaf and length
    are one row of the result, whose copies count them all. Ties in the order go to the smaller id (null first).
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in (lang_col, source_col))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), domain_of(F.col(source_col)).alias("domain"), lang.alias("lang"), source.alias("source"), n_words(F.col(text_col)).alias("n_tokens"))
    rows = save(rows.where("n_tokens > 0").groupBy("doc_id", "domain", "lang", "source", "n_tokens").agg(F.count(F.lit(1)).alias("times")))
    leaf = ["domain", "lang", "source"]
    mass = F.col("n_tokens") * F.col("times")
    leaves = save(rows.groupBy(*leaf).agg(F.sum(mass).alias("tokens"), F.count(F.lit(1)).alias("docs")))
    plan = budgets(leaves.drop("docs"), weights).join(leaves.select(*leaf, F.ceil(F.log2("docs") / 2).cast("int").alias("bits")), leaf)
    plan = plan.withColumn("epochs", F.expr("budget div tokens")).withColumn("want", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = save(plan)
    placed = rows.join(plan.select(*leaf, "epochs", "want", "bits"), leaf).withColumn("place", place(weights.seed, F.col("epochs"), F.col("doc_id")))
    placed = placed.withColumn("bucket", F.expr("shiftright(place, 60 - bits)"))
    sums = placed.groupBy(*leaf, "want", "bucket").agg(F.sum(mass).alias("mass"))
    reached = F.sum("mass").over(Window.partitionBy(*leaf).orderBy("bucket"))
    ends = sums.withColumn("reached", reached).where("want > 0 and reached >= want").groupBy(*leaf).agg(F.min_by(F.struct("bucket", (F.col("reached") - F.col("mass")).alias("before")), "bucket").alias("end"))
    ends = save(ends.select(*leaf, "end.bucket", "end.before")).withColumnRenamed("bucket", "last")
    placed = placed.join(ends, leaf, "left")
    inside = placed.where(F.col("bucket") == F.col("last"))
    ahead = F.coalesce(F.sum(mass).over(Window.partitionBy(*leaf).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    missing = F.col("want") - F.col("before") - F.col("ahead")
    part = F.least(F.col("times"), F.greatest(F.lit(0), F.ceil(missing / F.col("n_tokens")))).cast("long")
    inside = inside.withColumn("ahead", ahead).withColumn("part", part).drop("ahead")
    outside = placed.where((F.col("bucket") != F.col("last")) | F.col("last").isNull()).withColumn("part", F.when(F.col("bucket") < F.col("last"), F.col("times")).otherwise(F.lit(0)).cast("long"))
    out = inside.unionByName(outside).withColumn("copies", F.col("epochs") * F.col("times") + F.col("part"))
    return out.where("copies > 0").select(F.col("doc_id").alias(id_col), *leaf, "n_tokens", "copies")


def oracle(weights: Weights = PRODUCTION) -> str:
    """The same in DuckDB SQL."""

    def case(name: str, known: dict[str, int]) -> str:
        return f"CASE {name} " + "".join(f"WHEN '{k}' THEN {w} " for k, w in known.items()) + f"ELSE {weights.other} END" if known else str(weights.other)

    def share(nodes: str, parent: str, name: str, keep: str) -> str:
        return f"""SELECT {keep}, CASE WHEN fits THEN capacity ELSE ((total - coalesce(sum(capacity) FILTER (fits) OVER (PARTITION BY {parent}), 0)) * weight
            // sum(weight) FILTER (NOT fits) OVER (PARTITION BY {parent}))::BIGINT END AS budget
            FROM (SELECT *, capacity * sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (total - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS fits FROM ({nodes}))"""

    langs = f"SELECT l.*, b.budget AS total FROM langs l JOIN domain_budget b USING (domain)"  # noqa: F541
    leaves = "SELECT l.*, b.budget AS total FROM leaves l JOIN lang_budget b USING (domain, lang)"
    return f"""WITH rows_ AS (
        SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4)::VARCHAR, 'other') AS domain,
            coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, count(*)::BIGINT AS times FROM documents GROUP BY ALL),
    kept AS (SELECT * FROM rows_ WHERE n_tokens > 0),
    leaves AS (SELECT domain, lang, source, sum(n_tokens * times)::HUGEINT AS tokens, sum(n_tokens * times)::HUGEINT * {weights.max_epochs} AS capacity, {case("source", weights.sources)} AS weight FROM kept GROUP BY ALL),
    langs AS (SELECT domain, lang, sum(capacity) AS capacity, {case("lang", weights.langs)} AS weight FROM leaves GROUP BY ALL),
    domains AS (SELECT domain, sum(capacity) AS capacity, {case("domain", weights.domains)} AS weight FROM langs GROUP BY ALL),
    whole AS (SELECT least(sum(capacity), sum(capacity) // {weights.max_epochs} * {weights.share[0]} // {weights.share[1]}) AS total FROM domains),
    domain_budget AS ({share("SELECT * FROM domains, whole", "total", "domain", "domain")}),
    lang_budget AS ({share(langs, "domain", "lang", "domain, lang")}),
    leaf_budget AS ({share(leaves, "domain, lang", "source", "domain, lang, source, tokens")}),
    placed AS (SELECT k.*, budget // tokens AS epochs, budget % tokens AS want,
        ('0x' || substr(md5('{weights.seed}:' || (budget // tokens)::BIGINT::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM kept k JOIN leaf_budget USING (domain, lang, source)),
    ahead AS (SELECT *, coalesce(sum(n_tokens * times) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed)
    SELECT doc_id, domain, lang, source, n_tokens, (epochs * times + least(times, greatest(0, (want - ahead + n_tokens - 1) // n_tokens)))::BIGINT AS copies
    FROM ahead WHERE epochs * times + least(times, greatest(0, (want - ahead + n_tokens - 1) // n_tokens)) > 0"""
