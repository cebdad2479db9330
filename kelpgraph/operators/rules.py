"""Gates, audits, refinement and policies over symbol tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roles
from ..tables import save
from .ranks import running_total

#: Intents by what a symbol calls, imports, its path, name and kind, in the order that decides ties.
INTENTS: dict[str, dict[str, list[str]]] = {
    "io": {"calls": ["open", "read", "write", "close", "readlines", "writelines"], "imports": ["io", "pathlib", "os.path", "shutil"]},
    "network": {"calls": ["get", "post", "put", "delete", "request", "connect", "send", "recv"], "imports": ["requests", "urllib", "http", "socket", "aiohttp", "httpx"]},
    "database": {"calls": ["execute", "query", "commit", "rollback", "fetchall", "fetchone"], "imports": ["sqlite3", "psycopg2", "sqlalchemy", "pymongo", "redis"]},
    "test": {"calls": ["assert", "assertEqual", "assertTrue", "assertFalse", "mock"], "imports": ["pytest", "unittest", "mock"], "path": ["test_", "tests/"]},
    "config": {"calls": ["load", "parse", "get_config", "read_config"], "imports": ["configparser", "yaml", "toml", "json", "dotenv"], "name": ["config", "settings", "env"]},
    "logging": {"calls": ["log", "debug", "info", "warning", "error", "critical"], "imports": ["logging", "loguru"]},
    "async": {"calls": ["await", "async"], "imports": ["asyncio", "aiofiles"], "kind": ["AsyncFunctionDef"]},
    "cli": {"calls": ["parse_args", "add_argument"], "imports": ["argparse", "click", "typer"]},
}
#: Roles of classes by name, methods and imports, in the order that decides ties.
ROLES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "controller": (["Controller", "Handler"], ["handle", "dispatch", "handle_request", "process_request"], []),
    "worker": (["Worker", "Task", "Job"], ["run", "execute", "process", "work"], ["threading", "multiprocessing", "asyncio"]),
    "adapter": (["Adapter", "Interface", "Bridge"], ["adapt", "convert", "transform"], []),
    "factory": (["Factory", "Builder", "Creator"], ["create", "build", "make", "construct"], []),
    "service": (["Service", "Manager", "Orchestrator"], ["execute", "process", "handle"], []),
    "repository": (["Repository", "Store", "DAO"], ["find", "save", "delete", "update", "get", "query"], []),
}
#: Attributes that say nothing about a symbol.
NOISE = ["logger", "log", "config", "debug", "info", "warn", "error", "__dict__", "self", "assert", "print", "exit"]
#: Boosts of the semantic score.
ROLE_BOOST = {"controller": 0.3, "service": 0.25, "repository": 0.2, "adapter": 0.15, "factory": 0.1, "worker": 0.1}
INTENT_BOOST = {"network": 0.2, "database": 0.2, "io": 0.15, "async": 0.15, "config": 0.1, "logging": 0.05, "cli": 0.05, "test": 0.0, "util": -0.1}
#: Edge weights by kind.
WEIGHTS = {"inherits": 1.0, "call": 0.8, "import": 0.5, "category": 0.5, "attr_access": 0.2, "semantic_similarity": 0.15}


def _texts(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def _has(word: str) -> Callable[[Column], Column]:
    return lambda x: x.contains(word)


def _any_in(items: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.exists(items, _has(p))
    return out


def _contains_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.contains(p)
    return out


def _count_in(items: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.exists(items, _has(p)).cast("int")
    return out


def _first_best(scores: dict[str, Column], least: float, other: Column) -> tuple[Column, Column]:
    best = F.greatest(*scores.values())
    name = other
    for k in reversed(scores):
        name = F.when((scores[k] >= best) & (best >= least), F.lit(k)).otherwise(name)
    return name, best


def intent(name: Column, kind: Column, path: Column, calls: Column, imports: Column) -> tuple[Column, Column]:
    """(intent, confidence): .4 for each call, .3 for each import found, .5 for each path and kind, .3 for each name; at
    most 1. With nothing found, a function of under three calls without outside imports is util with .5."""
    scores = {}
    for k, p in INTENTS.items():
        s = 0.4 * F.size(F.array_intersect(calls, _texts(p.get("calls", [])))) + 0.3 * _count_in(imports, p.get("imports", []))
        s = s + 0.5 * sum((path.contains(x).cast("int") for x in p.get("path", [])), F.lit(0)) + 0.3 * sum((F.lower(name).contains(x).cast("int") for x in p.get("name", [])), F.lit(0))
        s = s + 0.5 * kind.isin(p.get("kind", [])).cast("int") if p.get("kind") else s
        scores[k] = F.round(F.least(F.lit(1.0), s), 6)
    outside = F.exists(imports, lambda x: ~(x.startswith(".") | x.isin("typing", "dataclasses")))
    util = kind.isin("function", "method") & (F.size(calls) < 3) & ~outside
    found, best = _first_best(scores, 1e-9, F.when(util, "util").otherwise("Unknown"))
    return found, F.when(best > 0, best).when(util, 0.5).otherwise(0.0)


def class_role(name: Column, calls: Column, imports: Column, least: float = 0.3) -> tuple[Column, Column]:
    scores = {}
    for k, (names, methods, modules) in ROLES.items():
        s = 0.4 * _contains_any(name, names).cast("int") + 0.3 * F.arrays_overlap(calls, _texts(methods)).cast("int")
        scores[k] = F.round(s + 0.3 * _any_in(imports, modules).cast("int"), 6)
    return _first_best(scores, least, F.lit("unknown"))


def semantic_score(base: Column, role_tags: Column, intent_: Column, noisy: Column, fanout: Column, roles_: dict[str, float] | None = None, intents: dict[str, float] | None = None) -> Column:
    """Base and the greatest role boost and the intent's, less .4 for noise and .2 for a high fan-out; at least 0. The boosts
    are the fixed ones unless others are given."""
    roles_, intents = ROLE_BOOST if roles_ is None else roles_, INTENT_BOOST if intents is None else intents
    boost = F.greatest(*(F.when(F.array_contains(role_tags, k), F.lit(v)).otherwise(0.0) for k, v in roles_.items()))
    by = F.lit(0.0)
    for k, v in intents.items():
        by = F.when(intent_ == k, F.lit(v)).otherwise(by)
    return F.greatest(F.lit(0.0), base + boost + by - F.when(noisy, 0.4).otherwise(0.0) - F.when(fanout, 0.2).otherwise(0.0))


def refine(results: DataFrame, budget: int) -> DataFrame:
    """bucket and level of results (id, kind, layer, weight, is_noisy, tokens) within a budget of tokens.

    Noise under .8 goes; structural ones that are containers or of .8 and more are primary, other structural ones
    secondary, the rest related. In order of weight, results are kept until the first that passes the budget, itself kept.
    """
    r = results.where(~F.col("is_noisy") | (F.col("weight") >= 0.8))
    container = F.col("kind").isin("class", "interface", "protocol", "module")
    bucket = F.when((F.col("layer") == "structural") & (container | (F.col("weight") >= 0.8)), "primary").when(F.col("layer") == "structural", "secondary").otherwise("related")
    return cut_at(r.withColumn("bucket", bucket), budget, keep_first_over=True)


def cut_at(rows: DataFrame, budget: int, *, keep_first_over: bool) -> DataFrame:
    """Rows in order of weight (ties by id) while the sum of their tokens is within the budget."""
    inside = running_total(rows, "weight", "tokens", descending=True, ties="id")
    limit = F.col("upto") - F.col("tokens") <= budget if keep_first_over else F.col("upto") <= budget
    return inside.where(limit).drop("upto")


def top_by_intent(rows: DataFrame, k: int = 3) -> DataFrame:
    """Of each intent the k best with the group's total and place among the groups."""
    w = Window.partitionBy("intent")
    r = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k)
    total = r.groupBy("intent").agg(F.round(F.sum("score"), 6).alias("total"))
    total = total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "intent")))  # a row for each intent
    return r.join(total, "intent")


def payload(rank: Column) -> Column:
    return F.when(rank <= 5, "full").when(rank <= 20, "stripped").otherwise("none")


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(checks):
        out = F.when(checks[name], F.lit(name)).otherwise(out)
    return out


def symbol_gate(name: Column, blacklist: list[str]) -> Column:
    return first_failure({
        "blacklisted": name.isin(blacklist), "too_short": F.length(name) < 2, "private": name.startswith("_") & ~name.startswith("__"),
        "test": name.startswith("test_"), "lambda": name == "<lambda>",
    })


def cap_features(risk: Column, behaviour: Column, structure: Column, most: int = 100) -> Column:
    """Tags of a valid form without repeats: a third of them risk at most, half of the rest behaviour, then structure."""
    valid = lambda a: F.filter(F.array_distinct(a), lambda t: t.rlike("^[a-z0-9_]{2,50}$"))
    r = F.slice(valid(risk), 1, most // 3)
    b = F.slice(valid(behaviour), F.lit(1), ((most - F.size(r)) / 2).cast("int"))
    return F.concat(r, b, F.slice(valid(structure), F.lit(1), most - F.size(r) - F.size(b)))


def fix_plan(edges: DataFrame, names: DataFrame, most_out: int = 50) -> DataFrame:
    """fix, target, value: hubs of over most_out edges are to lose weight (x .3), weights over 1 to be clamped, and names
    one edit apart to be merged into the shorter."""
    from .similarity import close_names

    god = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_out).select(F.lit("downweight").alias("fix"), F.col("src").alias("target"), F.lit("0.3").alias("value"))
    over = edges.where("weight > 1").select(F.lit("clamp").alias("fix"), F.concat_ws(">", "src", "dst").alias("target"), F.lit("1.0").alias("value"))
    near = close_names(names, 1).select(F.lit("merge").alias("fix"), F.when(F.length("a") <= F.length("b"), F.col("b")).otherwise(F.col("a")).alias("target"), F.when(F.length("a") <= F.length("b"), F.col("a")).otherwise(F.col("b")).alias("value"))
    return god.unionByName(over).unionByName(near)


def without_applied(plan: DataFrame, applied: DataFrame, freeze: int = 3) -> DataFrame:
    """The plan without fixes already applied (by hash) and without targets changed `freeze` times."""
    p = plan.withColumn("hash", F.sha2(F.concat_ws("|", "fix", "target", "value"), 256)).join(applied.select("hash"), "hash", "left_anti")
    frozen = applied.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= freeze).select("target")
    return p.join(frozen, "target", "left_anti")


def upstream_trust(trust: DataFrame, edges: DataFrame) -> DataFrame:
    """id, trust: the least of a node's own and of those it depends on (unknown ones count as 1)."""
    d = edges.join(trust.select(F.col("id").alias("dst"), F.col("trust").alias("t")), "dst", "left")
    low = d.groupBy(F.col("src").alias("id")).agg(F.min(F.coalesce("t", F.lit(1.0))).alias("low"))
    return trust.join(low, "id", "left").select("id", F.least("trust", F.coalesce("low", F.lit(1.0))).alias("trust"))


def lock_rules(atoms: DataFrame) -> DataFrame:
    """thread, lock, failed: the first rule that a thread's operations on a lock break.

    atoms: thread, pos, op (ACQ, REL, AWT, RET), arg. Rules: as many releases as acquisitions; none released before it
    is held; no wait while holding.
    """
    held = F.sum(F.when(F.col("op") == "ACQ", 1).when(F.col("op") == "REL", -1).otherwise(0)).over(Window.partitionBy("thread", "arg").orderBy("pos"))
    locks = atoms.where(F.col("op").isin("ACQ", "REL")).withColumn("held", held)
    g = locks.groupBy("thread", F.col("arg").alias("lock")).agg(F.count_if(F.col("op") == "ACQ").alias("acq"), F.count_if(F.col("op") == "REL").alias("rel"), F.min("held").alias("low"))
    total = F.sum(F.when(F.col("op") == "ACQ", 1).when(F.col("op") == "REL", -1).otherwise(0)).over(Window.partitionBy("thread").orderBy("pos"))
    waits = atoms.withColumn("holding", total).where((F.col("op") == "AWT") & (F.col("holding") > 0)).select("thread", F.lit(True).alias("waits")).distinct()
    g = g.join(waits, "thread", "left")
    failed = first_failure({"released_before_held": F.col("low") < 0, "must_have_release": F.col("acq") > F.col("rel"), "unmatched_release": F.col("rel") > F.col("acq"), "waits_while_holding": F.coalesce("waits", F.lit(False))})
    return g.select("thread", "lock", failed.alias("failed"))


def deadlocks(order: DataFrame) -> DataFrame:
    """Pairs of locks taken in either order by two threads that share no third lock held before both.

    order: thread, first, then.
    """
    a, b = order.alias("a"), order.alias("b")
    both = a.join(b, (F.col("a.first") == F.col("b.then")) & (F.col("a.then") == F.col("b.first")) & (F.col("a.thread") < F.col("b.thread")))
    return both.select(F.col("a.thread").alias("thread_a"), F.col("b.thread").alias("thread_b"), F.col("a.first").alias("lock_a"), F.col("a.then").alias("lock_b"))


def lock_order(atoms: DataFrame) -> DataFrame:
    """thread, first, then: `then` is acquired while `first` is held."""
    acq = atoms.where("op = 'ACQ'").select("thread", F.col("arg").alias("first"), F.col("pos").alias("p"))
    rel = atoms.where("op = 'REL'").select("thread", F.col("arg").alias("first"), F.col("pos").alias("r"))
    after = acq.join(rel, ["thread", "first"]).where("r > p").groupBy("thread", "first", "p").agg(F.min("r").alias("r"))
    held = acq.join(after, ["thread", "first", "p"], "left")
    later = atoms.where("op = 'ACQ'").select("thread", F.col("arg").alias("then"), F.col("pos").alias("q"))
    return held.join(later, "thread").where("q > p and (r is null or q < r) and first != then").select("thread", "first", "then").distinct()


def node_kind_grade(avg: Column, isolated: Column, hashed: Column) -> Column:
    return F.when((avg >= 10) & (isolated < 10) & (hashed >= 90), "A").when((avg >= 5) & (isolated < 15) & (hashed >= 80), "B").when((avg >= 3) & (isolated < 20) & (hashed >= 70), "C").when((avg >= 1) & (isolated < 30), "D").otherwise("F")


heal = roles.heal


def with_edges(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) with others, which take the place of those between the same ends."""
    return edges.join(added.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight").unionByName(added)


def without_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id")
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "weight")


def resolved(tokens: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """token, status, id of distinct tokens (trimmed, lower): exact, alias, prefix or corrected (one edit) where one symbol
    fits at the first of these that any fits at, ambiguous where several do, not_found.

    names: id, name; aliases: name, id. Each step is for the tokens that the ones before have left. Prefixes and near names
    are found by equi-joins on what they have in common, which are told to shuffle: a name has many prefixes, which sizes
    that are estimated from its table don't show. Of the symbols that fit, the least and the greatest id tell whether they
    are one."""
    from .similarity import near_pairs

    n = names.select("id", F.lower("name").alias("name"))
    ends = F.min("id").alias("low"), F.max("id").alias("high")
    named = n.groupBy(F.col("name").alias("token")).agg(*ends)
    prefix = F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))
    prefixes = n.where("name is not null").select("id", F.explode(prefix).alias("token")).groupBy("token").agg(*ends)

    def near(t: DataFrame) -> DataFrame:
        pairs = near_pairs(t.withColumnRenamed("token", "a"), n.select(F.col("name").alias("b")), 1)
        fits = pairs.hint("merge").join(named.withColumnRenamed("token", "b"), "b")
        return fits.groupBy(F.col("a").alias("token")).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    steps = {
        "exact": lambda t: t.hint("merge").join(named, "token"),
        "alias": lambda t: t.hint("merge").join(aliases.groupBy(F.lower("name").alias("token")).agg(*ends), "token"),
        "prefix": lambda t: t.hint("merge").join(prefixes, "token"),
        "corrected": near,
    }
    rest, found = save(tokens.select(F.lower(F.trim("token")).alias("token")).distinct()), None
    for step, fit in steps.items():
        hit = save(fit(rest).select("token", F.when(F.col("low") != F.col("high"), "ambiguous").otherwise(step).alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("id")))
        found = hit if found is None else found.unionByName(hit)
        rest = save(rest.hint("merge").join(hit.select("token"), "token", "left_anti"))
    return found.unionByName(rest.select("token", F.lit("not_found").alias("status"), F.lit(None).cast(dict(hit.dtypes)["id"]).alias("id")))


def nearest(typed: DataFrame, names: DataFrame, k: int, most: int = 1) -> DataFrame:
    """typed, suggestion, distance: up to k names within so many edits, the nearest first (ties by name)."""
    from .similarity import near_pairs

    pairs = near_pairs(typed.select(F.col("typed").alias("a")), names.select(F.col("name").alias("b")), most)
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= k).select(F.col("a").alias("typed"), F.col("b").alias("suggestion"), "distance")


def most_alike(asked: DataFrame, rows: DataFrame, name: str, lanes: int = 64) -> DataFrame:
    """a, b, cosine: for each asked (a, x) the other row (b, y) of greatest cosine (to six digits; ties to the smaller b).

    A stated query set against all rows, in blocks: rows lie in lanes, every query goes to each, and a lane gives one row
    for a query."""
    from ..functions import energy as en

    met = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).join(rows.withColumn("lane", F.pmod(F.xxhash64("b"), F.lit(lanes)).cast("int")), "lane").where("a != b")
    cosine = F.round(2 * en.alignment(F.col("x"), F.col("y")) - 1, 6)
    best = met.groupBy("a").agg(F.min(F.struct((-cosine).alias("n"), "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"), (-F.col("m.n")).alias("cosine"))
