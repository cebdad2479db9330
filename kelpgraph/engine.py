"""The engine's queries over a stored graph: lookups, propagation, traversal, planning, roles and regions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import energy, roles
from .operators import fields, regions, rules
from .operators import structure as st
from .operators.similarity import band_join, signatures, word_set
from .plans import beam, planner
from .plans import propagation as pg
from .plans import traversal as tv
from .ship import ship
from .sources import scan
from .tables import save


@dataclass(frozen=True)
class Prune:
    """Limits of a query: least weight, hops, nodes and edges of a node."""

    least_weight: float = 0.05
    hops: int = 5
    nodes: int = 2000
    fanout: int = 200


PRESETS = {"default": Prune(), "conservative": Prune(0.1, 3, 1000, 100), "aggressive": Prune(0.01, 7, 5000, 500)}


@dataclass
class Engine:
    """nodes: id and any of name, kind, tags, intent, is_noisy, vector; edges: src, dst, kind, weight; aliases: name, id.

    Each method is a plan over these tables; loops write their rounds to the shared folder. The package goes to the
    executors when an engine is made.
    """

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame | None = None
    prune: Prune = field(default_factory=Prune)

    def __post_init__(self) -> None:
        ship(self.spark)

    @classmethod
    def scan_workspace(cls, spark: SparkSession, root: str, ignore: list[str] | None = None) -> Engine:
        """An engine over the symbols and references of a source tree."""
        ship(spark)
        rows = save(scan.features(scan.symbols(scan.files(spark, root, ignore))))
        nodes = scan.nodes(rows).withColumn("name", F.regexp_replace("id", "^(sym|cat)::", "")).withColumn("kind", F.coalesce(F.get_json_object("metadata", "$.kind"), F.lit("category")))
        places = scan.aliases(rows).select("name", F.concat(F.lit("sym::"), "name").alias("id")).distinct()
        return cls(spark, save(nodes.select("id", "name", "kind", "tags").withColumn("is_noisy", F.lit(False))), save(scan.edges(rows).drop("layer")), places)

    @cached_property
    def graph(self) -> DataFrame:
        """Edges normalised at hubs and pruned to the strongest of each node."""
        return save(st.strongest(st.normaliser(self.edges), self.prune.fanout))

    @cached_property
    def features(self) -> DataFrame:
        return save(st.states(self.edges))

    def _start(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    # lookups

    def get_symbol(self, ident: str) -> DataFrame:
        return self.nodes.where(F.col("id") == ident)

    def get_category(self, name: str) -> DataFrame:
        return self.edges.where(F.col("src") == f"cat::{name}").select(F.col("dst").alias("id"), "weight")

    def list_symbols(self, limit: int = 50) -> DataFrame:
        return self.nodes.where("id like 'sym::%'").orderBy("id").limit(limit)

    def list_categories(self, limit: int = 50) -> DataFrame:
        return self.edges.where("src like 'cat::%'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy("id").limit(limit)

    def get_stats(self) -> DataFrame:
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"))
        return n.crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("avg_weight")))  # one row each

    def resolve(self, token: str) -> DataFrame:
        """status (exact, alias, prefix, corrected, ambiguous, not_found) and id of a name."""
        t = token.strip().lower()
        base = self.nodes.select("id", F.lower(F.regexp_replace("id", "^(sym|cat)::", "")).alias("name"))
        rank = F.when(F.col("name") == t, 0).when(F.col("name").startswith(t), 2).when(F.levenshtein("name", F.lit(t), 2) >= 0, 3)
        found = base.select("id", rank.alias("rank"))
        if self.aliases is not None:
            found = found.unionByName(self.aliases.where(F.lower("name") == t).select("id", F.lit(1).alias("rank")))
        best = found.where("rank is not null").groupBy("rank").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).orderBy("rank")
        row = best.first()  # one row at most
        status = "not_found" if row is None else "ambiguous" if row.n > 1 else ("exact", "alias", "prefix", "corrected")[row["rank"]]
        return self.spark.createDataFrame([(status, row.id if row is not None and row.n == 1 else None)], "status string, id string")

    # propagation

    def query(self, start: str, *, tau: float = 0.05, soft: bool = True, bonus: Column | None = None, top_k: int = 100) -> DataFrame:
        """Best-path weights from a node; if a bonus leaves one node alone, again without it."""
        run = lambda b: save(pg.propagate(self.graph, self._start(start), tau=tau, soft=soft, bonus=b, top_k=top_k))
        out = run(bonus)
        return run(None) if bonus is not None and out.count() <= 1 else out

    def query_multi_tier(self, start: str) -> DataFrame:
        return pg.tiers(self.graph, self._start(start))

    def refined(self, start: str, budget: int = 4000) -> DataFrame:
        """query's results with their buckets, within a budget of tokens (a quarter of the row's JSON length)."""
        r = self.query(start).join(self.nodes.withColumnRenamed("id", "node"), "node")
        r = r.withColumn("tokens", (F.length(F.to_json(F.struct(*self.nodes.drop("id").columns))) / 4).cast("int")).withColumn("layer", F.lit("structural"))
        return rules.refine(r.withColumnRenamed("node", "id"), budget)

    # traversal

    def state(self, ident: str) -> DataFrame:
        """Degrees, gravity, role and the mode of traversal that fits a node."""
        f = self.features.where(F.col("id") == ident).withColumn("gravity", energy.gravity(F.col("in_degree")))
        f = f.withColumn("role", st.node_role(F.col("in_degree"), F.col("out_degree")))
        field_role = F.when(F.col("centrality") < 0.2, "repeller").otherwise("neutral")
        return f.withColumn("mode", roles.mode((F.col("in_degree") + F.col("out_degree")) == 0, F.col("role"), field_role, F.col("gravity")))

    def query_with_mode(self, start: str, mode: str | None = None, depth: int = 3) -> DataFrame:
        """node, depth by the mode that fits the node (forward or reverse), or the one that is asked for."""
        found = self.state(start).select("mode").first()
        mode = mode or (found.mode if found else "isolated")
        edges = tv.reverse(self.graph) if mode == "reverse" else self.graph
        return tv.bfs(edges, self._start(start), 0 if mode == "isolated" else depth)[0].select("node", "depth", F.lit(mode).alias("mode"))

    def find_upstream(self, *ids: str, hops: int = 2, k: int = 10) -> DataFrame:
        return tv.upstream(self.edges, self._start(*ids), self.features.select("id", F.col("centrality").alias("magnitude")), hops, k)

    def escape_sink(self, ident: str) -> DataFrame:
        """The best way out of a sink: a caller by weight, its betweenness and how spread its neighbours are."""
        e = self.edges.where(F.col("dst") == ident).join(self.features.select(F.col("id").alias("src"), "betweenness", "clustering"), "src")
        return e.select(F.col("src").alias("target"), (F.col("betweenness") * (1 - F.col("clustering")) * F.col("weight")).alias("score")).orderBy(F.desc("score"), "target").limit(1)

    def classify_role(self) -> DataFrame:
        f = self.features
        return f.select("id", roles.upstream_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness"))).alias("role"))

    def shortest_path(self, src: str, dst: str) -> DataFrame:
        return tv.shortest_path(tv.both_ways(self.edges), src, dst)

    # planning

    @cached_property
    def planned(self) -> DataFrame:
        """id, energy, friction, mass and vector of the nodes: their own vector, or five measures of the graph."""
        f = self.states().withColumn("mass", (F.col("in_degree") + F.col("out_degree")).cast("double"))
        if "vector" in self.nodes.columns:
            f = f.join(self.nodes.select("id", F.col("vector").cast("array<double>").alias("vector")), "id", "left")
        else:
            f = f.withColumn("vector", F.array(*(F.col(c).cast("double") for c in ("centrality", "betweenness", "clustering", "tau_persistence", "entry_variance"))))
        return save(f.select("id", "energy", "friction", "mass", "vector"))

    def costs(self, intent: list[float] | None = None) -> DataFrame:
        return save(planner.transition_costs(self.planned, self.edges, intent))

    def plan_trajectory(self, src: str, dst: str, hops: int = 20, intent: list[float] | None = None, avoid: list[str] | None = None) -> DataFrame:
        """The path of least transition cost: node, cost, hops, path. Nodes to avoid, and those of friction over 0.8, aren't entered."""
        barred = self.planned.where((F.col("friction") > 0.8) | F.col("id").isin(avoid or [])).select(F.col("id").alias("dst"))
        return pg.cheapest(save(self.costs(intent).join(barred, "dst", "left_anti")), self._start(src), hops=hops).where(F.col("node") == dst)

    def plan_alternatives(self, src: str, dst: str, k: int = 3, hops: int = 6) -> DataFrame:
        return pg.simple_paths(self.costs(), src, dst, hops=hops, k=k)

    def query_next_nodes(self, src: str, intent: list[float] | None = None, k: int = 5) -> DataFrame:
        """dst, cost of the neighbours that are cheapest to go to."""
        return self.costs(intent).where(F.col("src") == src).orderBy("cost", "dst").limit(k).select("dst", "cost")

    def explore(self, *ids: str, width: int = 5, depth: int = 5, intent: list[float] | None = None) -> DataFrame:
        """Beams from nodes through feasible states; without an intent, direction neither bars nor ranks."""
        states = self.planned if intent is not None else self.planned.withColumn("vector", F.lit(None).cast("array<double>"))
        return beam.explore(self.edges, planner.feasible(states, intent or [1.0]), self._start(*ids), width=width, steps=depth)

    # fields and regions

    def states(self) -> DataFrame:
        e = self.edges.select(F.col("src").alias("id"), "weight")
        return fields.with_energy(self.features, fields.entropy(e, "id", "weight", "ln"))

    def get_field_vector(self, ident: str) -> DataFrame:
        at = lambda k, name: F.coalesce(F.get("vector", F.lit(k)), F.lit(0.0)).alias(name)
        p = self.planned.select("id", "energy", at(0, "x"), at(1, "y"), at(2, "z"))
        return fields.gradient(p, self.edges).where(F.col("id") == ident)

    def detect_attractors(self, k: int = 20) -> DataFrame:
        return self.states().orderBy(F.desc("energy"), "id").limit(k).select("id", "energy", "friction")

    def get_semantic_centers(self) -> DataFrame:
        """region, size, and its entry points in order."""
        f = self.states()
        role, _ = st.topology_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness", "clustering")))
        r = f.withColumn("role", role).withColumn("region", F.concat_ws("/", "role", regions.energy_band(F.col("energy")).cast("string"))).withColumn("attractor", F.col("energy") > 5)
        r = save(r)
        size = r.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        entries = regions.entry_points(r).groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("entries"))
        return size.join(entries, "region", "left")

    def get_center_reachability(self, region: str, depth: int = 10, limit: int = 50) -> DataFrame:
        entries = self.get_semantic_centers().where(F.col("region") == region).select(F.explode(F.slice("entries", 1, 3)).alias("id"))
        visits, _ = tv.bfs(self.edges, entries, depth)
        return visits.groupBy("node").agg(F.min("depth").alias("depth")).where("depth > 0").orderBy("depth", "node").limit(limit)

    # similar names, and the phases as one run

    def similar(self, least: float = 0.7, k: int = 10) -> DataFrame:
        """a, b, similarity, rank of nodes by what their rows say."""
        words = word_set(F.concat_ws(" ", *(F.col(c).cast("string") for c in self.nodes.columns if c not in ("id", "vector"))))
        return band_join(signatures(self.nodes.select("id", words.alias("tokens")), "id", "tokens"), "id", least, k)

    def phases(self, depth: int = 3, tau: float = 0.05) -> dict[str, DataFrame]:
        """All phases in order, each written: events of a traversal from every source, states of the graph, their energies,
        regions with their energy, and centers with entry points."""
        starts = self.edges.select(F.col("src").alias("id")).distinct()
        events = save(tv.build_events(*tv.bfs(self.edges, starts, depth, tau=tau)))
        energies = save(self.states())
        role, _ = st.topology_role(*(F.col(c) for c in ("in_degree", "out_degree", "centrality", "betweenness", "clustering")))
        regions_ = energies.groupBy(F.concat_ws("/", role, regions.energy_band(F.col("energy")).cast("string")).alias("region")).agg(F.count(F.lit(1)).alias("size"), F.avg("energy").alias("energy"))
        return {"events": events, "states": self.features, "energies": energies, "field": save(regions_), "centers": save(self.get_semantic_centers())}
