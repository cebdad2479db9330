"""Classifications as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_class(src_kind: Column, dst_kind: Column, utility: Column) -> tuple[Column, Column]:
    """(class, forward weight) of an edge."""
    composition, inheritance = (src_kind == "class") & (dst_kind == "method"), (src_kind == "class") & (dst_kind == "class")
    cls = F.when(composition, "composition").when(inheritance, "inheritance").when(utility, "utility").otherwise("dependency")
    weight = F.when(composition, 0.9).when(inheritance, 0.85).when(utility, 0.3).otherwise(0.5)
    return cls, weight


def dissipation(cls: Column) -> Column:
    return F.when(cls == "utility", 0.7).otherwise(0.4)


def mode(isolated: Column, role: Column, field_role: Column, gravity: Column) -> Column:
    """The traversal that fits a node."""
    return F.when(isolated, "isolated").when(role == "sink", "reverse").when(field_role == "saddle", "saddle").when((field_role == "attractor") & (gravity >= 0.7), "reverse").when(field_role == "repeller", "field").otherwise("forward")


def field_role(energy: Column, mass: Column, friction: Column, terminal: Column) -> Column:
    attractor = ((energy > 5) & (mass < 2) & (friction < 0.3)) | (terminal & (energy > 2))
    return F.when(attractor, "attractor").when((energy < 1) & (mass > 5), "repeller").when((energy >= 2) & (mass <= 5), "saddle").otherwise("neutral")


def attractor_bias(utility: Column, terminal_exec: Column, terminal_tag: Column, i: Column, o: Column, rank: Column) -> tuple[Column, Column]:
    """(bias, basin)."""
    bias = F.when(utility, 0.0).when(terminal_exec, 0.3).when(terminal_tag, 0.21).otherwise(0.0)
    return bias, (i / (o + 1) > 2) & (i >= 3) & (o <= 20) & (rank <= 0.3)


def upstream_role(i: Column, o: Column, forward: Column, backward: Column) -> Column:
    return F.when((i > 5) & (o > 5), "CONVERTER").when((forward > 0.7) & (backward > 0.7), "CORE_ATTRACTOR").when(forward > 0.7, "EMITTER").when(backward > 0.7, "SINK").otherwise("TRANSIENT")


def cognitive_role(role: Column, c: Column, b: Column) -> tuple[Column, Column, Column]:
    hub, bridge, sink, leaf = (role == "hub") & (c > 0.7), (role == "bridge") & (b > 0.5), role == "sink", (role == "leaf") & (c < 0.3)
    pick = lambda *x: F.when(hub, x[0]).when(bridge, x[1]).when(sink, x[2]).when(leaf, x[3]).otherwise(x[4])
    return (
        pick("query_anchor", "system_critical_connector", "data_aggregation_point", "safe_to_ignore", "moderate_importance"),
        pick("high_visibility", "modification_risk_high", "safe_to_modify", "low_priority", "safe_to_modify"),
        pick("prefer_as_anchor", "prefer_as_anchor", "neutral", "avoid_as_entry", "neutral"),
    )


def stability(tau: Column, noise: Column) -> tuple[Column, Column]:
    core, stable = (tau > 0.8) & (noise < 0.2), (tau > 0.5) & (noise < 0.5)
    return F.when(core, "core_invariant").when(stable, "stable").otherwise("volatile"), F.when(core, "low").when(stable, "medium").otherwise("high")


def impact(c: Column, b: Column) -> Column:
    return F.when((c > 0.7) | (b > 0.7), "high").when((c > 0.4) | (b > 0.4), "medium").otherwise("low")


def affordances(role: Column, c: Column, b: Column, tau: Column, frequency: Column, couplings: Column) -> Column:
    rules = {
        "entry_point": (role == "hub") & (c > 0.7) & (frequency > 100), "debug_anchor": (b > 0.6) & (tau > 0.7), "workflow_orchestrator": (role == "hub") & (couplings >= 2),
        "safe_refactor": (role == "leaf") & (tau > 0.7) & (c < 0.3), "data_transformer": (role == "sink") & (c > 0.4), "critical_bridge": (role == "bridge") & (b > 0.7),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def archetype(hub: Column, sink: Column, bridge: Column, leaf: Column) -> Column:
    return F.when(hub > 0.4, "radiation").when(sink > 0.4, "convergence").when((hub > 0.2) & (sink > 0.2), "transitional").when(bridge > 0.3, "chain").when(leaf > 0.5, "fanout").otherwise("transitional")


def level(x: Column, high: float, medium: float) -> Column:
    return F.when(x > high, "high").when(x > medium, "medium").otherwise("low")


def size_tier(n: Column) -> Column:
    return F.when(n >= 1000, "XL").when(n >= 500, "L").when(n >= 100, "M").otherwise("S")


def node_type(kind: Column) -> Column:
    return F.when(kind.isin("class", "interface", "module", "protocol"), "container").otherwise("executor")


def heal(trust: Column, delta: Column) -> Column:
    """A repair is taken if it doesn't lower trust, or by little where there is enough of it."""
    return F.when(delta >= 0, "accept").when(trust < 0.5, "reject").when((trust < 0.7) & (delta < -0.05), "reject").when((trust >= 0.7) & (delta < -0.01), "review").otherwise("accept")


def grade(x: Column) -> Column:
    return F.when(x >= 0.9, "A").when(x >= 0.8, "B").when(x >= 0.7, "C").when(x >= 0.6, "D").otherwise("F")
