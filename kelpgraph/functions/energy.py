"""Scalar formulas of mass, friction, energy and transitions, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def gravity(in_degree: Column) -> Column:
    return 1 / (1 + F.exp(-in_degree / 10.0))


def structural_mass(degree: Column, most: Column) -> Column:
    return F.least(F.lit(1.0), degree / (2.0 * most))


def structural_friction(complexity: Column) -> Column:
    return F.tanh(complexity / 10.0)


def cognitive_mass(i: Column, o: Column, modules: Column, all_modules: Column) -> Column:
    return F.log1p(i) * F.log1p(all_modules / (modules + 1)) * (1 + F.log1p(o))


def potential(centrality: Column, frequency: Column, tau: Column) -> Column:
    return 0.4 * F.log1p(1000 * centrality) + 0.3 * F.log1p(frequency) + 0.3 * tau * tau * tau


def soft_cap(energy: Column) -> Column:
    return 10 * F.tanh(energy / 10.0)


def adjusted_friction(friction: Column, energy: Column) -> Column:
    return clamp(friction * (1 - 0.3 * F.least(F.lit(1.0), energy / 10.0)), 0.0, 1.0)


def legacy_energy(gravity_: Column, heat: Column) -> Column:
    return 0.4 * (1 - gravity_) + 0.4 * heat


def runtime_energy(centrality: Column, frequency: Column, tau: Column, entropy: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.4 * centrality + 0.3 * F.least(F.lit(1.0), frequency / 1000.0) - 0.5 * tau + 0.2 * entropy)


def runtime_friction(tau: Column, noise: Column) -> Column:
    return F.least(F.lit(1.0), (1 - tau) * (1 + noise))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def alignment(a: Column, b: Column) -> Column:
    """The cosine moved to [0, 1]; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, (dot(a, b) / n + 1) / 2).otherwise(0.0)


def raw_alignment(a: Column, b: Column) -> Column:
    return clamp(dot(a, b), -1.0, 1.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def log_norm(d: Column) -> Column:
    return F.log1p(d) / F.log1p(F.lit(10.0))


def logistic_friction(f: Column) -> Column:
    return 1 / (1 + F.exp(-3 * (f - 0.5)))


def transition(uphill: Column, align: Column, friction: Column, dist: Column, intent: Column) -> Column:
    """Cost of a step: misalignment, friction, distance and rising energy, less the intent's pull; at least 0."""
    base = 0.35 * (1 - align) + 0.25 * logistic_friction(friction) + 0.15 * log_norm(dist) + 0.40 * F.greatest(F.lit(0.0), uphill) - 0.55 * intent
    return F.greatest(F.lit(0.0), base * (1 + 0.3 * friction))


def heuristic(dist: Column, align: Column, mass: Column, friction: Column) -> Column:
    hole = F.when((mass < 5) & (friction > 0.5), F.exp(3 * friction)).otherwise(1.0)
    return 1.3 * (0.15 * log_norm(dist) + 0.30 * (1 - align)) * hole


def transition_score(delta: Column, friction: Column, align: Column) -> Column:
    return 1 / (1 + F.exp(delta + 0.4 * friction + 0.8 * (1 - align)))


def escape_probability(gravity_: Column, mi: Column, noise: Column) -> Column:
    return gravity_ * mi * (1 - noise)


def floored(mass: Column, g: Column, s: Column, c: Column, b: Column, least: float = 0.001) -> tuple[Column, Column, Column]:
    """(potential, kinetic, magnitude) with floors."""
    pot = F.greatest(F.lit(least), mass * g * s)
    kin = F.greatest(F.lit(least), mass * (c + b) / 2 * s)
    return pot, kin, F.sqrt(pot * pot + kin * kin)


def mi_score(role: Column, mass: Column, magnitude: Column, penalty: Column) -> Column:
    base = F.when(role == "attractor", 0.8).when(role == "saddle", 0.5).when(role == "repeller", 0.3).otherwise(0.5)
    return clamp(base + F.least(F.lit(0.2), 0.5 * mass) + F.least(F.lit(0.1), 0.2 * magnitude) - penalty, 0.2, 1.0)


def mi_blend(seed: Column, rate: Column, n: Column) -> Column:
    omega = F.greatest(F.lit(0.1), 1 - n / 100.0)
    return F.round(omega * seed + (1 - omega) * rate, 4)


def edge_factor(mean: Column) -> Column:
    return F.round(clamp(0.5 + 0.5 * mean, 0.3, 1.0), 4)


def heat(commits: Column, lines: Column) -> Column:
    return F.round(0.6 * F.tanh(commits / 10.0) + 0.4 * F.tanh(lines / 100.0), 4)


def trust(f: Column, r: Column, u: Column, c: Column, drift: Column, verified: Column, cap: Column) -> Column:
    raw = (0.4 * f + 0.3 * r + 0.2 * u + 0.1 * c) * F.pow(drift, F.lit(4.0)) * F.when(verified, 1.0).otherwise(0.8)
    return F.round(F.least(raw, cap), 4)


def cumulative_barrier(delta: Column, friction: Column) -> Column:
    return F.greatest(F.lit(0.0), delta) + 0.5 * friction


def fitted(vector: Column, size: int) -> Column:
    """The vector cut to `size` components or continued with zeros; null for none."""
    return F.when(vector.isNotNull(), F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size))
