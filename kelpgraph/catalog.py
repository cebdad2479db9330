"""All graph, log and text queries by name, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

FLAGSHIP = "str_09_manifold_state"
MODULES = ["graph", "traversal", "fields", "regions", "similarity", "rules", "logs", "sources", "written", "more", "extra"]


def _load() -> None:
    for m in MODULES:
        import_module(f"kelpgraph.queries.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
