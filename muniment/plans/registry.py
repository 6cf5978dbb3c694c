"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable:
    """Decorator: registers a (spark, sf_dir) -> DataFrame function and the SQL it is checked with."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    from . import authority_queries, decision_queries, evidence_queries, graph_queries, model_queries, review_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
