"""Every query of the engine by name, with its SQL where SQL can say it."""

from __future__ import annotations

from tessella.plans import build_queries, engine_queries, graph_queries, order_queries, score_queries, series_queries, text_queries  # noqa: F401  they register themselves
from tessella.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
