"""All queries of the library proper, by key, with their SQL."""

from __future__ import annotations

from .plans import forecasting, graphs, preparation, recommender, relational
from .plans.registry import QUERIES, SQL

MODULES = (relational, preparation, recommender, forecasting, graphs)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
