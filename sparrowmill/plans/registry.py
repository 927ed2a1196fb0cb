"""Queries by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"})


def query(key: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a plan over Views, and the SQL that gives the same rows where there is one.

    Engines hand out dates in different types, so results show them as text; `dates` names those of the SQL.
    """

    def register(plan: Callable[[Views], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: _dates_as_text(plan(Views(spark, sf_dir)))
        if sql:
            text = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates)
            SQL[key] = f"SELECT * REPLACE ({text}) FROM ({with_views(sql)})" if dates else with_views(sql)
        return plan

    return register
