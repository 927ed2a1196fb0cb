"""The web-analytics session table: one pass for sessions, one for users, one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hour, lookup, weekday
from .frames import flag

DIMENSIONS = ("event_date", "browser", "os", "country", "source", "medium")


def _flat(events: DataFrame) -> DataFrame:
    return events.select(
        "user_pseudo_id", "event_date", "event_name", "event_timestamp",
        lookup("event_params", "ga_session_id").alias("session_id"), lookup("event_params", "engagement_time_msec").alias("engagement"),
        F.col("device.web_info.browser").alias("browser"), F.col("device.operating_system").alias("os"), F.col("geo.country").alias("country"),
        F.col("traffic_source.source").alias("source"), F.col("traffic_source.medium").alias("medium"),
    )


def session_rollup(events: DataFrame) -> DataFrame:
    """A row per visitor, session and dimensions: flags and start time, each a maximum."""
    is_event = lambda name: F.max(flag(F.col("event_name") == name))
    return _flat(events).groupBy("user_pseudo_id", "session_id", *DIMENSIONS).agg(
        is_event("first_visit").alias("n_new_visit"),
        is_event("add_to_cart").alias("y_add_to_cart"),
        F.max(F.when(F.col("event_name") == "session_start", F.col("event_timestamp"))).alias("start"),
        F.max("event_timestamp").alias("last"),
    )


def user_rollup(events: DataFrame) -> DataFrame:
    """A row per visitor: hits, page views, visits, and total time, which is a maximum."""
    return _flat(events).groupBy("user_pseudo_id").agg(
        F.count("*").alias("n_hits"),
        F.count_if(F.col("event_name") == "page_view").alias("n_page_views"),
        F.count_distinct("session_id").alias("n_visits"),
        F.max("engagement").alias("n_total_time"),
    )


def sessions(events: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Role-prefixed session table. sample_size: so many rows by hash order."""
    joined = session_rollup(events).join(user_rollup(events), "user_pseudo_id", "left")
    out = joined.select(
        F.col("user_pseudo_id").alias("i_visitor_id"), F.col("session_id").alias("i_session_id"), F.coalesce("start", "last").alias("i_visit_start_time"),
        F.col("event_date").alias("i_event_date"), F.col("browser").alias("c_browser"), F.col("os").alias("c_os"), F.col("country").alias("c_country"),
        F.col("source").alias("c_source"), F.col("medium").alias("c_medium"), "n_hits", "n_page_views", "n_visits", "n_total_time", "n_new_visit", "y_add_to_cart",
    )
    if sample_size is None:
        return out
    return out.orderBy(F.md5(F.concat_ws("|", F.col("i_visitor_id").cast("string"), F.col("i_session_id").cast("string"))), "i_visitor_id", "i_session_id").limit(sample_size)


def engineer(df: DataFrame, start: str = "i_visit_start_time") -> DataFrame:
    return df.withColumn("c_weekday", weekday(start)).withColumn("c_hour", hour(start))
