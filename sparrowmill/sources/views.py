"""Domain views over the given tables: transactions, articles, customers, web events, sessions, series and others.

A view is one SELECT that Spark and any ANSI engine read alike, so results can be compared on equal inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import io

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "tx": "SELECT o_custkey AS customer_id, l_partkey AS article_id, CAST(o_orderdate AS DATE) AS t_dat, l_extendedprice AS price, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sales_channel_id, l_orderkey * 10 + l_linenumber AS line_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "art": "SELECT p_partkey AS article_id, p_name AS prod_name, p_type AS product_group_name, p_brand AS index_name, p_size AS section, p_retailprice AS list_price FROM part",
    "cust": "SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS age, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS club_member_status, c_nationkey AS postal_code FROM customer",
    "vec": "SELECT vec_id AS article_id, embedding, label FROM embeddings",
    "ev": "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, ts FROM events",
    "sess": "SELECT user_id AS session, event_id % 97 AS aid, event_id AS ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS type FROM events",
    "inter": "SELECT o_custkey AS user_id, o_orderkey % 200 AS item_id, CAST(o_orderkey AS BIGINT) AS time, o_orderkey AS row_id FROM orders",
    "ser": "SELECT c_mktsegment AS unique_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "abt": "SELECT d.doc_id AS i_doc_id, d.n_chars AS n_chars, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.doc_id % 50 END AS n_gap, d.lang AS c_lang, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.source END AS c_source, l.quality AS y_quality, (d.doc_id * 37 % 1000) / 1000.0E0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "prod": "SELECT l_orderkey AS g, l_linenumber AS n, l_partkey AS item, l_quantity AS q FROM lineitem",
}

#: The tables that a view joins and the keys by which they are dealt to tasks, when they are large.
JOINED = {"tx": {"orders": "o_orderkey", "lineitem": "l_orderkey"}}


class Views:
    """Tables and views of a folder as attributes, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._rows = spark, sf_dir, {}

    def rows(self, table: str) -> int:
        """Rows of a table, which the files' footers say."""
        if table not in self._rows:
            self._rows[table] = getattr(self, table).count()
        return self._rows[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        used = {t: getattr(self, t) for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])}
        dealt = JOINED.get(name, {})
        rows = max((self.rows(t) for t in dealt), default=0)
        used |= {t: io.spread(used[t], rows, key) for t, key in dealt.items()}
        text = re.sub(rf"(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", VIEWS[name])
        return self.spark.sql(text, **used)


def with_views(sql: str) -> str:
    """The query with the views it names defined before it."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b(?:FROM|JOIN|,) {n}\b", sql)]
    if not used:
        return sql
    if re.match(r"\s*WITH RECURSIVE\b", sql):
        return f"WITH RECURSIVE {', '.join(used)}, {sql.strip()[15:]}"
    return f"WITH {', '.join(used)}, {sql.strip()[5:]}" if re.match(r"\s*WITH\b", sql) else f"WITH {', '.join(used)} {sql}"
