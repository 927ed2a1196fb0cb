"""Plans over interaction graphs: users (customers), items (200 groups of orders), times (order keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, tables
from .registry import query
from .relational import REFINED


@query("gr_extract_tx", "SELECT session AS customer_id, aid || '_' || type AS article_id, ts AS \"timestamp\" FROM sess")
def _(v):
    return graph.extract_transactions(v.sess)


@query("gr_extract_entities", "SELECT DISTINCT aid || '_' || type AS article_id FROM sess")
def _(v):
    return graph.entities(graph.extract_transactions(v.sess), "article_id")


@query("gr_preprocess", "SELECT customer_id AS user_id, article_id AS item_id, CAST(epoch(t_dat) AS BIGINT) AS time FROM tx WHERE sales_channel_id = 1 UNION ALL SELECT customer_id, article_id, CAST(epoch(t_dat) AS BIGINT) FROM tx WHERE sales_channel_id = 2")
def _(v):
    tx = v.tx.select("customer_id", "article_id", F.col("t_dat").alias("date"), "sales_channel_id")
    return graph.preprocess(tx.where("sales_channel_id = 1"), None, tx.where("sales_channel_id = 2"))


@query("gr_map_ids", "SELECT row_id, u.idx AS user_id, i.idx AS item_id FROM inter JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM inter)) u ON inter.user_id = u.user_id JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM inter)) i ON inter.item_id = i.item_id")
def _(v):
    mapped, _, _ = graph.map_ids(v.inter.select("user_id", "item_id", F.col("row_id").alias("time")))
    return mapped.select(F.col("time").alias("row_id"), "user_id", "item_id")


@query("gr_build_edges", f"{REFINED} SELECT user_id, item_id, last AS time, row_id, row_number() OVER (PARTITION BY user_id ORDER BY last, row_id) - 1 AS \"order\", row_number() OVER (PARTITION BY item_id ORDER BY last, row_id) - 1 AS u_order FROM f")
def _(v):
    return graph.build_edges(v.inter.withColumn("time", F.floor(F.col("time") / 5000)), "row_id")


@query("gr_time_slice", "SELECT user_id, item_id, time FROM inter WHERE time >= 1000 AND time < 9000")
def _(v):
    return graph.time_slice(v.inter, 1000, 9000).select("user_id", "item_id", "time")


_TOP = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS r"


def _khop_sql(roots: str, key: str, items: int, users: int) -> str:
    """The steps of two hops around roots (key, u, until): w1, u1, w2 by key, user_id, item_id, time."""
    return f"""roots AS ({roots}),
    w1 AS (SELECT * FROM (SELECT {key}, u, until, e.user_id, e.item_id, e.time, {_TOP.format(by=key, order='e.time DESC, e.item_id DESC')} FROM roots JOIN inter e ON e.user_id = u AND e.time <= until) WHERE r <= {items}),
    u1 AS (SELECT * FROM (SELECT {key}, u, until, e.user_id, e.item_id, e.time, {_TOP.format(by=f'{key}, e.item_id', order='e.time DESC, e.user_id DESC')} FROM (SELECT DISTINCT {key}, u, until, item_id FROM w1) i JOIN inter e ON e.item_id = i.item_id AND e.time <= until) WHERE r <= {users}),
    f1 AS (SELECT * FROM (SELECT {key}, until, user_id, {_TOP.format(by=key, order='user_id DESC')} FROM (SELECT DISTINCT {key}, u, until, user_id FROM u1 WHERE user_id <> u)) WHERE r <= {users}),
    w2 AS (SELECT * FROM (SELECT {key}, until, e.user_id, e.item_id, e.time, {_TOP.format(by=f'{key}, e.user_id', order='e.time DESC, e.item_id DESC')} FROM f1 JOIN inter e ON e.user_id = f1.user_id AND e.time <= until) WHERE r <= {items})"""


def _found(key: str) -> str:
    return " UNION ".join(f"SELECT {key}, user_id, item_id, time FROM {x}" for x in ("w1", "u1", "w2"))


@query("gr_khop", f"WITH {_khop_sql('SELECT user_id AS root, user_id AS u, max(time) AS until FROM inter GROUP BY 1', 'root', 50, 50)} {_found('root')}")
def _(v):
    roots = v.inter.groupBy("user_id").agg(F.max("time").alias("until")).withColumn("root", F.col("user_id"))
    return graph.khop(v.inter, roots, ["root"], 2)


_STEPS = "SELECT root, n_items, root AS u, until FROM (SELECT user_id AS root, time AS until, CAST(row_number() OVER w AS INTEGER) AS n_items, lead(item_id) OVER w AS target FROM inter WINDOW w AS (PARTITION BY user_id ORDER BY time, item_id)) WHERE n_items >= 2 AND target IS NOT NULL"


@query("gr_prefix_graphs", f"WITH {_khop_sql(_STEPS, 'root, n_items', 5, 3)} {_found('root, n_items')}")
def _(v):
    return graph.sample_graphs(v.inter, 2, 5, 3)


_SPANS = f"""SELECT root, user_id, item_id, time, min(n_items) AS first, max(n_items) AS last FROM (SELECT *, n_items - row_number() OVER (PARTITION BY root, user_id, item_id, time ORDER BY n_items) AS run FROM ({_found('root, n_items')})) GROUP BY root, user_id, item_id, time, run"""


@query("gr_prefix_changes", f"WITH {_khop_sql(_STEPS, 'root, n_items', 50, 50)} {_SPANS}")
def _(v):
    return graph.prefix_changes(v.inter, 2)


@query("gr_user_samples_predict", "SELECT user_id, CAST(n AS INTEGER) AS n_items, CAST(0 AS BIGINT) AS target, s AS sequence FROM (SELECT user_id, count(*) AS n, array_to_string(list(item_id ORDER BY time, item_id) FILTER (WHERE r <= 50), ' ') AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, item_id DESC) AS r FROM inter) GROUP BY 1)")
def _(v):
    return graph.user_samples(v.inter, predict=True).withColumn("sequence", F.array_join(F.col("sequence").cast("array<string>"), " "))


@query("gr_user_samples", "SELECT user_id, CAST(n_items AS INTEGER) AS n_items, target, s AS sequence FROM (SELECT user_id, lead(item_id) OVER w AS target, row_number() OVER w AS n_items, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY time, item_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), ' ') AS s FROM inter WINDOW w AS (PARTITION BY user_id ORDER BY time, item_id)) WHERE n_items >= 2 AND target IS NOT NULL")
def _(v):
    return graph.user_samples(v.inter).withColumn("sequence", F.array_join(F.col("sequence").cast("array<string>"), " "))


@query("gr_split", "SELECT row_id, CASE WHEN b = 1 THEN 'predict' WHEN b = 2 THEN 'test' WHEN b = 3 AND n > 3 THEN 'val' ELSE 'train' END AS split FROM (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, item_id DESC) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM inter)")
def _(v):
    return graph.split(v.inter, True, True, True).select("row_id", "split")


@query("gr_negatives", "SELECT u.user_id, i.item_id FROM (SELECT DISTINCT user_id FROM inter) u CROSS JOIN (SELECT DISTINCT item_id FROM inter) i EXCEPT SELECT user_id, item_id FROM inter")
def _(v):
    return graph.negatives(v.inter)


_RING = "(CAST('0x' || substr(md5({c} || '|42'), 1, 8) AS BIGINT) * arcs) >> 32"


@query("gr_sample_neg", f"""WITH it AS (SELECT DISTINCT item_id FROM inter), ar AS (SELECT greatest(1, count(*) // 400) AS arcs FROM it), ring AS (SELECT item_id, {_RING.format(c="item_id")} AS arc FROM it, ar),
    met AS (SELECT DISTINCT user_id, item_id FROM inter), need AS (SELECT user_id, count(*) AS seen FROM met GROUP BY 1),
    vis AS (SELECT user_id, unnest(range(0, CAST(least(arcs - 1, ceil((seen + 100) / 200.0)) AS BIGINT) + 1)) AS k, {_RING.format(c="user_id")} AS at, arcs FROM need, ar),
    off AS (SELECT v.user_id, r.item_id, k FROM vis v JOIN ring r ON r.arc = (v.at + v.k) % v.arcs WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.user_id = v.user_id AND m.item_id = r.item_id))
    SELECT user_id, item_id FROM off QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k, md5(user_id || '|' || item_id || '|42'), item_id) <= 100""")
def _(v):
    return graph.sample_negatives(v.inter)


_ATTENTION = """WITH n AS (SELECT user_id, time, CAST(embedding AS DOUBLE[]) AS e FROM inter JOIN vec ON item_id = article_id), l AS (SELECT user_id, max_by(e, time) AS last FROM n GROUP BY 1),
    w AS (SELECT n.user_id, e, exp(list_dot_product(e, last) / sqrt(len(e))) AS w FROM n JOIN l ON n.user_id = l.user_id), x AS (SELECT user_id, e, w, unnest(range(1, 65)) AS pos FROM w)
    SELECT user_id, CAST(pos - 1 AS INTEGER) AS pos, round(sum(w * e[pos]) / sum(w), 4) + 0.0 AS x FROM x GROUP BY 1, 2"""


@query("gr_attn_last", _ATTENTION)
def _(v):
    met = v.inter.select("user_id", F.col("item_id").alias("article_id"), "time").join(v.vec, "article_id")
    pooled = graph.attention_last(met, "user_id", "embedding", "time", tables.width(v.vec, "embedding"))
    return pooled.select("user_id", F.posexplode("pooled").alias("pos", "x")).withColumn("x", F.round("x", 4) + F.lit(0.0))


def _lists(v):
    """Each user's ten most recent distinct items as a ranking."""
    last = v.inter.groupBy("user_id", "item_id").agg(F.max("time").alias("t"))
    return tables.top_lists(last, "user_id", "item_id", "t", 10)


_LISTS = "q AS (SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item_id) AS r FROM (SELECT user_id, item_id, max(time) AS t FROM inter GROUP BY 1, 2)) WHERE r <= 10)"


@query("gr_unmap", f"WITH {_LISTS} SELECT 'u' || user_id AS user_id, string_agg('i' || item_id, ' ' ORDER BY r) AS prediction FROM q GROUP BY 1")
def _(v):
    ids = lambda c, p: v.inter.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("original"), F.col(c).alias("idx")).distinct()
    return graph.unmap(_lists(v), ids("user_id", "u"), ids("item_id", "i")).withColumn("prediction", F.array_join("prediction", " "))


_BORDA = f"{_LISTS}, sz AS (SELECT user_id, count(*) AS n FROM q GROUP BY 1), bd AS (SELECT item_id, sum(n - r) AS score, min(q.user_id * 1000 + r) AS seen FROM q JOIN sz ON q.user_id = sz.user_id GROUP BY 1)"


@query("gr_borda", f"WITH {_BORDA} SELECT item_id AS item, CAST(score AS BIGINT) AS score FROM bd")
def _(v):
    return graph.borda(_lists(v)).select("item", "score")


_TOP20 = "tp AS (SELECT string_agg(item_id, ' ' ORDER BY score DESC, seen) AS items FROM (SELECT * FROM bd ORDER BY score DESC, seen LIMIT 20))"
_FULL = f"{_BORDA}, {_TOP20}, fl AS (SELECT user_id, string_agg(item_id, ' ' ORDER BY r) AS prediction FROM q GROUP BY 1 UNION ALL SELECT c_custkey, items FROM customer, tp WHERE c_custkey NOT IN (SELECT user_id FROM q))"


@query("gr_impute_missing", f"WITH {_FULL} SELECT user_id, prediction FROM fl")
def _(v):
    return graph.submission(_lists(v), v.customer.select(F.col("c_custkey").alias("user_id")))


@query("gr_submission", f"WITH {_FULL} SELECT user_id, prediction FROM fl WHERE user_id % 2 = 0")
def _(v):
    users = v.customer.select(F.col("c_custkey").alias("user_id"))
    return graph.submission(_lists(v), users, only=users.where("user_id % 2 = 0"))
