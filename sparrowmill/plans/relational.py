"""Plans of scans, projections, filters, joins, aggregates, windows, sorts, sets, scalars and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import frames, quantiles, ranks, sampling, sessions, tables
from ..sources import io
from .registry import query

# Scans and sinks: tables are written to a folder that executors share and read back through the typed readers.


@query("src_csv_typed", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(v):
    path = io.scratch(v.spark, "csv")
    io.write_csv(v.customer, path)
    return io.read_csv(v.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_acctbal"])


@query("src_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(v):
    return io.read_parquet(v.spark, f"{v.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("src_json_nested", "SELECT user_id AS session, event_id AS aid, event_id * 10 AS ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS type FROM events")
def _(v):
    path = io.scratch(v.spark, "json")
    name = F.when(F.col("event_type") == "click", "clicks").when(F.col("event_type") == "view", "carts").when(F.col("event_type") == "purchase", "orders").otherwise("none")
    event = F.struct(F.col("event_id").alias("aid"), (F.col("event_id") * 10).alias("ts"), name.alias("type"))
    io.write_json(v.events.groupBy(F.col("user_id").alias("session")).agg(F.collect_list(event).alias("events")), path)
    return io.read_sessions(v.spark, path)


@query("src_chunked_csv", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(v):
    path = io.scratch(v.spark, "chunks")
    io.write_csv(v.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), path)
    return io.read_chunks(path, v.spark, "l_orderkey long, l_linenumber int, l_quantity double")


@query("src_sharded_table", "SELECT event_id, user_id FROM ev WHERE day BETWEEN (SELECT min(day) FROM ev) + 2 AND (SELECT min(day) FROM ev) + 9")
def _(v):
    path = io.scratch(v.spark, "days")
    io.write_parquet(v.ev.select("event_id", "user_id", F.col("day").alias("event_date")), path, ["event_date"])
    first = v.ev.agg(F.date_add(F.min("day"), 2).cast("string"), F.date_add(F.min("day"), 9).cast("string")).first()
    return io.read_days(v.spark, path, first[0], first[1]).select("event_id", "user_id")


@query("src_object_store", "SELECT p_partkey, p_name FROM part")
def _(v):
    # The tables' folder is another file system itself where a cluster names one by its scheme; else it is mounted as a store.
    store = v.sf_dir if "://" in v.sf_dir else io.mount(v.spark, "tables", v.sf_dir.strip("/").replace("/", "-"), v.sf_dir)
    return io.read_parquet(v.spark, f"{store}/part.parquet", ["p_partkey", "p_name"])


@query("snk_csv", "SELECT n_nationkey, n_name FROM nation")
def _(v):
    path = io.scratch(v.spark, "csv")
    io.write_csv(v.nation.select("n_nationkey", "n_name"), path)
    return io.read_csv(v.spark, path, "n_nationkey long, n_name string")


@query("snk_parquet", "SELECT customer_id, article_id, price FROM tx")
def _(v):
    path = io.scratch(v.spark, "parquet")
    io.write_parquet(v.tx.select("customer_id", "article_id", "price"), path)
    return v.spark.read.parquet(path)


@query("snk_layered", "SELECT article_id, count(*) AS n FROM tx GROUP BY article_id")
def _(v):
    layers = io.Layers(v.spark, io.scratch(v.spark, "layers"))
    raw = layers.write(v.tx.select("article_id"), 1, "tx")
    return layers.write(raw.groupBy("article_id").agg(F.count("*").alias("n")), 4, "counts")


@query("snk_json_metrics", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(v):
    path = io.scratch(v.spark, "metrics")
    io.write_json(v.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), path)
    return v.spark.read.schema("segment string, n long").json(path)


@query("snk_params", "SELECT 'mean' AS step, 'c_acctbal' AS \"column\", CAST(CAST(floor(avg(c_acctbal)) AS BIGINT) AS VARCHAR) AS value FROM customer")
def _(v):
    path = io.scratch(v.spark, "params")
    mean = v.customer.agg(F.floor(F.avg("c_acctbal"))).first()[0]
    io.save_params(v.spark, [("mean", "c_acctbal", str(mean))], path)
    return v.spark.createDataFrame(io.load_params(v.spark, path), "step string, column string, value string")


@query("snk_submission", "SELECT customer_id, string_agg(article_id, ' ' ORDER BY article_id) AS prediction FROM (SELECT DISTINCT customer_id, article_id FROM tx) GROUP BY customer_id")
def _(v):
    lists = v.tx.select("customer_id", "article_id").distinct().groupBy("customer_id").agg(F.array_sort(F.collect_list("article_id")).alias("items"))
    return io.submission(lists, "customer_id", "items")


# Projections and filters.


@query("prj_rename_map", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(v):
    return frames.rename(v.customer, {"c_custkey": "id", "c_name": "name", "absent": "x"}).select("id", "name")


@query("prj_roles", "SELECT i_doc_id, n_chars, n_gap, y_quality FROM abt")
def _(v):
    r = frames.roles(v.abt)
    return v.abt.select(*r["info"], *r["numeric"], *r["target"])


@query("prj_exclude", "SELECT n_nationkey, n_name FROM nation")
def _(v):
    return frames.exclude(v.nation, ["n_regionkey", "absent"])


@query("prj_keep_selected", "SELECT c_custkey, c_mktsegment FROM customer")
def _(v):
    return frames.keep_selected(v.customer, {"c_mktsegment", "c_custkey", "absent"})


@query("prj_clean_names", "SELECT r_regionkey AS rkey, r_name AS rname FROM region")
def _(v):
    return frames.clean_names(v.region.select(F.col("r_regionkey").alias("r<key>"), F.col("r_name").alias("[r]name")))


@query("prj_suffix", "SELECT c_custkey, c_acctbal AS c_acctbal_x, c_nationkey AS c_nationkey_x FROM customer")
def _(v):
    return frames.suffix(v.customer.select("c_custkey", "c_acctbal", "c_nationkey"), "_x", but="c_custkey")


@query("prj_force_types", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE) AS x, CAST(n_chars AS VARCHAR) AS c FROM documents")
def _(v):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    return frames.force_types(v.documents.select("doc_id", mixed.alias("x"), F.col("n_chars").alias("c")), ["x"], ["c"])


@query("prj_cast_category", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(v):
    return frames.cast_categories(v.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"])


@query("prj_narrow_types", "SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(v):
    return frames.narrow_types(v.orders.join(v.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_linenumber"))


@query("flt_date_cutoffs", "SELECT unique_id, ds, y FROM ser WHERE ds >= DATE '1993-01-01' AND ds <= DATE '1996-06-01'", dates=("ds",))
def _(v):
    return frames.date_cutoffs(v.ser, "1993-01-01", "1996-06-01")


@query("flt_last_n_days", "SELECT customer_id, article_id, t_dat FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 30", dates=("t_dat",))
def _(v):
    return frames.last_n_days(v.tx, "t_dat", 30).select("customer_id", "article_id", "t_dat")


@query("flt_last_n_weeks", "SELECT customer_id, article_id, t_dat FROM tx WHERE t_dat > (SELECT max(t_dat) FROM tx) - 28", dates=("t_dat",))
def _(v):
    return frames.last_n_weeks(v.tx, "t_dat", 4).select("customer_id", "article_id", "t_dat")


@query("flt_min_date", "SELECT customer_id, article_id FROM tx WHERE t_dat >= DATE '1996-01-01'")
def _(v):
    return frames.min_date(v.tx, "t_dat", "1996-01-01").select("customer_id", "article_id")


@query("flt_positive_negative", "SELECT i_doc_id, CASE WHEN y_quality > 0 THEN 'pos' ELSE 'neg' END AS side FROM abt")
def _(v):
    pos, neg = frames.positives_negatives(v.abt, "y_quality")
    return pos.select("i_doc_id", F.lit("pos").alias("side")).union(neg.select("i_doc_id", F.lit("neg").alias("side")))


@query("flt_case_flags", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bought, CASE WHEN event_type = 'signup' THEN 1 END AS joined FROM events")
def _(v):
    return v.events.select("event_id", frames.flag(F.col("event_type") == "purchase").alias("bought"), frames.flag(F.col("event_type") == "signup", None).alias("joined"))


@query("flt_predicted_label", "SELECT i_doc_id, score, CASE WHEN score > 0.4 THEN 1 ELSE 0 END AS predicted_label FROM abt")
def _(v):
    return frames.predicted_label(v.abt, "score", 0.4)


# Joins.


@query("jn_inner_key", "SELECT line_id, prod_name FROM tx JOIN art ON tx.article_id = art.article_id")
def _(v):
    return v.tx.join(v.art, "article_id").select("line_id", "prod_name")


@query("jn_inner_multi", "SELECT a.customer_id, a.article_id, a.n, b.spent FROM (SELECT customer_id, article_id, count(*) AS n FROM tx GROUP BY 1, 2) a JOIN (SELECT customer_id, article_id, round(sum(price), 2) AS spent FROM tx WHERE sales_channel_id = 1 GROUP BY 1, 2) b ON a.customer_id = b.customer_id AND a.article_id = b.article_id")
def _(v):
    keys = ["customer_id", "article_id"]
    tx = io.spread(v.tx, v.rows("lineitem"), *keys)  # nearly each row is a group, so both sides are dealt once, for groups and join
    n = tx.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(tx.where("sales_channel_id = 1").groupBy(*keys).agg(F.round(F.sum("price"), 2).alias("spent")), keys)


@query("jn_left_key", "SELECT c.customer_id, n.n, o.total FROM cust c LEFT JOIN (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1) n ON c.customer_id = n.customer_id LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c.customer_id = o.o_custkey")
def _(v):
    total = v.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tables.left_chain(v.cust.select("customer_id"), "customer_id", v.tx.groupBy("customer_id").agg(F.count("*").alias("n")), total)


@query("jn_left_multi_fill", "SELECT c.customer_id, c.article_id, coalesce(b.label, 0) AS label FROM (SELECT DISTINCT customer_id, article_id FROM tx) c LEFT JOIN (SELECT DISTINCT customer_id, article_id, 1 AS label FROM tx WHERE t_dat >= DATE '1997-01-01') b ON c.customer_id = b.customer_id AND c.article_id = b.article_id")
def _(v):
    pairs = v.tx.select("customer_id", "article_id").distinct()
    late = v.tx.where("t_dat >= date '1997-01-01'").select("customer_id", "article_id").distinct().withColumn("label", F.lit(1))
    return tables.left_fill(pairs, late, ["customer_id", "article_id"], "label")


@query("jn_left_diffnames", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10")
def _(v):
    few = v.nation.where("n_nationkey < 10")
    return v.customer.join(few, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("jn_using_chain", "SELECT user_id, hits, views, visits FROM (SELECT user_id, count(*) AS hits FROM events GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS visits FROM events GROUP BY 1) USING (user_id)")
def _(v):
    return v.spark.sql("SELECT user_id, hits, views, visits FROM (SELECT user_id, count(*) AS hits FROM {e} GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS views FROM {e} WHERE event_type = 'view' GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS visits FROM {e} GROUP BY 1) USING (user_id)", e=v.events)


@query("jn_unnest", "SELECT event_id, value AS engagement FROM events WHERE event_type <> 'error'")
def _(v):
    params = F.array(F.struct(F.lit("engagement").alias("key"), F.col("value").alias("value")), F.struct(F.lit("day").alias("key"), F.lit(1.0).alias("value")))
    return v.events.where("event_type <> 'error'").select("event_id", F.inline(params)).where("key = 'engagement'").select("event_id", F.col("value").alias("engagement"))


@query("jn_outer_on_index", "SELECT coalesce(a.article_id, b.article_id) AS article_id, a.n, b.dim FROM (SELECT article_id, count(*) AS n FROM tx GROUP BY 1) a FULL JOIN (SELECT article_id, label AS dim FROM vec) b ON a.article_id = b.article_id")
def _(v):
    return tables.outer_on("article_id", v.tx.groupBy("article_id").agg(F.count("*").alias("n")), v.vec.select("article_id", F.col("label").alias("dim")))


@query("jn_semi", "SELECT line_id FROM tx WHERE customer_id IN (SELECT customer_id FROM cust WHERE age > 5000)")
def _(v):
    return v.tx.join(v.cust.where("age > 5000"), "customer_id", "left_semi").select("line_id")


@query("jn_anti", "SELECT customer_id FROM cust WHERE customer_id NOT IN (SELECT customer_id FROM tx)")
def _(v):
    return v.cust.join(v.tx, "customer_id", "left_anti").select("customer_id")


@query("jn_lookup_map", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(v):
    df = v.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return tables.lookup(df, "nation", v.nation.select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), "k", "n_name")


@query("jn_broadcast_all", "SELECT customer_id, (SELECT string_agg(article_id, ' ' ORDER BY article_id) FROM (SELECT article_id FROM tx GROUP BY article_id ORDER BY count(*) DESC, article_id LIMIT 5)) AS items FROM cust")
def _(v):
    items = tables.most_sold(v.tx, "article_id", 5).agg(F.array_join(F.array_sort(F.collect_list("article_id")).cast("array<string>"), " ").alias("items"))
    return v.cust.select("customer_id").crossJoin(F.broadcast(items))


@query("jn_self_prod", "SELECT DISTINCT l.customer_id, a.article_id FROM (SELECT DISTINCT customer_id, index_name, section FROM tx JOIN art ON tx.article_id = art.article_id) l JOIN art a ON a.index_name = l.index_name AND a.section = l.section")
def _(v):
    items = v.art.withColumn("group", F.concat_ws("|", "index_name", "section"))
    return tables.through_attribute(v.tx, items, "customer_id", "article_id", "group")


# Aggregates.


@query("agg_sum_by", "SELECT c_mktsegment AS unique_id, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", dates=("ds",))
def _(v):
    joined = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("unique_id"), F.col("o_orderdate").cast("date").alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


@query("agg_sum_by_exo", "SELECT customer_id, t_dat, sales_channel_id, round(sum(price), 2) AS y FROM tx GROUP BY 1, 2, 3", dates=("t_dat",))
def _(v):
    return v.tx.groupBy("customer_id", "t_dat", "sales_channel_id").agg(F.round(F.sum("price"), 2).alias("y"))


@query("agg_count_rows", "SELECT article_id, count(*) AS n FROM tx GROUP BY 1")
def _(v):
    return v.tx.groupBy("article_id").agg(F.count("*").alias("n"))


@query("agg_count_nonnull", "SELECT postal_code, count(age) AS n FROM cust GROUP BY 1")
def _(v):
    return v.cust.groupBy("postal_code").agg(F.count("age").alias("n"))


@query("agg_countif", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1")
def _(v):
    return v.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"))


@query("agg_count_distinct", "SELECT customer_id, count(DISTINCT article_id) AS n FROM tx GROUP BY 1")
def _(v):
    return v.tx.groupBy("customer_id").agg(F.count_distinct("article_id").alias("n"))


@query("agg_distinct_then_count", "SELECT customer_id, count(*) AS n FROM (SELECT DISTINCT customer_id, product_group_name FROM tx JOIN art ON tx.article_id = art.article_id) GROUP BY 1")
def _(v):
    return tables.distinct_then_count(v.tx.join(v.art, "article_id"), ["customer_id", "product_group_name"], "customer_id", "n")


@query("agg_max_flags", "SELECT user_id, day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS joined, max(event_id) AS last_event FROM ev GROUP BY 1, 2", dates=("day",))
def _(v):
    is_event = lambda e: F.max(frames.flag(F.col("event_type") == e))
    return v.ev.groupBy("user_id", "day").agg(is_event("purchase").alias("bought"), is_event("signup").alias("joined"), F.max("event_id").alias("last_event"))


@query("agg_max_metric", "SELECT user_id, max(value) AS total_time FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(v):
    params = F.array(F.struct(F.lit("t").alias("key"), F.col("value").alias("value")))
    return v.events.select("user_id", F.inline(params)).where("value is not null").groupBy("user_id").agg(F.max("value").alias("total_time"))


@query("agg_min_max_days", "SELECT customer_id, (SELECT max(t_dat) FROM tx) - min(t_dat) AS days_since_first, (SELECT max(t_dat) FROM tx) - max(t_dat) AS days_since_last FROM tx GROUP BY 1")
def _(v):
    return tables.days_to_newest(v.tx, "customer_id", "t_dat")


@query("agg_mean_of_flag", "SELECT article_id, round(avg(CASE WHEN sales_channel_id = 1 THEN 1.0E0 ELSE 0 END), 6) AS offline FROM tx GROUP BY 1")
def _(v):
    return tables.share_of(v.tx, "article_id", F.col("sales_channel_id") == 1, "offline").withColumn("offline", F.round("offline", 6))


@query("agg_two_level", "SELECT article_id, round(avg(CASE WHEN n > 1 THEN 1.0E0 ELSE 0 END), 6) AS rebuy_share FROM (SELECT customer_id, article_id, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1")
def _(v):
    return tables.rebuy_share(v.tx, "customer_id", "article_id").withColumn("rebuy_share", F.round("rebuy_share", 6))


@query("agg_mean_price", "SELECT index_name, product_group_name, round(avg(price), 4) AS mean_price FROM tx JOIN art ON tx.article_id = art.article_id GROUP BY 1, 2")
def _(v):
    return v.tx.join(v.art, "article_id").groupBy("index_name", "product_group_name").agg(F.round(F.avg("price"), 4).alias("mean_price"))


@query("agg_multi_named", "SELECT session, count(*) AS n_events, round(avg(ts), 4) AS mean_ts, count(DISTINCT aid) AS n_items FROM sess GROUP BY 1")
def _(v):
    return v.sess.groupBy("session").agg(F.count("*").alias("n_events"), F.round(F.avg("ts"), 4).alias("mean_ts"), F.count_distinct("aid").alias("n_items"))


@query("agg_dfs", "SELECT article_id, round(sum(CASE WHEN t_dat >= m - 365 THEN price END), 2) AS sum_price_365_auto, round(median(CASE WHEN t_dat >= m - 365 THEN price END), 4) AS median_price_365_auto, count(CASE WHEN t_dat >= m - 365 THEN 1 END) AS count_365_auto, round(avg(price), 7) AS mean_price_auto, max(price) AS max_price_auto, min(price) AS min_price_auto, count(*) AS count_auto FROM tx, (SELECT max(t_dat) AS m FROM tx) GROUP BY 1")
def _(v):
    made = tables.deep_features(v.tx, "article_id", ["price"], "t_dat", [365, None], "auto")
    r = lambda c, n: F.round(c, n).alias(c)
    return made.select("article_id", r("sum_price_365_auto", 2), r("median_price_365_auto", 4), "count_365_auto", r("mean_price_auto", 7), "max_price_auto", "min_price_auto", "count_auto")


@query("agg_collect_list", "SELECT customer_id, string_agg(article_id, ' ' ORDER BY article_id) AS items FROM tx GROUP BY 1")
def _(v):
    return v.tx.groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_list("article_id")).cast("array<string>"), " ").alias("items"))


@query("agg_collect_set", "SELECT DISTINCT club_member_status, article_id FROM tx JOIN cust ON tx.customer_id = cust.customer_id")
def _(v):
    return v.tx.join(v.cust, "customer_id").select("club_member_status", "article_id").distinct()


@query("agg_value_counts", "SELECT y_quality, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM abt) AS DOUBLE), 6) AS share FROM abt GROUP BY 1")
def _(v):
    return tables.value_counts(v.abt, "y_quality").withColumn("share", F.round("share", 6))


@query("agg_global_stats", "SELECT count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items, min(article_id) AS min_item, max(article_id) AS max_item FROM tx")
def _(v):
    return v.tx.agg(F.count_distinct("customer_id").alias("n_users"), F.count_distinct("article_id").alias("n_items"), F.min("article_id").alias("min_item"), F.max("article_id").alias("max_item"))


@query("agg_label_by_group", "SELECT c_source, max(y_quality) AS label FROM abt GROUP BY 1")
def _(v):
    return v.abt.groupBy("c_source").agg(F.max("y_quality").alias("label"))


@query("agg_mean_vector", "SELECT customer_id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 5) + 0.0 AS m FROM (SELECT customer_id, embedding, unnest(range(1, 65)) AS pos FROM (SELECT DISTINCT customer_id, article_id FROM tx) t JOIN vec ON t.article_id = vec.article_id) GROUP BY 1, 2")
def _(v):
    bought = v.tx.select("customer_id", "article_id").distinct().join(v.vec, "article_id")
    return tables.mean_vector(bought, "customer_id", "embedding", width=tables.width(v.vec, "embedding")).select("customer_id", F.posexplode("mean_vector").alias("pos", "m")).withColumn("m", F.round("m", 5) + F.lit(0.0))


@query("agg_hist_stacked", "SELECT product_group_name, index_name, count(*) AS n FROM art GROUP BY 1, 2")
def _(v):
    return v.art.groupBy("product_group_name", "index_name").agg(F.count("*").alias("n"))


@query("agg_box_stats", "SELECT product_group_name, min(list_price) AS low, round(quantile_cont(list_price, 0.25), 4) AS q1, round(median(list_price), 4) AS mid, round(quantile_cont(list_price, 0.75), 4) AS q3, max(list_price) AS high FROM art GROUP BY 1")
def _(v):
    made = tables.box_stats(v.art, "product_group_name", "list_price")
    return made.withColumns({c: F.round(c, 4) for c in ("q1", "mid", "q3")})


@query("agg_profile", "SELECT 'age' AS \"column\", count(age) AS count, count(*) - count(age) AS nulls, count(DISTINCT age) AS n_distinct, min(age) AS min, max(age) AS max, round(avg(age), 4) AS mean, round(stddev_samp(age), 4) AS std, round(quantile_cont(age, 0.25), 4) AS q1, round(quantile_cont(age, 0.5), 4) AS q2, round(quantile_cont(age, 0.75), 4) AS q3 FROM cust UNION ALL SELECT 'postal_code', count(postal_code), count(*) - count(postal_code), count(DISTINCT postal_code), min(postal_code), max(postal_code), round(avg(postal_code), 4), round(stddev_samp(postal_code), 4), round(quantile_cont(postal_code, 0.25), 4), round(quantile_cont(postal_code, 0.5), 4), round(quantile_cont(postal_code, 0.75), 4) FROM cust")
def _(v):
    return tables.profile(v.cust, ["age", "postal_code"]).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "q2", "q3")})


@query("agg_profile_sketch")
def _(v):
    parts = quantiles.sketch_parts(v.tx, ["price", "article_id", "customer_id"], "t_dat")
    return quantiles.merged_profile(parts)


@query("ga_sessions", """SELECT user_id AS i_visitor_id, session_id AS i_session_id, CASE WHEN start IS NULL THEN last ELSE start END AS i_visit_start_time, event_date AS i_event_date, browser AS c_browser, os AS c_os, country AS c_country, source AS c_source, medium AS c_medium, n_hits, n_page_views, n_visits, n_total_time, n_new_visit, y_add_to_cart FROM (
    SELECT user_id, session_id, event_date, browser, os, country, source, medium, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS n_new_visit, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS y_add_to_cart, max(CASE WHEN event_type = 'error' THEN micros END) AS start, max(micros) AS last
    FROM (SELECT *, CAST(ts AS DATE) AS event_date, user_id * 1000 + day(ts) AS session_id, epoch_us(ts) AS micros, ['chrome', 'safari', 'firefox'][user_id % 3 + 1] AS browser, CASE WHEN user_id % 2 = 0 THEN 'linux' ELSE 'mac' END AS os, 'c' || (user_id % 5) AS country, CASE WHEN event_id % 4 = 0 THEN 'ad' ELSE 'direct' END AS source, 'm' AS medium FROM events) GROUP BY ALL) s
    LEFT JOIN (SELECT user_id, count(*) AS n_hits, count(*) FILTER (WHERE event_type = 'click') AS n_page_views, count(DISTINCT user_id * 1000 + day(ts)) AS n_visits, max(CAST(floor(value * 1000) AS BIGINT)) AS n_total_time FROM events GROUP BY 1) USING (user_id)""", dates=("i_event_date",))
def _(v):
    return sessions.sessions(web_events(v))


def web_events(v):
    """The events table in the nested shape of a web-analytics export."""
    names = F.create_map(*[F.lit(x) for x in ("error", "session_start", "signup", "first_visit", "view", "view_item", "purchase", "add_to_cart", "click", "page_view")])
    uid = F.col("user_id")
    param = lambda k, x: F.struct(F.lit(k).alias("key"), x.cast("long").alias("value"))
    return v.events.select(
        uid.alias("user_pseudo_id"), F.col("ts").cast("date").alias("event_date"), F.element_at(names, F.col("event_type")).alias("event_name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_timestamp"),
        F.array(param("ga_session_id", uid * 1000 + F.dayofmonth("ts")), param("engagement_time_msec", F.floor(F.col("value") * 1000))).alias("event_params"),
        F.struct(F.struct(F.element_at(F.array(F.lit("chrome"), F.lit("safari"), F.lit("firefox")), (uid % 3 + 1).cast("int")).alias("browser")).alias("web_info"), F.when(uid % 2 == 0, "linux").otherwise("mac").alias("operating_system")).alias("device"),
        F.struct(F.concat(F.lit("c"), (uid % 5).cast("string")).alias("country")).alias("geo"),
        F.struct(F.when(F.col("event_id") % 4 == 0, "ad").otherwise("direct").alias("source"), F.lit("m").alias("medium")).alias("traffic_source"),
    )


# Windows.


@query("win_head_per_group", "SELECT customer_id, line_id FROM tx QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, line_id DESC) <= 5")
def _(v):
    return tables.head_per_group(v.tx, "customer_id", [F.desc("t_dat"), F.desc("line_id")], 5).select("customer_id", "line_id")


@query("win_topk_by_score", "SELECT c_lang, string_agg(i_doc_id, ' ' ORDER BY r) AS prediction FROM (SELECT c_lang, i_doc_id, row_number() OVER (PARTITION BY c_lang ORDER BY score DESC, i_doc_id) AS r FROM abt) WHERE r <= 12 GROUP BY 1")
def _(v):
    return tables.top_lists(v.abt, "c_lang", "i_doc_id", "score", 12).select("c_lang", F.array_join(F.col("prediction").cast("array<string>"), " ").alias("prediction"))


@query("win_shift_gap", "SELECT customer_id, CAST(floor(avg(gap)) AS BIGINT) AS average_gap FROM (SELECT customer_id, t_dat - lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat) AS gap FROM (SELECT DISTINCT customer_id, t_dat FROM tx)) GROUP BY 1")
def _(v):
    return tables.average_gap(v.tx, "customer_id", "t_dat")


@query("win_transform_count", "SELECT line_id, count(*) OVER (PARTITION BY customer_id, article_id) AS n FROM tx")
def _(v):
    from pyspark.sql import Window as W

    return v.tx.select("line_id", F.count("*").over(W.partitionBy("customer_id", "article_id")).alias("n"))


@query("win_order_index", "SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY time, row_id) - 1 AS \"order\", row_number() OVER (PARTITION BY item_id ORDER BY time, row_id) - 1 AS u_order FROM inter")
def _(v):
    return tables.order_index(v.inter, "user_id", "item_id", "time", "row_id").select("row_id", "order", "u_order")


#: Times of `inter` in steps of 5000, made strictly increasing for each user, one event after the other.
REFINED = """WITH RECURSIVE o AS (SELECT *, time // 5000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY time // 5000, row_id) AS n FROM inter),
    f AS (SELECT user_id, n, row_id, item_id, t AS last, 1::BIGINT AS gap FROM o WHERE n = 1
          UNION ALL SELECT o.user_id, o.n, o.row_id, o.item_id, CASE WHEN o.t > f.last THEN o.t ELSE o.t + f.gap END, CASE WHEN o.t > f.last THEN f.gap ELSE f.gap + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)"""


@query("win_refine_time", f"{REFINED} SELECT user_id, item_id, last AS time, row_id FROM f")
def _(v):
    coarse = v.inter.withColumn("time", F.floor(F.col("time") / 5000))
    return tables.refine_times(coarse, "user_id", "time", "row_id")


@query("win_double_argsort", "SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, row_id DESC) - 1 AS recency FROM inter")
def _(v):
    return tables.recency_rank(v.inter, "user_id", "time", "row_id").select("row_id", "recency")


@query("win_seq_prefixes", "SELECT user_id, CAST(n_items AS INTEGER) AS n_items, target, s AS sequence FROM (SELECT user_id, lead(item_id) OVER w AS target, row_number() OVER w AS n_items, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY time, row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ' ') AS s FROM inter WINDOW w AS (PARTITION BY user_id ORDER BY time, row_id)) WHERE n_items >= 2 AND target IS NOT NULL")
def _(v):
    return tables.prefixes(v.inter, "user_id", "item_id", ["time", "row_id"], 10).withColumn("sequence", F.array_join(F.col("sequence").cast("array<string>"), " "))


@query("win_top_by_time", "SELECT item_id, user_id, time FROM inter QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY time DESC, row_id DESC) <= 20")
def _(v):
    return tables.head_per_group(v.inter, "item_id", [F.desc("time"), F.desc("row_id")], 20).select("item_id", "user_id", "time")


# Sorts and top-k.


@query("top_most_sold", "SELECT article_id, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, article_id LIMIT 20")
def _(v):
    return tables.most_sold(v.tx, "article_id", 20)


@query("top_test_periods", "SELECT DISTINCT ds FROM ser ORDER BY ds DESC LIMIT 3", dates=("ds",))
def _(v):
    return sampling.last_periods(v.ser, 3)


@query("top_random_sample", "SELECT customer_id FROM cust ORDER BY md5(customer_id || '|42'), customer_id LIMIT 50")
def _(v):
    return sampling.random_rows(v.cust, ["customer_id"], 50).select("customer_id")


@query("srt_importance", "SELECT section, n FROM (SELECT section, count(*) AS n FROM art GROUP BY 1) ORDER BY n DESC, section LIMIT 10")
def _(v):
    return v.art.groupBy("section").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(10)


@query("srt_argsort_items", "SELECT g, string_agg(item, ' ' ORDER BY q DESC, item) AS prediction FROM (SELECT g, item, max(q) AS q FROM prod GROUP BY 1, 2) GROUP BY 1")
def _(v):
    best = v.prod.groupBy("g", "item").agg(F.max("q").alias("q"))
    return tables.top_lists(best, "g", "item", "q", None).select("g", F.array_join(F.col("prediction").cast("array<string>"), " ").alias("prediction"))


# Sets.


@query("set_union_all", "SELECT customer_id FROM tx WHERE sales_channel_id = 1 UNION ALL SELECT customer_id FROM cust")
def _(v):
    return tables.union_all(v.tx.where("sales_channel_id = 1").select("customer_id"), v.cust.select("customer_id"))


@query("set_union_distinct", "SELECT article_id FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 7 UNION SELECT article_id FROM tx WHERE sales_channel_id = 1")
def _(v):
    return frames.last_n_days(v.tx, "t_dat", 7).select("article_id").union(v.tx.where("sales_channel_id = 1").select("article_id")).distinct()


@query("set_array_union", "SELECT g, string_agg(DISTINCT item, ' ' ORDER BY item) AS items FROM prod GROUP BY 1")
def _(v):
    lists = v.prod.groupBy("g").agg(F.collect_list(F.when(F.col("n") % 2 == 0, F.col("item"))).alias("a"), F.collect_list(F.when(F.col("n") % 2 == 1, F.col("item"))).alias("b"))
    a = F.when(F.size("a") > 0, F.col("a"))
    return lists.select("g", F.array_join(F.array_sort(fn.union_arrays(a, "b")).cast("array<string>"), " ").alias("items"))


@query("set_distinct_rows", "SELECT DISTINCT customer_id, article_id FROM tx")
def _(v):
    return v.tx.select("customer_id", "article_id").dropDuplicates()


@query("set_except_items", "SELECT u.user_id, i.item_id FROM (SELECT DISTINCT user_id FROM inter) u CROSS JOIN (SELECT DISTINCT item_id FROM inter) i EXCEPT SELECT user_id, item_id FROM inter")
def _(v):
    return tables.except_items(v.inter, v.inter, v.inter, "user_id", "item_id")


@query("set_diff_frontier", "SELECT DISTINCT user_id FROM inter WHERE time >= (SELECT max(time) // 2 FROM inter) EXCEPT SELECT user_id FROM inter WHERE time < (SELECT max(time) // 2 FROM inter)")
def _(v):
    half = v.inter.agg(F.max("time")).first()[0] // 2
    return v.inter.where(F.col("time") >= half).select("user_id").distinct().join(v.inter.where(F.col("time") < half), "user_id", "left_anti")


# Scalars.


@query("fn_weekday_hour", "SELECT event_id, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def _(v):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.events.select("event_id", fn.weekday(micros).alias("weekday"), fn.hour(micros).alias("hour"))


@query("fn_epoch_seconds", "SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS time FROM orders")
def _(v):
    return v.orders.select("o_orderkey", fn.epoch_seconds(F.col("o_orderdate").cast("date")).alias("time"))


@query("fn_date_arith", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS a, CAST(o_orderdate AS DATE) - 21 AS b FROM orders", dates=("a", "b"))
def _(v):
    d = F.col("o_orderdate").cast("date")
    return v.orders.select("o_orderkey", F.date_sub(d, 30).alias("a"), F.date_sub(d, 21).alias("b"))


@query("fn_days_between", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(v):
    return v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", fn.days_between(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))


@query("fn_to_datetime", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders", dates=("d",))
def _(v):
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return v.orders.select("o_orderkey", fn.parse_date(text).alias("d"))


@query("fn_try_numeric", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN '1.5' ELSE lang END AS DOUBLE) AS x FROM documents")
def _(v):
    return v.documents.select("doc_id", fn.try_numeric(F.when(F.col("doc_id") % 2 == 0, "1.5").otherwise(F.col("lang"))).alias("x"))


@query("fn_concat_key", "SELECT aid || '_' || type AS k, ts FROM sess")
def _(v):
    return v.sess.select(fn.concat_key("aid", "type").alias("k"), "ts")


@query("fn_zfill", "SELECT p_partkey, CASE WHEN length(CAST(p_size AS VARCHAR)) >= 2 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS code FROM part")
def _(v):
    return v.part.select("p_partkey", fn.zfill("p_size").alias("code"))


@query("fn_join_tokens", "SELECT g, string_agg(item, ' ' ORDER BY n, item) AS tokens FROM prod GROUP BY 1")
def _(v):
    return v.prod.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: s["item"].cast("string")), " ").alias("tokens"))


@query("fn_strip_ext", "SELECT page_id, split_part(url, '.', 1) AS id FROM pages")
def _(v):
    return v.pages.select("page_id", fn.strip_extension("url").alias("id"))


@query("fn_regex_cols", "SELECT customer_id, CAST(coalesce(n, 0) AS INTEGER) AS count_n, m AS other FROM cust LEFT JOIN (SELECT customer_id AS cid, count(*) AS n, max(article_id) AS m FROM tx WHERE sales_channel_id = 1 GROUP BY 1) ON customer_id = cid")
def _(v):
    few = v.tx.where("sales_channel_id = 1").groupBy("customer_id").agg(F.count("*").alias("count_n"), F.max("article_id").alias("other"))
    return frames.fill_counts(v.cust.select("customer_id").join(few, "customer_id", "left"))


@query("fn_bin_case", "SELECT customer_id, CASE WHEN n = 0 THEN '1' WHEN n <= 1 THEN '2' WHEN n <= 3 THEN '3' WHEN n <= 6 THEN '4' WHEN n <= 9 THEN '5' ELSE '6' END AS bin FROM (SELECT customer_id, count(DISTINCT t_dat) AS n FROM tx GROUP BY 1)")
def _(v):
    return v.tx.groupBy("customer_id").agg(F.count_distinct("t_dat").alias("n")).select("customer_id", fn.bin_case("n").alias("bin"))


@query("fn_explode_list", "SELECT DISTINCT customer_id, article_id FROM tx")
def _(v):
    return v.tx.groupBy("customer_id").agg(F.collect_set("article_id").alias("l")).select("customer_id", F.explode("l").alias("article_id"))


@query("fn_struct_field", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'linux' ELSE 'mac' END AS os FROM events")
def _(v):
    return v.events.select("event_id", F.struct(F.struct(F.when(F.col("user_id") % 2 == 0, "linux").otherwise("mac").alias("os")).alias("b")).alias("a")).select("event_id", F.col("a.b.os"))


@query("fn_array_lookup", "SELECT event_id, user_id * 1000 AS session FROM events")
def _(v):
    params = F.array(F.struct(F.lit("a").alias("key"), F.col("event_id").alias("value")), F.struct(F.lit("s").alias("key"), (F.col("user_id") * 1000).alias("value")))
    return v.events.select("event_id", params.alias("params")).select("event_id", fn.lookup("params", "s").alias("session"))


@query("fn_jaccard", "WITH p AS (SELECT g, list(DISTINCT item % 50) AS a, list(DISTINCT CAST(q AS BIGINT)) AS b FROM prod GROUP BY 1) SELECT g, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS j FROM p")
def _(v):
    sets = v.prod.groupBy("g").agg(F.collect_set(F.col("item") % 50).alias("a"), F.collect_set(F.col("q").cast("long")).alias("b"))
    return sets.select("g", F.round(fn.jaccard("a", "b"), 6).alias("j"))


_PAIR = "FROM vec a JOIN vec b ON a.article_id = b.article_id + 1"


@query("fn_cosine", f"SELECT a.article_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS c {_PAIR}")
def _(v):
    return _pairs(v).select("article_id", F.round(fn.cosine("embedding", "other"), 5).alias("c"))


def _pairs(v):
    return v.vec.join(v.vec.select((F.col("article_id") + 1).alias("article_id"), F.col("embedding").alias("other")), "article_id")


@query("fn_euclidean", f"SELECT a.article_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS d {_PAIR}")
def _(v):
    return _pairs(v).select("article_id", F.round(fn.euclidean("embedding", "other"), 5).alias("d"))


@query("fn_abs_norm_share", "SELECT c_nationkey, round(abs(sum(c_acctbal)) / (SELECT sum(abs(s)) FROM (SELECT sum(c_acctbal) AS s FROM customer GROUP BY c_nationkey)), 6) AS share FROM customer GROUP BY 1")
def _(v):
    sums = v.customer.groupBy("c_nationkey").agg(F.abs(F.sum("c_acctbal")).alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("t")))).select("c_nationkey", F.round(F.col("s") / F.col("t"), 6).alias("share"))


@query("fn_prompt", "SELECT doc_id, 'Explain: ' || text AS prompt FROM documents")
def _(v):
    return v.documents.select("doc_id", fn.prompt("text", "Explain: ").alias("prompt"))


# Splits and samples.


@query("spl_time_weeks", "SELECT line_id, CASE WHEN t_dat > m - 28 THEN 'val' ELSE 'train' END AS part FROM tx, (SELECT max(t_dat) AS m FROM tx) WHERE t_dat > m - 196")
def _(v):
    train, val = sampling.split_weeks(v.tx, "t_dat", 24, 4)
    return train.select("line_id", F.lit("train").alias("part")).union(val.select("line_id", F.lit("val").alias("part")))


@query("spl_last_periods", "SELECT unique_id, ds, CASE WHEN ds IN (SELECT DISTINCT ds FROM ser ORDER BY ds DESC LIMIT 4) THEN 'test' ELSE 'train' END AS part FROM ser", dates=("ds",))
def _(v):
    train, x, _ = sampling.split_periods(v.ser, 4)
    return train.select("unique_id", "ds", F.lit("train").alias("part")).union(x.select("unique_id", "ds", F.lit("test").alias("part")))


_RANKED = "row_number() OVER (PARTITION BY {s} ORDER BY md5({k} || '|42'), {k}) AS r, count(*) OVER (PARTITION BY {s}) AS n"


@query("spl_group_stratified", f"WITH g AS (SELECT customer_id, max(CASE WHEN price > 50000 THEN 1 ELSE 0 END) AS s FROM tx GROUP BY 1), r AS (SELECT customer_id, {_RANKED.format(s='s', k='customer_id')} FROM g) SELECT line_id, CASE WHEN r.r <= round(0.2 * r.n) THEN 'val' ELSE 'train' END AS part FROM tx JOIN r ON tx.customer_id = r.customer_id")
def _(v):
    train, val = sampling.split_groups(v.tx.withColumn("label", (F.col("price") > 50000).cast("int")), "customer_id", "label", 0.2)
    return train.select("line_id", F.lit("train").alias("part")).union(val.select("line_id", F.lit("val").alias("part")))


@query("spl_downsample_neg", "SELECT i_doc_id, y_quality FROM abt WHERE y_quality > 0 UNION ALL SELECT i_doc_id, y_quality FROM (SELECT * FROM abt WHERE y_quality = 0 ORDER BY md5(i_doc_id || '|42'), i_doc_id LIMIT 8)")
def _(v):
    return sampling.downsample_negatives(v.abt, ["i_doc_id"], 8, "y_quality").select("i_doc_id", "y_quality")


@query("smp_frac_rows", "SELECT line_id FROM tx WHERE CAST('0x' || substr(md5(line_id || '|42'), 1, 8) AS BIGINT) < 0.1 * 4294967296")
def _(v):
    return sampling.sample_rows(v.tx, ["line_id"], 0.1).select("line_id")


@query("smp_frac_keys", f"SELECT ts FROM sess WHERE session IN (SELECT session FROM (SELECT session, {_RANKED.format(s='1', k='session')} FROM (SELECT DISTINCT session FROM sess)) WHERE r <= floor(n * 0.3))")
def _(v):
    return sampling.sample_keys(v.sess, "session", 0.3).select("ts")


def _bins_sql(x: str, edges: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'nan' WHEN {x} >= {edges}[1] AND {x} <= {edges}[2] THEN '00' WHEN {x} > {edges}[2] AND {x} <= {edges}[3] THEN '01' WHEN {x} > {edges}[3] AND {x} <= {edges}[4] THEN '02' ELSE 'nan' END"


@query("smp_strat_quantile", f"WITH s AS (SELECT session, avg(ts) AS m FROM sess GROUP BY 1), e AS (SELECT quantile_cont(m, [0, 0.3333333333333333, 0.6666666666666666, 1]) AS q FROM s), b AS (SELECT session, {_bins_sql('m', 'q')} AS bin FROM s, e), r AS (SELECT session, bin, {_RANKED.format(s='bin', k='session')} FROM b) SELECT session, bin FROM r WHERE r <= round(0.25 * n)")
def _(v):
    keys = v.sess.groupBy("session").agg(F.avg("ts").alias("m"))
    edges = sampling.quantile_edges(keys, "m", 3)
    return sampling.sample_strata(keys.select("session", sampling.quantile_bin("m", edges).alias("bin")), "session", ["bin"], 0.25)


@query("smp_strat_customers", f"WITH t AS (SELECT customer_id AS cid, count(DISTINCT t_dat) AS n_tx FROM tx GROUP BY 1), s AS (SELECT customer_id, coalesce(age, (SELECT median(age) FROM cust)) AS a, coalesce(n_tx, 0) AS n_tx FROM cust LEFT JOIN t ON customer_id = cid), e AS (SELECT quantile_cont(a, [0, 0.3333333333333333, 0.6666666666666666, 1]) AS q FROM s), b AS (SELECT customer_id, {_bins_sql('a', 'q')} AS age_bin, CASE WHEN n_tx = 0 THEN '1' WHEN n_tx <= 1 THEN '2' WHEN n_tx <= 3 THEN '3' WHEN n_tx <= 6 THEN '4' WHEN n_tx <= 9 THEN '5' ELSE '6' END AS tx_bin FROM s, e), r AS (SELECT *, {_RANKED.format(s='age_bin, tx_bin', k='customer_id')} FROM b) SELECT customer_id, age_bin, tx_bin FROM r WHERE r <= round(0.2 * n)")
def _(v):
    (median,) = ranks.quantiles(v.cust, "age", [0.5])
    n = v.tx.groupBy("customer_id").agg(F.count_distinct("t_dat").alias("n_tx"))
    keys = v.cust.join(n, "customer_id", "left").select("customer_id", F.coalesce("age", F.lit(median)).alias("a"), F.coalesce("n_tx", F.lit(0)).alias("n_tx"))
    edges = sampling.quantile_edges(keys, "a", 3)
    binned = keys.select("customer_id", sampling.quantile_bin("a", edges).alias("age_bin"), fn.bin_case("n_tx").alias("tx_bin"))
    return sampling.sample_strata(binned, "customer_id", ["age_bin", "tx_bin"], 0.2)


@query("smp_strat_target", f"WITH f AS (SELECT least(1.0, 100 / CAST(count(*) AS DOUBLE)) AS f FROM abt), r AS (SELECT i_doc_id, y_quality, {_RANKED.format(s='y_quality', k='i_doc_id')} FROM abt) SELECT i_doc_id, y_quality FROM r, f WHERE r <= round(f * n)")
def _(v):
    return sampling.sample_target(v.abt, "i_doc_id", "y_quality", 100).select("i_doc_id", "y_quality")


@query("smp_filter_tx", "SELECT line_id FROM tx WHERE customer_id IN (SELECT customer_id FROM cust WHERE age > 3000) AND article_id IN (SELECT article_id FROM art WHERE section < 20)")
def _(v):
    return sampling.filter_transactions(v.tx, v.cust.where("age > 3000"), v.art.where("section < 20")).select("line_id")


@query("smp_n_series", "SELECT customer_id, line_id FROM tx WHERE customer_id IN (SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx) ORDER BY md5(customer_id || '|42'), customer_id LIMIT 10)")
def _(v):
    return sampling.n_series(v.tx, "customer_id").select("customer_id", "line_id")


@query("smp_one_strategy", "SELECT customer_id, article_id, s AS strategy FROM (SELECT DISTINCT customer_id, article_id, CASE WHEN sales_channel_id = 1 THEN 'a' ELSE 'b' END AS s FROM tx) QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY md5(customer_id || '|' || article_id || '|' || s || '|42'), s) = 1")
def _(v):
    named = v.tx.select("customer_id", "article_id", F.when(F.col("sales_channel_id") == 1, "a").otherwise("b").alias("strategy")).distinct()
    return sampling.one_strategy(named, ["customer_id", "article_id"], "strategy")


@query("bin_quantile", f"WITH e AS (SELECT quantile_cont(age, [0, 0.3333333333333333, 0.6666666666666666, 1]) AS q FROM cust) SELECT customer_id, {_bins_sql('age', 'q')} AS bin FROM cust, e")
def _(v):
    return v.cust.select("customer_id", sampling.quantile_bin("age", sampling.quantile_edges(v.cust, "age", 3)).alias("bin"))
