"""Plans of candidates, features, rankings and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, models, recs, sampling, tables
from ..sources import io
from .registry import query

LISTS = ["global_articles", "segment_articles", "previously_bought", "previously_bought_prod_name"]
_COUNTS = "(SELECT article_id, count(*) FILTER (WHERE t_dat >= m - 7) AS w0, count(*) FILTER (WHERE t_dat >= m - 30) AS w1, count(*) AS w2 FROM {src}, (SELECT max(t_dat) AS m FROM {src}) GROUP BY 1)"


def _popular_sql(src: str) -> str:
    c = _COUNTS.format(src=src)
    return " UNION ".join(f"(SELECT article_id FROM {c} WHERE w{i} > 0 ORDER BY w{i} DESC, article_id LIMIT {k})" for i, k in enumerate((100, 50, 25)))


def _string(df, column):
    return df.withColumn(column, F.array_join(F.array_sort(column).cast("array<string>"), " "))


@query("cand_global", f"SELECT customer_id, items AS global_articles FROM cust, (SELECT string_agg(article_id, ' ' ORDER BY article_id) AS items FROM ({_popular_sql('tx')}))")
def _(v):
    return _string(recs.popular_for_all(v.tx, v.cust), "global_articles")


_BIN = "CASE WHEN age IS NULL THEN 'nan' WHEN age >= q[1] AND age <= q[2] THEN '00' WHEN age > q[2] AND age <= q[3] THEN '01' WHEN age > q[3] AND age <= q[4] THEN '02' WHEN age > q[4] AND age <= q[5] THEN '03' ELSE 'nan' END"
_SEGMENT = f"""e AS (SELECT quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]) AS q FROM cust), b AS (SELECT customer_id, {_BIN} AS bin FROM cust, e),
    c AS (SELECT bin, article_id, count(*) FILTER (WHERE t_dat >= m - 7) AS w0, count(*) FILTER (WHERE t_dat >= m - 30) AS w1, count(*) AS w2 FROM tx JOIN b ON tx.customer_id = b.customer_id, (SELECT max(t_dat) AS m FROM tx WHERE customer_id IN (SELECT customer_id FROM cust)) GROUP BY 1, 2),
    s AS ({" UNION ".join(f"SELECT bin, article_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY w{i} DESC, article_id) AS r FROM c WHERE w{i} > 0) WHERE r <= {k}" for i, k in enumerate((50, 25, 15)))})"""


@query("cand_segment", f"WITH {_SEGMENT} SELECT customer_id, items AS segment_articles FROM b JOIN (SELECT bin, string_agg(article_id, ' ' ORDER BY article_id) AS items FROM s GROUP BY 1) l ON b.bin = l.bin")
def _(v):
    return _string(recs.segment_popular(v.tx, v.cust, sampling.quantile_edges(v.cust, "age", 4)), "segment_articles")


@query("cand_prev_bought", "SELECT customer_id, string_agg(article_id, ' ' ORDER BY article_id) AS previously_bought FROM (SELECT DISTINCT customer_id, article_id FROM tx) GROUP BY 1")
def _(v):
    return _string(recs.previously_bought(v.tx), "previously_bought")


def _named(v):
    """Articles whose product names are shared by a few: name and section."""
    return v.art.withColumn("prod_name", F.concat_ws("/", "prod_name", "section"))


@query("cand_prod_name", "SELECT customer_id, string_agg(article_id, ' ' ORDER BY article_id) AS previously_bought_prod_name FROM (SELECT DISTINCT t.customer_id, b.article_id FROM (SELECT DISTINCT customer_id, article_id FROM tx) t JOIN art a ON t.article_id = a.article_id JOIN art b ON a.prod_name = b.prod_name AND a.section = b.section) GROUP BY 1")
def _(v):
    return _string(recs.same_product_name(v.tx, _named(v)), "previously_bought_prod_name")


_DIST = "round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("knn_exact", "WITH d AS (SELECT a.article_id AS query, b.article_id AS item, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM vec a, vec b) SELECT query, item, CAST(r AS INTEGER) AS rank, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, item) AS r FROM d) WHERE r <= 5")
def _(v):
    return recs.nearest(v.vec, v.vec, 5).withColumn("distance", F.round("distance", 4))


_RECENT = "r AS (SELECT DISTINCT customer_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, line_id DESC, article_id DESC) AS n FROM tx) WHERE n <= {n})"


@query("cand_similar", f"WITH {_RECENT.format(n=5)}, d AS (SELECT a.article_id AS query, b.article_id AS item, row_number() OVER (PARTITION BY a.article_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.article_id) AS n FROM vec a, vec b WHERE a.article_id IN (SELECT article_id FROM r)) SELECT customer_id, string_agg(item, ' ' ORDER BY item) AS closest FROM (SELECT DISTINCT customer_id, item FROM r JOIN d ON r.article_id = d.query WHERE d.n <= 5 AND item <> query) GROUP BY 1")
def _(v):
    return _string(recs.similar(v.tx, v.vec, 5, 5), "closest")


def _wide(v, tx=None):
    tx = v.tx if tx is None else tx
    base = recs.popular_for_all(tx, v.cust, windows=(30, None), tops=(20, 10))
    segment = recs.segment_popular(tx, v.cust, sampling.quantile_edges(v.cust, "age", 4), windows=(30, None), tops=(15, 10))
    return recs.collect(base, segment, recs.previously_bought(tx))


_STRATEGIES = ["global_articles", "segment_articles", "previously_bought"]


def _pairs_sql(src: str) -> str:
    """All (customer, article, strategy) rows of the three strategies over a table of transactions."""
    return f"""m AS (SELECT max(t_dat) AS m FROM {src}), gc AS (SELECT article_id, count(*) FILTER (WHERE t_dat >= m - 30) AS w0, count(*) AS w1 FROM {src}, m GROUP BY 1),
    g AS ((SELECT article_id FROM gc WHERE w0 > 0 ORDER BY w0 DESC, article_id LIMIT 20) UNION (SELECT article_id FROM gc ORDER BY w1 DESC, article_id LIMIT 10)),
    e AS (SELECT quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]) AS q FROM cust), b AS (SELECT customer_id, {_BIN} AS bin FROM cust, e),
    sc AS (SELECT bin, article_id, count(*) FILTER (WHERE t_dat >= m - 30) AS w0, count(*) AS w1 FROM {src} x JOIN b ON x.customer_id = b.customer_id, m GROUP BY 1, 2),
    s AS (SELECT bin, article_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY w0 DESC, article_id) AS r FROM sc WHERE w0 > 0) WHERE r <= 15 UNION SELECT bin, article_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY w1 DESC, article_id) AS r FROM sc) WHERE r <= 10),
    c AS (SELECT customer_id, article_id, 'global_articles' AS strategy_name FROM cust, g UNION SELECT customer_id, article_id, 'segment_articles' FROM b JOIN s ON b.bin = s.bin UNION SELECT customer_id, article_id, 'previously_bought' FROM {src} WHERE customer_id IN (SELECT customer_id FROM cust))"""


@query("cand_collect", f"WITH {_pairs_sql('tx')} SELECT cust.customer_id, ng, ns, np FROM cust LEFT JOIN (SELECT customer_id, count(*) FILTER (WHERE strategy_name = 'global_articles') AS ng, nullif(count(*) FILTER (WHERE strategy_name = 'segment_articles'), 0) AS ns, nullif(count(*) FILTER (WHERE strategy_name = 'previously_bought'), 0) AS np FROM c GROUP BY 1) k ON cust.customer_id = k.customer_id")
def _(v):
    n = lambda c, a: F.when(F.col(c).isNotNull(), F.size(c).cast("long")).alias(a)
    return _wide(v).select("customer_id", n(_STRATEGIES[0], "ng"), n(_STRATEGIES[1], "ns"), n(_STRATEGIES[2], "np"))


@query("cand_unpack", f"WITH {_pairs_sql('tx')} SELECT customer_id, article_id, CASE WHEN count(*) > 1 THEN 'multiple_strategies' ELSE min(strategy_name) END AS strategy_name FROM c GROUP BY 1, 2")
def _(v):
    return recs.unpack(_wide(v), _STRATEGIES)


def _past_future(v):
    day = "date '1998-01-01'"
    return v.tx.where(f"t_dat < {day}"), v.tx.where(f"t_dat >= {day}")


_PAST = "p AS (SELECT * FROM tx WHERE t_dat < DATE '1998-01-01'), f AS (SELECT DISTINCT customer_id, article_id FROM tx WHERE t_dat >= DATE '1998-01-01'), "


@query("cand_recall", f"WITH {_PAST}{_pairs_sql('p')}, h AS (SELECT f.customer_id, f.article_id, max(CASE WHEN strategy_name = 'global_articles' THEN 1 ELSE 0 END) AS hg, max(CASE WHEN strategy_name = 'segment_articles' THEN 1 ELSE 0 END) AS hs, max(CASE WHEN strategy_name = 'previously_bought' THEN 1 ELSE 0 END) AS hp, max(CASE WHEN strategy_name IS NULL THEN 0 ELSE 1 END) AS ha FROM f LEFT JOIN c ON f.customer_id = c.customer_id AND f.article_id = c.article_id GROUP BY 1, 2) SELECT 'global_articles' AS strategy_name, round(avg(hg), 6) AS recall FROM h UNION ALL SELECT 'segment_articles', round(avg(hs), 6) FROM h UNION ALL SELECT 'previously_bought', round(avg(hp), 6) FROM h UNION ALL SELECT 'all_candidates', round(avg(ha), 6) FROM h")
def _(v):
    past, after = _past_future(v)
    return recs.recall(_wide(v, past), _STRATEGIES, after).withColumn("recall", F.round("recall", 6))


ATTRIBUTES = ["prod_name", "product_group_name", "index_name", "section"]
_SETS = "x AS (SELECT article_id, ['prod_name=' || prod_name, 'product_group_name=' || product_group_name, 'index_name=' || index_name, 'section=' || section] AS attributes FROM art)"


@query("feat_attr_sets", f"WITH {_SETS} SELECT article_id, array_to_string(list_sort(attributes), '|') AS attributes FROM x")
def _(v):
    return recs.attribute_sets(v.art, ATTRIBUTES).withColumn("attributes", F.array_join(F.array_sort("attributes"), "|"))


def _candidates(v):
    """Pairs of each customer with best sellers and own purchases."""
    top = tables.most_sold(v.tx, "article_id", 12).select("article_id")
    return recs.offered_and_bought(v.cust, top, v.tx).withColumn("strategy_name", F.lit("s"))


_CAND = "k AS (SELECT customer_id, article_id FROM cust, (SELECT article_id FROM tx GROUP BY 1 ORDER BY count(*) DESC, article_id LIMIT 12) UNION SELECT customer_id, article_id FROM tx)"


@query("feat_avg_jaccard", f"WITH {_CAND}, {_SETS}, {_RECENT.format(n=5)} SELECT k.customer_id, k.article_id, 's' AS strategy_name, round(coalesce(avg(len(list_intersect(a.attributes, b.attributes)) / CAST(len(list_distinct(list_concat(a.attributes, b.attributes))) AS DOUBLE)), 0), 5) AS articles_jaccard_similarity FROM k LEFT JOIN r ON k.customer_id = r.customer_id LEFT JOIN x a ON a.article_id = k.article_id LEFT JOIN x b ON b.article_id = r.article_id GROUP BY 1, 2")
def _(v):
    made = recs.average_jaccard(_candidates(v), v.tx, recs.attribute_sets(v.art, ATTRIBUTES))
    return made.withColumn("articles_jaccard_similarity", F.round("articles_jaccard_similarity", 5))


_VECTORS = f"{_RECENT.format(n=50)}, mv AS (SELECT customer_id, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM (SELECT customer_id, embedding, unnest(range(1, 65)) AS pos FROM r JOIN vec ON r.article_id = vec.article_id) GROUP BY 1, 2)"


@query("feat_customer_vec", f"WITH {_VECTORS} SELECT customer_id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) + 0.0 AS x FROM mv")
def _(v):
    return recs.customer_vectors(v.tx, v.vec, 50).select("customer_id", F.posexplode("customer_vector").alias("pos", "x")).withColumn("x", F.round("x", 5) + F.lit(0.0))


@query("feat_cosine", f"WITH {_CAND}, {_VECTORS}, cv AS (SELECT customer_id, list(x ORDER BY pos) AS u FROM mv GROUP BY 1) SELECT k.customer_id, k.article_id, 's' AS strategy_name, round(coalesce(list_cosine_similarity(u, CAST(embedding AS DOUBLE[])), 0), 4) + 0.0 AS image_cosine_similarity FROM k LEFT JOIN cv ON k.customer_id = cv.customer_id LEFT JOIN vec ON k.article_id = vec.article_id")
def _(v):
    made = recs.cosine_feature(_candidates(v), recs.customer_vectors(v.tx, v.vec, 50), v.vec, "image")
    return made.withColumn("image_cosine_similarity", F.round("image_cosine_similarity", 4) + F.lit(0.0))


@query("feat_merge_sims", f"WITH {_CAND} SELECT customer_id, article_id, 's' AS strategy_name, article_id % 3 AS a, customer_id % 5 AS b FROM k")
def _(v):
    c = _candidates(v)
    return recs.merge_similarities(c.withColumn("a", F.col("article_id") % 3), c.withColumn("b", F.col("customer_id") % 5))


@query("feat_article_manual", "SELECT article_id, round(avg(CASE WHEN n > 1 THEN 1.0E0 ELSE 0 END), 5) AS rebuy_share_manual, round(sum(o) / CAST(sum(n) AS DOUBLE), 5) AS offline_share_manual FROM (SELECT article_id, customer_id, count(*) AS n, count(*) FILTER (WHERE sales_channel_id = 1) AS o FROM tx GROUP BY 1, 2) GROUP BY 1")
def _(v):
    return recs.article_features(v.tx).withColumns({c: F.round(c, 5) for c in ("rebuy_share_manual", "offline_share_manual")})


@query("feat_customer_manual", "WITH g AS (SELECT customer_id, CAST(floor(avg(gap)) AS BIGINT) AS g FROM (SELECT customer_id, t_dat - lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat) AS gap FROM (SELECT DISTINCT customer_id, t_dat FROM tx)) GROUP BY 1), m AS (SELECT max(t_dat) AS m FROM tx) SELECT tx.customer_id, count(*) FILTER (WHERE t_dat >= m - 7) AS count_articles_7_manual, count(*) FILTER (WHERE t_dat >= m - 30) AS count_articles_30_manual, count(*) AS count_articles_all_manual, any_value(m) - min(t_dat) AS days_since_first_manual, any_value(m) - max(t_dat) AS days_since_last_manual, any_value(g) AS average_gap_manual, round(avg(CASE WHEN sales_channel_id = 1 THEN 1.0E0 ELSE 0 END), 5) AS offline_share_manual FROM tx JOIN g ON tx.customer_id = g.customer_id, m GROUP BY 1")
def _(v):
    return recs.customer_features(v.tx).withColumn("offline_share_manual", F.round("offline_share_manual", 5))


@query("feat_customer_group", "SELECT customer_id, product_group_name, count(*) AS count_group FROM tx JOIN art ON tx.article_id = art.article_id GROUP BY 1, 2")
def _(v):
    return recs.customer_group_counts(v.tx, v.art)


@query("feat_auto", "SELECT customer_id, round(sum(price), 2) AS sum_price_customers_automated, round(median(price), 4) AS median_price_customers_automated, count(*) AS count_customers_automated, count(*) FILTER (WHERE t_dat >= m - 90) AS count_90_customers_automated FROM tx, (SELECT max(t_dat) AS m FROM tx) GROUP BY 1")
def _(v):
    made = tables.deep_features(v.tx, "customer_id", ["price"], "t_dat", [90, None], "customers_automated")
    return made.select("customer_id", F.round("sum_price_customers_automated", 2).alias("sum_price_customers_automated"), F.round("median_price_customers_automated", 4).alias("median_price_customers_automated"), "count_customers_automated", "count_90_customers_automated")


@query("feat_label", f"WITH {_CAND}, f AS (SELECT DISTINCT customer_id AS cid, article_id AS aid, 1 AS label FROM tx WHERE t_dat >= DATE '1998-01-01') SELECT customer_id, article_id, 's' AS strategy_name, coalesce(label, 0) AS label FROM k LEFT JOIN f ON customer_id = cid AND article_id = aid")
def _(v):
    return recs.add_label(_candidates(v), _past_future(v)[1])


@query("feat_add_article", f"WITH {_CAND} SELECT k.customer_id, k.article_id, 's' AS strategy_name, CAST(coalesce(n, 0) AS INTEGER) AS count_sold FROM k LEFT JOIN (SELECT article_id, count(*) AS n FROM tx WHERE sales_channel_id = 1 GROUP BY 1) q ON k.article_id = q.article_id")
def _(v):
    sold = v.tx.where("sales_channel_id = 1").groupBy("article_id").agg(F.count("*").alias("count_sold"))
    return recs.add_features(_candidates(v), "article_id", sold)


@query("feat_add_customer", f"WITH {_CAND} SELECT k.customer_id, k.article_id, 's' AS strategy_name, CAST(coalesce(n, 0) AS INTEGER) AS count_bought, last FROM k LEFT JOIN (SELECT customer_id, count(*) AS n, max(article_id) AS last FROM tx GROUP BY 1) q ON k.customer_id = q.customer_id")
def _(v):
    bought = v.tx.groupBy("customer_id").agg(F.count("*").alias("count_bought"), F.max("article_id").alias("last"))
    return recs.add_features(_candidates(v), "customer_id", bought)


@query("feat_add_dict", f"WITH {_CAND} SELECT k.customer_id, k.article_id, 's' AS strategy_name, prod_name, product_group_name, index_name, CAST(section AS VARCHAR) AS section, list_price, age, club_member_status FROM k LEFT JOIN art ON k.article_id = art.article_id LEFT JOIN cust ON k.customer_id = cust.customer_id")
def _(v):
    return recs.add_attributes(_candidates(v), v.art, v.cust, ["postal_code"], ["section"])


@query("rank_groups", f"WITH {_CAND} SELECT customer_id, count(*) AS n FROM k GROUP BY 1")
def _(v):
    return _candidates(v).groupBy("customer_id").agg(F.count("*").alias("n"))


def _scored(v, seed: int):
    """Candidates with a score that tables give: how often the article sold, turned by a seed."""
    sold = v.tx.groupBy("article_id").agg(F.count("*").alias("n"))
    return _candidates(v).join(sold, "article_id").withColumn("score", (F.col("n") * seed + F.col("article_id")) % 97)


def _score_sql(seed: int, name: str) -> str:
    return f"{name} AS (SELECT customer_id, article_id, r FROM (SELECT k.customer_id, k.article_id, row_number() OVER (PARTITION BY k.customer_id ORDER BY (n * {seed} + k.article_id) % 97 DESC, k.article_id) AS r FROM k JOIN (SELECT article_id, count(*) AS n FROM tx GROUP BY 1) q ON k.article_id = q.article_id) WHERE r <= 12)"


@query("rank_predict", f"WITH {_CAND}, {_score_sql(3, 'a')} SELECT customer_id, string_agg(article_id, ' ' ORDER BY r) AS prediction FROM a GROUP BY 1")
def _(v):
    return tables.top_lists(_scored(v, 3), "customer_id", "article_id", "score", 12).withColumn("prediction", F.array_join(F.col("prediction").cast("array<string>"), " "))


_BLEND = f"{_CAND}, {_score_sql(3, 'a')}, {_score_sql(5, 'b')}, u AS (SELECT 0 AS model, * FROM a UNION ALL SELECT 1, * FROM b), z AS (SELECT customer_id, article_id, round(sum(1.0E0 / r), 9) AS s, min(model * 1000 + r) AS seen FROM u GROUP BY 1, 2)"


@query("rank_blend", f"WITH {_BLEND} SELECT customer_id, string_agg(article_id, ' ' ORDER BY s DESC, seen) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, seen) AS p FROM z) WHERE p <= 12 GROUP BY 1")
def _(v):
    lists = {str(s): tables.top_lists(_scored(v, s), "customer_id", "article_id", "score", 12) for s in (3, 5)}
    return recs.blend(lists, "customer_id", 12)


_FITTED = f"""{_CAND}, x AS (SELECT k.customer_id, k.article_id, CAST(n AS DOUBLE) AS n, CAST(list_price AS DOUBLE) AS price, CASE WHEN f.aid IS NULL THEN 0.0E0 ELSE 1.0E0 END AS y FROM k
    JOIN (SELECT article_id, count(*) AS n FROM tx GROUP BY 1) q ON k.article_id = q.article_id JOIN art ON k.article_id = art.article_id
    LEFT JOIN (SELECT DISTINCT customer_id AS cid, article_id AS aid FROM tx WHERE t_dat >= DATE '1998-01-01') f ON k.customer_id = f.cid AND k.article_id = f.aid),
    m AS (SELECT regr_slope(y, n) AS s1, regr_intercept(y, n) AS i1, regr_slope(y, price) AS s2, regr_intercept(y, price) AS i2 FROM x),
    a AS (SELECT * FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(i1 + s1 * n, 7) DESC, article_id) AS r FROM x, m) WHERE r <= 12),
    b AS (SELECT * FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(i2 + s2 * price, 7) DESC, article_id) AS r FROM x, m) WHERE r <= 12),
    u AS (SELECT 0 AS model, * FROM a UNION ALL SELECT 1, * FROM b), z AS (SELECT customer_id, article_id, round(sum(1.0E0 / r), 9) AS s, min(model * 1000 + r) AS seen FROM u GROUP BY 1, 2)"""


@query("rank_multi", f"WITH {_FITTED} SELECT customer_id, string_agg(article_id, ' ' ORDER BY s DESC, seen) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, seen) AS p FROM z) WHERE p <= 12 GROUP BY 1")
def _(v):
    """Two models are fitted on the labelled candidates, one on how often an article sold and one on its price; each ranks."""
    sold = v.tx.groupBy("article_id").agg(F.count("*").cast("double").alias("n"))
    priced = v.art.select("article_id", F.col("list_price").cast("double").alias("price"))
    made = recs.add_label(_candidates(v).join(sold, "article_id").join(priced, "article_id"), _past_future(v)[1])
    path = io.scratch(v.spark, "labelled")
    io.write_parquet(made, path)  # fitted on and ranked twice
    data = v.spark.read.schema(made.schema).parquet(path)
    fitted = {c: models.train_linear(data, [c], "label") for c in ("n", "price")}
    scorer = lambda m: lambda df: models.predict_linear(df, m).withColumn("score", F.round("score", 7))
    return recs.rank_models(data, {c: scorer(m) for c, m in fitted.items()})


def _truth(v):
    return _past_future(v)[1].groupBy("customer_id").agg(F.collect_list("article_id").alias("actual"))


_AP = f"{_CAND}, {_score_sql(3, 'a')}, f AS (SELECT customer_id, article_id FROM tx WHERE t_dat >= DATE '1998-01-01'), t AS (SELECT customer_id, count(*) AS n FROM f GROUP BY 1), h AS (SELECT a.customer_id, a.r, CASE WHEN f2.article_id IS NULL THEN 0 ELSE 1 END AS hit FROM a LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM f) f2 ON a.customer_id = f2.customer_id AND a.article_id = f2.article_id), w AS (SELECT customer_id, r, hit, sum(hit) OVER (PARTITION BY customer_id ORDER BY r) AS hits FROM h), ap AS (SELECT w.customer_id, sum(hit * hits / CAST(r AS DOUBLE)) / least(any_value(n), 12) AS ap FROM w JOIN t ON w.customer_id = t.customer_id GROUP BY 1)"


@query("met_ap_at_k", f"WITH {_AP} SELECT customer_id, round(ap, 5) AS ap FROM ap")
def _(v):
    joined = _truth(v).join(tables.top_lists(_scored(v, 3), "customer_id", "article_id", "score", 12), "customer_id")
    return joined.select("customer_id", F.round(metrics.average_precision("prediction", "actual", 12), 5).alias("ap"))


@query("met_map_at_k", f"WITH {_AP} SELECT round(avg(ap), 5) AS map_12 FROM ap")
def _(v):
    return metrics.map_at_k(_truth(v), tables.top_lists(_scored(v, 3), "customer_id", "article_id", "score", 12), "customer_id", 12).withColumn("map_12", F.round("map_12", 5))


@query("met_recall_ndcg", "WITH s AS (SELECT l_orderkey AS g, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS label, l_extendedprice AS x FROM lineitem), r AS (SELECT p.g, count(*) FILTER (WHERE n.x > p.x) AS rank FROM (SELECT g, max(x) AS x FROM s WHERE label = 1 GROUP BY 1) p LEFT JOIN (SELECT * FROM s WHERE label = 0) n ON p.g = n.g GROUP BY 1) SELECT round(avg(CASE WHEN rank < 1 THEN 1.0E0 ELSE 0 END), 5) AS recall_1, round(avg(CASE WHEN rank < 1 THEN 1 / log2(rank + 2) ELSE 0 END), 5) AS ndcg_1, round(avg(CASE WHEN rank < 3 THEN 1.0E0 ELSE 0 END), 5) AS recall_3, round(avg(CASE WHEN rank < 3 THEN 1 / log2(rank + 2) ELSE 0 END), 5) AS ndcg_3 FROM r")
def _(v):
    scored = v.lineitem.select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") == 1).cast("int").alias("label"), F.col("l_extendedprice").alias("x"))
    made = metrics.recall_ndcg(scored, "g", "label", "x", (1, 3))
    return made.select(*[F.round(c, 5).alias(c) for c in made.columns])


