"""Plans of imputers, encoders, feature selection, models and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, embeddings, frames, metrics, models, prep, recs, sessions
from ..sources import io
from .registry import query
from .relational import web_events


def _cols(v, *cols):
    return v.abt.select("i_doc_id", *cols)


@query("imp_mean", "SELECT i_doc_id, round(coalesce(CAST(n_gap AS DOUBLE), (SELECT avg(n_gap) FROM abt)), 5) AS n_gap FROM abt")
def _(v):
    df = _cols(v, F.col("n_gap").cast("double").alias("n_gap"))
    return prep.impute(df, prep.fit_imputers(df, mean=["n_gap"])).withColumn("n_gap", F.round("n_gap", 5))


@query("imp_zero", "SELECT i_doc_id, coalesce(n_gap, 0) AS n_gap FROM abt")
def _(v):
    return prep.impute(_cols(v, "n_gap"), prep.fit_imputers(v.abt, zero=["n_gap"]))


_MODE = "(SELECT c_source FROM abt WHERE c_source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, c_source LIMIT 1)"


@query("imp_mostfreq", f"SELECT i_doc_id, coalesce(c_source, {_MODE}) AS c_source FROM abt")
def _(v):
    return prep.impute(_cols(v, "c_source"), prep.fit_imputers(v.abt, mostfreq=["c_source"]))


@query("imp_unknown", "SELECT i_doc_id, coalesce(c_source, 'UNKNOWN') AS c_source FROM abt")
def _(v):
    return prep.impute(_cols(v, "c_source"), prep.fit_imputers(v.abt, unknown=["c_source"]))


@query("enc_ordinal", "SELECT i_doc_id, CAST(coalesce(r, -1) AS INTEGER) AS c_source FROM abt LEFT JOIN (SELECT s, row_number() OVER (ORDER BY s) AS r FROM (SELECT DISTINCT c_source AS s FROM abt WHERE c_source IS NOT NULL)) ON c_source = s")
def _(v):
    return prep.ordinal(_cols(v, "c_source"), "c_source", prep.fit_codes(v.abt, "c_source"))


@query("enc_onehot", "SELECT i_doc_id, CAST(c_lang = 'de' AS INTEGER) AS c_lang_de, CAST(c_lang = 'en' AS INTEGER) AS c_lang_en, CAST(c_lang = 'es' AS INTEGER) AS c_lang_es, CAST(c_lang = 'fr' AS INTEGER) AS c_lang_fr FROM abt")
def _(v):
    return prep.onehot(_cols(v, "c_lang"), "c_lang", prep.fit_categories(v.abt, "c_lang"))


@query("enc_binary", "SELECT i_doc_id, CAST((r >> 2) & 1 AS INTEGER) AS c_lang_0, CAST((r >> 1) & 1 AS INTEGER) AS c_lang_1, CAST(r & 1 AS INTEGER) AS c_lang_2 FROM abt JOIN (SELECT l, row_number() OVER (ORDER BY l) AS r FROM (SELECT DISTINCT c_lang AS l FROM abt)) ON c_lang = l")
def _(v):
    return prep.binary(_cols(v, "c_lang"), "c_lang", prep.fit_categories(v.abt, "c_lang"))


@query("enc_apply_order", "SELECT i_doc_id, CAST(c_lang = 'de' AS INTEGER) AS c_lang_de, CAST(c_lang = 'en' AS INTEGER) AS c_lang_en, CAST(c_lang = 'es' AS INTEGER) AS c_lang_es, CAST(c_lang = 'fr' AS INTEGER) AS c_lang_fr, CAST(coalesce(r, -1) AS INTEGER) AS c_source FROM abt LEFT JOIN (SELECT s, row_number() OVER (ORDER BY s) AS r FROM (SELECT DISTINCT c_source AS s FROM abt WHERE c_source IS NOT NULL)) ON c_source = s")
def _(v):
    fitted = {"onehot": {"c_lang": prep.fit_categories(v.abt, "c_lang")}, "ordinal": {"c_source": prep.fit_codes(v.abt, "c_source")}}
    return prep.encode(_cols(v, "c_lang", "c_source"), fitted)


@query("fe_engineer", "SELECT user_id AS i_visitor_id, i_visit_start_time, CAST((dayofweek(make_timestamp(i_visit_start_time)) + 6) % 7 AS INTEGER) AS c_weekday, CAST(hour(make_timestamp(i_visit_start_time)) AS INTEGER) AS c_hour FROM (SELECT user_id, coalesce(max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END), max(epoch_us(ts))) AS i_visit_start_time FROM events GROUP BY user_id, user_id * 1000 + day(ts), CAST(ts AS DATE), CASE WHEN event_id % 4 = 0 THEN 'ad' ELSE 'direct' END)")
def _(v):
    return sessions.engineer(sessions.sessions(web_events(v))).select("i_visitor_id", "i_visit_start_time", "c_weekday", "c_hour")


def _named(v, names):
    return v.spark.sql("SELECT explode(split(:names, ',')) AS feature", args={"names": ",".join(names)})


_NULLS = ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)" for c in ("n_chars", "n_gap", "c_lang", "c_source", "y_quality"))


@query("fsel_null", f"SELECT f AS feature FROM (SELECT unnest(['n_chars', 'n_gap', 'c_lang', 'c_source', 'y_quality']) AS f, unnest([{_NULLS}]) AS share FROM abt) WHERE share <= 0.05")
def _(v):
    return _named(v, prep.few_nulls(v.abt, ["n_chars", "n_gap", "c_lang", "c_source", "y_quality"], 0.05))


@query("fsel_single_value", "SELECT f AS feature FROM (SELECT unnest(['n_chars', 'fixed', 'n_gap']) AS f, unnest([count(DISTINCT n_chars), count(DISTINCT fixed), count(DISTINCT n_gap)]) AS n FROM (SELECT *, 3 AS fixed FROM abt)) WHERE n > 1")
def _(v):
    df = v.abt.withColumn("fixed", F.lit(3))
    return _named(v, prep.not_constant(df, ["n_chars", "fixed", "n_gap"]))


@query("fsel_corr", "WITH r AS (SELECT abs(corr(score, score * 2 + 1)) AS ab, abs(corr(score, n_chars)) AS ac, abs(corr(score * 2 + 1, n_chars)) AS bc FROM abt) SELECT 'a' AS feature FROM r UNION ALL SELECT 'b' FROM r WHERE ab < 0.9 UNION ALL SELECT 'c' FROM r WHERE ac < 0.9 AND (ab >= 0.9 OR bc < 0.9)")
def _(v):
    df = v.abt.select(F.col("score").alias("a"), (F.col("score") * 2 + 1).alias("b"), F.col("n_chars").alias("c"))
    return _named(v, prep.uncorrelated(df, ["a", "b", "c"], 0.9))


@query("fsel_all", """WITH r AS (SELECT avg(CASE WHEN n_gap IS NULL THEN 1.0 ELSE 0 END) AS gaps, count(DISTINCT n_chars) AS chars, count(DISTINCT score) AS scores, count(DISTINCT c_lang) AS langs, abs(corr(n_chars, n_gap)) AS cg, abs(corr(n_chars, score)) AS cs, abs(corr(n_gap, score)) AS gs, abs(corr(n_chars, score * 2)) AS ct, abs(corr(score, score * 2)) AS st FROM abt)
    SELECT 'n_chars' AS feature FROM r WHERE chars > 1 UNION ALL SELECT 'n_gap' FROM r WHERE gaps <= 0.05 AND cg < 0.9 UNION ALL SELECT 'score' FROM r WHERE scores > 1 AND cs < 0.9 AND (gaps > 0.05 OR gs < 0.9) UNION ALL SELECT 'twice' FROM r WHERE ct < 0.9 AND st < 0.9 UNION ALL SELECT 'c_lang' FROM r WHERE langs > 1""")
def _(v):
    df = v.abt.withColumn("fixed", F.lit(3)).withColumn("twice", F.col("score") * 2)
    return _named(v, prep.select_features(df, ["n_chars", "n_gap", "score", "twice", "fixed", "c_lang"], 0.05, 0.9))


_NUM, _CAT = ["n_chars", "n_gap", "signal"], ["c_lang"]


def _model_data(v):
    """A table with a label that the columns partly explain, and a held-out part by id."""
    out = v.abt.withColumn("n_gap", F.coalesce("n_gap", F.lit(0))).withColumn("signal", F.col("score") + F.col("y_quality"))
    return out.withColumn("held", F.col("i_doc_id") % 4 == 0)


def _model(v):
    return models.train_gbt(_model_data(v), _NUM, _CAT, "y_quality", "held", maxIter=5, maxDepth=3)


@query("mdl_gbt")
def _(v):
    return models.score(_model_data(v).where("held"), _model(v)).select("i_doc_id", "probability", "y_quality")


@query("mdl_tune")
def _(v):
    _, tried = models.tune(_model_data(v), _NUM, _CAT, "y_quality", "held", rounds=2, width=4, iterations=(2, 4))
    rows = [(n, p["maxDepth"], float(p["stepSize"]), float(p["subsamplingRate"]), p["featureSubsetStrategy"], b, m) for n, (p, b, m) in enumerate(tried)]
    return v.spark.createDataFrame(rows, "trial int, depth int, rate double, subsample double, features string, iterations int, auc double")


@query("mdl_score")
def _(v):
    return models.score(_model_data(v), _model(v)).select("i_doc_id", F.col("probability").alias("score"))


@query("mdl_score_batched")
def _(v):
    return models.score_batched(_model_data(v), _model(v), "i_doc_id", io.scratch(v.spark, "scores"), 3).select("i_doc_id", "probability")


@query("mdl_calibrate")
def _(v):
    data = _model_data(v)
    apply = models.calibrate(data.where("held"), "score", "y_quality", "isotonic")
    sigmoid = models.calibrate(data.where("held"), "score", "y_quality", "sigmoid")
    both = sigmoid(data.select("i_doc_id", "score")).withColumnRenamed("calibrated", "sigmoid")
    return apply(both).select("i_doc_id", "score", "sigmoid", F.col("calibrated").alias("isotonic"))


@query("mdl_importance_rule", "WITH a AS (SELECT c_lang AS feature, avg(abs(score - 0.5)) AS m FROM abt GROUP BY 1) SELECT feature, round(m / (SELECT sum(m) FROM a), 5) AS importance FROM a")
def _(v):
    made = v.abt.select(F.col("c_lang").alias("feature"), (F.col("score") - 0.5).alias("attribution"))
    return models.importance(made).withColumn("importance", F.round("importance", 5))


def _attributed(v, model):
    return attribution.tree_attributions(_model_data(v), model, [*_NUM, *_CAT], "i_doc_id", io.scratch(v.spark, "trees"))[0]


@query("mdl_attribution")
def _(v):
    return _attributed(v, _model(v))


@query("mdl_attribution_sampled")
def _(v):
    return models.attributions(_model_data(v), _model(v), [*_NUM, *_CAT], "i_doc_id", "y_quality", 2)


@query("mdl_importance")
def _(v):
    return models.importance(_attributed(v, _model(v)))


@query("mdl_pdp")
def _(v):
    model = _model(v)
    return models.dependence_of_top(_model_data(v), model, models.importance(_attributed(v, model)), 2)


def _sequences(v):
    return embeddings.sequences(v.inter, "user_id", "item_id", ["time", "item_id"])


def _transitions(v):
    return embeddings.transition_vectors(embeddings.train_transitions(_sequences(v), epochs=2), _sequences(v), "user_id", v.inter, "item_id")


@query("mdl_cf_train")
def _(v):
    return _transitions(v)[1].withColumnRenamed("v", "features")


@query("mdl_cf_predict")
def _(v):
    users, items = _transitions(v)
    found = recs.nearest(users, items, 12, "user_id", "v", item_col="item_id")
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l"))
    return lists.select(F.col("query").alias("user"), F.transform("l", lambda s: s["item"]).alias("prediction"))


def _counts(v):
    counts = v.inter.groupBy("user_id", "item_id").agg(F.count("*").cast("float").alias("n"))
    return counts.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), "n")


@query("mdl_als_train")
def _(v):
    return models.train_factors(_counts(v), "user_id", "item_id", "n").userFactors.select("id", F.col("features").cast("array<double>").alias("features"))


@query("mdl_als_predict")
def _(v):
    return models.predict_factors(models.train_factors(_counts(v), "user_id", "item_id", "n"), 12)


@query("emb_text")
def _(v):
    return embeddings.latent_vectors(v.documents, "doc_id", "text")


@query("emb_text_hashed")
def _(v):
    return models.text_vectors(v.documents, "doc_id", "text")


@query("llm_batch", "WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'Summarize the following text:' || chr(10) || text AS prompt FROM documents) SELECT id, prompt, array_to_string(string_split(prompt, ' ')[1:8], ' ') AS completion FROM p")
def _(v):
    return models.complete_batch(v.documents, "doc_id", "text", "summarize")


@query("met_auc", "WITH r AS (SELECT y_quality, avg(rn) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM abt)) SELECT round((sum(CASE WHEN y_quality = 1 THEN r ELSE 0 END) - sum(y_quality) * (sum(y_quality) + 1) / 2.0) / CAST(sum(y_quality) * (count(*) - sum(y_quality)) AS DOUBLE), 6) AS auc FROM r")
def _(v):
    return metrics.auc(v.abt, "score", "y_quality").withColumn("auc", F.round("auc", 6))


@query("met_calibration", "WITH e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM abt) SELECT CAST(len(list_filter(q, lambda x: x < score)) AS INTEGER) AS bin, round(avg(score), 6) AS mean_score, round(avg(y_quality), 6) AS share_positive, count(*) AS n FROM abt, e GROUP BY 1")
def _(v):
    return metrics.calibration(v.abt, "score", "y_quality", 5).withColumns({c: F.round(c, 6) for c in ("mean_score", "share_positive")})


@query("fe_predicted_info", "SELECT i_doc_id, n_chars FROM abt")
def _(v):
    r = frames.roles(v.abt)
    return v.abt.select(*r["info"], "n_chars")
