"""Model jobs on pyspark.ml, with attribution and dependence as plain table work."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import hash_key, prompt
from ..sources import io
from . import tuning
from .ranks import dense_ids, quantiles


def _stages(numeric: list[str], categorical: list[str]) -> list:
    indexers = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    return [*indexers, VectorAssembler(inputCols=[*numeric, *[f"_{c}" for c in categorical]], outputCol="features", handleInvalid="keep")]


def train_gbt(df: DataFrame, numeric: list[str], categorical: list[str], label: str, validation: str | None = None, **params) -> PipelineModel:
    """Boosted trees; rows where `validation` is true stop the rounds early."""
    gbt = GBTClassifier(labelCol=label, seed=42, **({"maxIter": 10, "maxDepth": 4} | params))
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*_stages(numeric, categorical), gbt]).fit(df)


#: What a search of boosted trees goes through if nothing else is asked for.
GBT_SPACE: tuning.Space = {
    "maxDepth": tuning.Whole(2, 6),
    "stepSize": tuning.Real(1e-2, 1.0, log=True),
    "subsamplingRate": tuning.Real(0.5, 1.0),
    "minInstancesPerNode": tuning.Whole(1, 20),
    "featureSubsetStrategy": tuning.Choice(("all", "sqrt")),
}
METRICS = ("areaUnderROC", "areaUnderPR", "logLoss", "f1", "accuracy")


def tune(df: DataFrame, numeric: list[str], categorical: list[str], label: str, held: str, space: tuning.Space | None = None, metric: str = "areaUnderROC", direction: str = "maximize", rounds: int = 3, width: int = 4, iterations: tuple[int, int] = (4, 16), seed: int = 42, parallelism: int = 2):
    """Model of the best parameters, and every trial (params, iterations, value).

    Rows where `held` is true judge, the others fit; params are names of GBTClassifier, iterations the budget that halving raises.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    kind = BinaryClassificationEvaluator if metric.startswith("area") else MulticlassClassificationEvaluator
    judge = kind(labelCol=label, metricName=metric)
    prepared = Pipeline(stages=_stages(numeric, categorical)).fit(df)
    data = prepared.transform(df).select("features", F.col(label).cast("double").alias(label), F.col(held).alias("_held")).persist()
    fit_rows, judge_rows = data.where(~F.col("_held")), data.where("_held")

    def fit(params: dict, budget: int):
        return GBTClassifier(labelCol=label, seed=seed, maxIter=budget, **params).fit(fit_rows)

    try:
        best, trials = tuning.search(space or GBT_SPACE, lambda p, b: judge.evaluate(fit(p, b).transform(judge_rows)), direction, rounds, width, iterations, seed=seed, parallelism=parallelism)
        model = PipelineModel([*prepared.stages, fit(best.params, best.budget)])
    finally:
        data.unpersist()
    return model, [(t.params, t.budget, t.value) for t in trials]


def score(df: DataFrame, model, name: str = "probability") -> DataFrame:
    out = model.transform(df)
    kept = [c for c in df.columns if c != name]
    return out.select(*kept, vector_to_array("probability")[1].alias(name))


def train_linear(df: DataFrame, numeric: list[str], label: str) -> PipelineModel:
    """Least squares by the normal equations: one pass of sums."""
    line = LinearRegression(labelCol="_label", featuresCol="features", predictionCol="score", solver="normal", regParam=0.0)
    data = df.withColumn("_label", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="features"), line]).fit(data)


def predict_linear(df: DataFrame, model: PipelineModel) -> DataFrame:
    """df with the column score."""
    return model.transform(df.drop("score")).select(*[c for c in df.columns if c != "score"], "score")


def score_batched(df: DataFrame, model, key: str, path: str, batches: int, name: str = "probability") -> DataFrame:
    """Scores, batch by batch: rows are dealt to batches by key, each is scored and written to a folder of its own below path,
    and a run that starts again skips the batches that are complete. The rows are dealt once, into a table that each batch
    reads its own folder of."""
    spark = df.sparkSession
    done = io.finished(spark, path, "batch")
    missing = [n for n in range(batches) if n not in done]
    if missing:
        dealt = io.scratch(spark, "dealt")
        numbered = df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
        numbered.where(F.col("_batch").isin(missing)).write.partitionBy("_batch").parquet(dealt)
        rows = spark.read.schema(numbered.schema).parquet(dealt)
        for n in missing:
            score(rows.where(F.col("_batch") == n).drop("_batch"), model, name).write.mode("overwrite").parquet(f"{path}/batch={n}")
    return spark.read.parquet(path).drop("batch")


def calibrate(df: DataFrame, score_col: str, label: str, method: str = "isotonic") -> Callable[[DataFrame], DataFrame]:
    """Fitted on held-out scores; the result adds the column calibrated."""
    data = df.select(F.col(score_col).alias("_x"), F.col(label).cast("double").alias("_y"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="calibrated").fit(data)
        return lambda d: model.transform(d.withColumn("_x", F.col(score_col))).drop("_x")
    if method != "sigmoid":
        raise ValueError("method is isotonic or sigmoid")
    assembler = VectorAssembler(inputCols=["_x"], outputCol="_v")
    model = LogisticRegression(featuresCol="_v", labelCol="_y").fit(assembler.transform(data))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return lambda d: d.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.col(score_col) + F.lit(b)))))


def importance(attributions: DataFrame, feature: str = "feature", value: str = "attribution") -> DataFrame:
    """Mean absolute attribution of each feature as a share of all, largest first."""
    by = attributions.groupBy(feature).agg(F.avg(F.abs(value)).alias("m"))
    total = by.agg(F.sum("m").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(feature, (F.col("m") / F.col("total")).alias("importance")).orderBy(F.desc("importance"), feature)


def attributions(df: DataFrame, model, features: list[str], id_col: str, label: str, n_permutations: int = 3, seed: int = 42) -> DataFrame:
    """Sampled Shapley values of a scored sample: id, feature, attribution.

    For each row and permutation, features take the row's values one after another, the others keeping a background
    row's; each step's change of score belongs to the feature that joined. Background rows come from the sample by hash.
    """
    data = df.select(id_col, *features)
    keyed = data.withColumn("_h", hash_key(id_col, seed=seed))
    numbered = keyed.join(dense_ids(keyed, "_h").withColumnRenamed("idx", "_n"), "_h").drop("_h")
    total = keyed.select("_h").distinct().count()
    rng = random.Random(seed)
    parts = []
    for p in range(n_permutations):
        order_p = rng.sample(features, len(features))
        back = numbered.select((F.pmod(F.col("_n") + rng.randrange(max(1, total)), F.lit(total))).alias("_n"), *[F.col(f).alias(f"_b_{f}") for f in features])
        both = numbered.join(back, "_n")
        for k in range(len(features) + 1):
            joined = set(order_p[:k])
            parts.append(both.select(id_col, F.lit(p).alias("_p"), F.lit(k).alias("_k"), F.lit(order_p[k - 1] if k else "").alias("feature"), *[F.col(f if f in joined else f"_b_{f}").alias(f) for f in features]))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    scored = score(stacked.withColumn(label, F.lit(0.0)), model)
    w = W.partitionBy(id_col, "_p").orderBy("_k")
    steps = scored.withColumn("d", F.col("probability") - F.lag("probability").over(w)).where("_k > 0")
    return steps.groupBy(id_col, "feature").agg(F.avg("d").alias("attribution"))


def partial_dependence(df: DataFrame, model, feature: str, points: int = 5) -> DataFrame:
    """feature, value, mean_score: the mean score with the feature set to each of a few of its quantiles, or, for text, to each
    of its `points` most frequent values."""
    numeric = dict(df.dtypes)[feature] != "string"
    if numeric:
        values = sorted(set(quantiles(df, feature, [i / (points - 1) for i in range(points)])))
    else:
        values = [r[0] for r in df.where(F.col(feature).isNotNull()).groupBy(feature).count().orderBy(F.desc("count"), feature).limit(points).collect()]
    grid = df.sparkSession.createDataFrame([(x,) for x in values], f"_v {'double' if numeric else 'string'}")
    wide = df.drop(feature).crossJoin(F.broadcast(grid)).withColumn(feature, F.col("_v").cast(df.schema[feature].dataType))
    out = score(wide, model).groupBy(F.col("_v").cast("string").alias("value")).agg(F.avg("probability").alias("mean_score"))
    return out.withColumn("feature", F.lit(feature))


def dependence_of_top(df: DataFrame, model, importances: DataFrame, n: int = 5, points: int = 5) -> DataFrame:
    """Partial dependence of the n features that an importance table ranks first."""
    first = [r["feature"] for r in importances.orderBy(F.desc("importance"), "feature").limit(n).collect()]
    return reduce(lambda a, b: a.unionByName(b), [partial_dependence(df, model, f, points) for f in first])


def train_factors(df: DataFrame, user: str, item: str, rating: str, rank: int = 8, iterations: int = 4):
    return ALS(userCol=user, itemCol=item, ratingCol=rating, implicitPrefs=True, rank=rank, maxIter=iterations, seed=42).fit(df)


def predict_factors(model, k: int = 12) -> DataFrame:
    """user, prediction: the k best items by user vector x item vector, blocked inside Spark."""
    return model.recommendForAllUsers(k).select(F.col(model.getUserCol()).alias("user"), F.transform("recommendations", lambda r: r[model.getItemCol()]).alias("prediction"))


def text_vectors(df: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """id and a unit vector of hashed term weights; null text reads "nan"."""
    data = df.select(id_col, F.coalesce(text_col, F.lit("nan")).alias("_t"))
    stages = [RegexTokenizer(inputCol="_t", outputCol="_w", pattern="\\W+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=size), IDF(inputCol="_f", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_v")]
    return Pipeline(stages=stages).fit(data).transform(data).select(id_col, vector_to_array("_v", "float32").alias("embedding"))


def echo(prompts: pd.Series, max_tokens: int) -> pd.Series:
    """The default completer, which needs no service: the prompt's first words."""
    return prompts.str.split(" ").str[: min(8, max_tokens)].str.join(" ")


INSTRUCTIONS = {"explain": ("Explain the following text:\n", 64), "summarize": ("Summarize the following text:\n", 256)}


def complete_batch(df: DataFrame, id_col: str, text_col: str, mode: str, completer: Callable[[pd.Series, int], pd.Series] = echo) -> DataFrame:
    """id, prompt, completion: one prompt a text, completed a batch at a time by a function of the prompts and of the most tokens
    that an answer may have."""
    instruction, limit = INSTRUCTIONS[mode]
    prompts = df.select(F.col(id_col).cast("string").alias("id"), prompt(text_col, instruction).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                done = completer(part.column(1).to_pandas(), limit)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(done, pa.string(), from_pandas=True)], ["id", "prompt", "completion"])

    return prompts.mapInArrow(run, "id string, prompt string, completion string")


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts in a column have about `most` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        held = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
