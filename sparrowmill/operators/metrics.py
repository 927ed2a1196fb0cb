"""Ranking, classification and forecasting metrics as table work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .sampling import quantile_edges


def average_precision(predicted, actual, k: int) -> Column:
    """Average precision at k: a repeated prediction counts once, empty truth gives 0, the denominator is min(len(actual), k)."""
    top = F.slice(F.col(predicted), 1, k)
    fresh = F.transform(top, lambda x, i: (F.array_contains(F.col(actual), x) & (F.array_position(top, x) == i + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def step(a, hit):
        hits, at = a["hits"] + hit, a["at"] + 1
        return F.struct(hits.alias("hits"), at.alias("at"), (a["sum"] + hit * hits / at).alias("sum"))

    total = F.aggregate(fresh, start, step)["sum"]
    size = F.size(actual)
    return F.when(size.isNull() | (size <= 0), 0.0).otherwise(total / F.least(size, F.lit(k)))


def map_at_k(truth: DataFrame, predictions: DataFrame, key: str, k: int, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """Mean over the keys that have both."""
    return truth.join(predictions, key).agg(F.avg(average_precision(predicted, actual, k)).alias(f"map_{k}"))


def recall_ndcg(scored: DataFrame, group: str, label: str, score: str, ks=(5, 10, 20)) -> DataFrame:
    """From the rank of the one positive among negatives (how many score higher)."""
    positive = F.max(F.when(F.col(label) == 1, F.col(score)))
    at = scored.groupBy(group).agg(positive.alias("p")).where("p is not null")
    ranks = scored.where(F.col(label) == 0).join(at, group, "right").groupBy(group).agg(F.count(F.when(F.col(score) > F.col("p"), 1)).alias("rank"))
    aggs = []
    for k in ks:
        aggs.append(F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(f"recall_{k}"))
        aggs.append(F.avg(F.when(F.col("rank") < k, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias(f"ndcg_{k}"))
    return ranks.agg(*aggs)


def _errors(y, p) -> tuple[Column, Column, Column]:
    d = F.col(y) - F.col(p)
    return F.avg(F.abs(d)), F.sqrt(F.avg(d * d)), F.avg(F.abs(d) / F.abs(F.col(y)))


def forecast_errors(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """MAE, RMSE and MAPE (a fraction)."""
    mae, rmse, mape = _errors(y, predicted)
    return df.agg(mae.alias("mae"), rmse.alias("rmse"), mape.alias("mape"))


def cv_errors(cv: DataFrame, models: list[str]) -> DataFrame:
    """cutoff, model, mae, rmse, mape: mean over series of each series' error."""
    long = cv.unpivot(["unique_id", "ds", "cutoff", "y"], models, "model", "p")
    mae, rmse, mape = _errors("y", "p")
    series = long.groupBy("cutoff", "unique_id", "model").agg(mae.alias("mae"), rmse.alias("rmse"), mape.alias("mape"))
    return series.groupBy("cutoff", "model").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "mape")])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank sum over distinct scores: ties share their rank, and only distinct scores are sorted."""
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    parts = running(by.withColumn("neg", F.col("n") - F.col("pos")), score, "neg", "below")
    return parts.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 25) -> DataFrame:
    """bin, mean score and share of positives of quantile bins."""
    edges = quantile_edges(df, score, bins, distinct=True)
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    place = F.size(F.filter(inner, lambda e: e < F.col(score)))
    return df.groupBy(place.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share_positive"), F.count("*").alias("n"))
