"""Splits and samples. Every random choice orders by md5(key | seed), so it is the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import hash_key
from .frames import newest
from .ranks import quantiles


def split_weeks(df: DataFrame, date_col: str, train_weeks: int = 6, val_weeks: int = 1) -> tuple[DataFrame, DataFrame]:
    """val: the last val_weeks; train: the train_weeks before it."""
    dated = df.crossJoin(F.broadcast(newest(df, date_col)))
    edge, start = F.date_sub("newest", 7 * val_weeks), F.date_sub("newest", 7 * (val_weeks + train_weeks))
    day = F.col(date_col)
    return dated.where((day > start) & (day <= edge)).drop("newest"), dated.where(day > edge).drop("newest")


def last_periods(df: DataFrame, n: int, date_col: str = "ds") -> DataFrame:
    return df.select(date_col).distinct().orderBy(F.desc(date_col)).limit(n)


def split_periods(df: DataFrame, n: int, date_col: str = "ds", target: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, X_test without the target, Y_test."""
    test_days = last_periods(df, n, date_col)
    test = df.join(test_days, date_col, "left_semi")
    return df.join(test_days, date_col, "left_anti"), test.drop(target), test.select("unique_id", date_col, target)


def _chosen(keys: DataFrame, key: list[str], strata: list[str], size: Column, seed: int) -> DataFrame:
    """Of each stratum the first `size` keys in hash order, size being a column over n (keys in the stratum).

    Ranks are taken inside hash ranges first and lifted by the counts of the ranges before, so that a stratum with a
    third of all keys is dealt over many tasks.
    """
    h = hash_key(*key, seed=seed)
    cells = keys.withColumn("h", h).withColumn("cell", F.substring("h", 1, 2))
    strata = strata or ["one"]
    cells = cells.withColumn("one", F.lit(1)) if strata == ["one"] else cells
    counts = cells.groupBy(*strata, "cell").agg(F.count("*").alias("c"))
    before = W.partitionBy(*strata).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy(*strata))).drop("c")
    joined = cells.join(counts.select(*[F.col(s).alias(f"_{s}") for s in [*strata, "cell"]], "base", "n"), [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in [*strata, "cell"]])
    rank = F.row_number().over(W.partitionBy(*strata, "cell").orderBy("h", *key))
    return joined.withColumn("rank", F.col("base") + rank).where(F.col("rank") <= size).select(*keys.columns)


def sample_keys(df: DataFrame, key: str, frac: float, seed: int = 42) -> DataFrame:
    """Rows of int(n * frac) keys; a fraction of about 1 keeps all, none left gives an empty frame."""
    if frac > 1.0 + 1e-9:
        raise ValueError("fraction above 1")
    if abs(frac - 1) < 1e-9:
        return df
    keys = df.select(key).distinct()
    return df.join(_chosen(keys, [key], [], F.floor(F.col("n") * F.lit(frac)), seed), key, "left_semi")


def sample_rows(df: DataFrame, key: list[str], frac: float, seed: int = 42) -> DataFrame:
    """Rows whose hash lies below the fraction: no shuffle."""
    return df.where(F.conv(F.substring(hash_key(*key, seed=seed), 1, 8), 16, 10).cast("double") < frac * 2.0**32)


def n_series(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    keys = df.select(key).distinct().orderBy(hash_key(key, seed=seed), key).limit(n)
    return df.join(keys, key, "left_semi")


def random_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(*key, seed=seed), *key).limit(n)


def downsample_negatives(df: DataFrame, key: list[str], n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """All positives and n negatives; more than there are is an error."""
    negatives = df.where(F.col(label) == 0)
    if (have := negatives.count()) < n:
        raise ValueError(f"{n} negatives wanted, {have} there")
    return df.where(F.col(label) > 0).unionByName(random_rows(negatives, key, n, seed))


def split_groups(df: DataFrame, group: str, label: str, frac: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """train, val: whole groups, stratified by whether a group has a positive; val gets round(frac * n) groups of each."""
    groups = df.groupBy(group).agg((F.max(label) > 0).cast("int").alias("stratum"))
    val = _chosen(groups, [group], ["stratum"], F.round(F.col("n") * F.lit(frac)), seed)
    return df.join(val, group, "left_anti"), df.join(val, group, "left_semi")


def sample_strata(df: DataFrame, key: str, strata: list[str], frac: float, seed: int = 42) -> DataFrame:
    """Keys (one row each in df), round(frac * n) of each stratum."""
    if frac > 1.0 + 1e-9:
        raise ValueError("fraction above 1")
    return df if abs(frac - 1) < 1e-9 else _chosen(df, [key], strata, F.round(F.col("n") * F.lit(frac)), seed)


def sample_target(df: DataFrame, key: str, target: str, n: int, seed: int = 42) -> DataFrame:
    total = df.count()
    return sample_strata(df, key, [target], min(1.0, n / total) if total else 1.0, seed)


def one_strategy(df: DataFrame, keys: list[str], strategy: str, seed: int = 42) -> DataFrame:
    """One strategy of each pair, by hash."""
    order = F.struct(hash_key(*keys, strategy, seed=seed), F.col(strategy))
    return df.groupBy(*keys).agg(F.min(order).getField(strategy).alias(strategy))


def filter_transactions(tx: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    return tx.join(customers.select("customer_id"), "customer_id", "left_semi").join(articles.select("article_id"), "article_id", "left_semi")


def quantile_edges(df: DataFrame, column: str, q: int | list[float], distinct: bool = False) -> list[float]:
    """Exact quantiles; equal edges raise unless `distinct`."""
    points = [i / q for i in range(q + 1)] if isinstance(q, int) else list(q)
    edges = quantiles(df, column, points)
    if distinct:
        return sorted(set(edges))
    if len(set(edges)) < len(edges):
        raise ValueError(f"bin edges of {column} are not distinct: {edges}")
    return edges


def quantile_bin(column: str, edges: list[float]) -> Column:
    """Right-closed bins "00", "01", ..., the first closed on the left as well; outside or null: "nan"."""
    x, out = F.col(column), F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), "nan")
    for n, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when((x >= low if n == 0 else x > low) & (x <= high), f"{n:02d}")
    return out.otherwise("nan")
