"""Imputers, encoders and feature selection. Fits are one aggregation; what they yield is a small parameter dict."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import clean_names
from .ranks import dense_ids

UNKNOWN = "UNKNOWN"


def fit_imputers(df: DataFrame, mean=(), zero=(), mostfreq=(), unknown=()) -> dict[str, object]:
    """Fill value of each listed column. The most frequent value: on a tie the smallest."""
    fills: dict[str, object] = {c: 0 for c in zero} | {c: UNKNOWN for c in unknown}
    if mean:
        row = df.agg(*[F.avg(c).alias(c) for c in mean]).first()
        fills |= {c: row[c] for c in mean}
    for c in mostfreq:
        best = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).first()
        fills[c] = best[c] if best else None
    return fills


def impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


MOST_CATEGORIES = 10_000


def fit_categories(df: DataFrame, column: str, order_col: str | None = None) -> list:
    """Values in order, or in the order in which order_col first shows them. More than MOST_CATEGORIES is an error: one-hot
    and binary encodings make columns of them, and ordinal codes of many values come from fit_codes."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order_col or column).alias("_first")).orderBy("_first", column)
    values = [r[column] for r in seen.limit(MOST_CATEGORIES + 1).collect()]
    if len(values) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return values


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """_value, _code: codes from 1 in sorted order as a table of any size."""
    return dense_ids(df, column).select(F.col(column).alias("_value"), (F.col("idx") + 1).cast("int").alias("_code"))


def ordinal(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Codes from 1; a value not fitted is -1. values: a list, or a table of fit_codes, which is joined."""
    if isinstance(values, DataFrame):
        coded = df.join(values, F.col(column) == F.col("_value"), "left")
        return coded.withColumn(column, F.coalesce("_code", F.lit(-1)).cast("int")).drop("_value", "_code")
    code = F.lit(-1)
    if values:
        code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, v in enumerate(values) for x in (v, n + 1)]), F.col(column)), F.lit(-1))
    return df.withColumn(column, code.cast("int"))


def onehot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def binary(df: DataFrame, column: str, values: list) -> DataFrame:
    """The ordinal code in base 2, the high bit first."""
    width = max(1, len(values).bit_length())
    coded = ordinal(df, column, values)
    code = F.greatest(F.col(column), F.lit(0))
    return coded.withColumns({f"{column}_{k}": F.shiftright(code, width - 1 - k).bitwiseAND(F.lit(1)) for k in range(width)}).drop(column)


def encode(df: DataFrame, fitted: dict[str, dict[str, list | DataFrame]]) -> DataFrame:
    """Binary, then one-hot, then ordinal encoders, then clean names."""
    for kind, apply in (("binary", binary), ("onehot", onehot), ("ordinal", ordinal)):
        for column, values in fitted.get(kind, {}).items():
            df = apply(df, column, values)
    return clean_names(df)


def few_nulls(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) <= threshold]


def not_constant(df: DataFrame, columns: list[str]) -> list[str]:
    """Smallest and largest value tell a constant without counting distinct values."""
    row = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]["lo"] != row[c]["hi"] or (row[c]["nulls"] and row[c]["lo"] is not None)]


def uncorrelated(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """Greedy: the first of a group of columns with |r| >= threshold stays."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] not in ("string", "date", "boolean")]
    if not numeric:
        raise ValueError("no numeric column")
    vectors = VectorAssembler(inputCols=numeric, outputCol="v", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double") for c in numeric]))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(numeric)):
        if all(not abs(matrix[i, j]) >= threshold for j in kept):
            kept.append(i)
    return [c for c in columns if c not in numeric or numeric.index(c) in kept]


def select_features(df: DataFrame, columns: list[str], null_share: float = 0.5, correlation: float = 0.9, enabled: bool = True) -> list[str]:
    if not enabled:
        return columns
    kept = not_constant(df, few_nulls(df, columns, null_share))
    kinds = dict(df.dtypes)
    return uncorrelated(df, kept, correlation) if any(kinds[c] not in ("string", "date", "boolean") for c in kept) else kept


def as_array(vector: str):
    return vector_to_array(F.col(vector))
