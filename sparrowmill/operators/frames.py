"""Projections, filters and casts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import try_numeric

ROLES = {"i_": "info", "n_": "numeric", "c_": "categorical", "y_": "target"}


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.withColumnsRenamed(names)


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns by the role that their prefix names; several targets are an error."""
    found = {role: [c for c in df.columns if c.startswith(prefix)] for prefix, role in ROLES.items()}
    if len(found["target"]) > 1:
        raise ValueError(f"more than one target: {found['target']}")
    return found


def exclude(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def keep_selected(df: DataFrame, columns) -> DataFrame:
    """The columns that are in the set, in the frame's order."""
    return df.select(*[c for c in df.columns if c in set(columns)])


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"[<>\[\]]", "", c) for c in df.columns])


def suffix(df: DataFrame, text: str, but: str) -> DataFrame:
    return df.select(*[F.col(c) if c == but else F.col(c).alias(c + text) for c in df.columns])


def force_types(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numbers that can't be read become null; categories are strings."""
    return df.withColumns({c: try_numeric(F.col(c).cast("string")) for c in numeric} | {c: F.col(c).cast("string") for c in categorical})


def cast_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


_WHOLE = (("byte", 2**7), ("short", 2**15), ("int", 2**31))


def narrow_types(df: DataFrame) -> DataFrame:
    """The smallest type that strictly holds each number column's smallest and largest value; one job for all."""
    whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    real = [c for c, t in df.dtypes if t == "double"]
    if not whole + real:
        return df
    edge = df.agg(*[f(c).alias(f"{n}_{k}") for n, c in enumerate(whole + real) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    casts = {}
    for n, c in enumerate(whole + real):
        lo, hi = edge[f"{n}_lo"], edge[f"{n}_hi"]
        if lo is None:
            continue
        if c in whole:
            kind = next((k for k, m in _WHOLE if -m < lo and hi < m - 1), "long")
            casts[c] = F.col(c).cast(kind)
        elif -3.4e38 < lo and hi < 3.4e38:
            casts[c] = F.col(c).cast("float")
    return df.withColumns(casts)


def date_cutoffs(df: DataFrame, first: str | None, last: str | None, date_col: str = "ds") -> DataFrame:
    """Inclusive bounds, either may be missing; an empty result is an error."""
    out = df
    if first:
        out = out.where(F.col(date_col) >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col(date_col) <= F.lit(last).cast("date"))
    if (first or last) and out.isEmpty():
        raise ValueError("no rows between the cutoffs")
    return out


def newest(df: DataFrame, date_col: str) -> DataFrame:
    return df.agg(F.max(date_col).alias("newest"))


def _since(df: DataFrame, date_col: str, days: int, strict: bool) -> DataFrame:
    """One row with the newest date joins every row: a scalar, not a growing side."""
    limit = F.date_sub("newest", days)
    keep = F.col(date_col) > limit if strict else F.col(date_col) >= limit
    return df.crossJoin(F.broadcast(newest(df, date_col))).where(keep).drop("newest")


def last_n_days(df: DataFrame, date_col: str, n: int | None) -> DataFrame:
    """Inclusive: date >= newest - n days. None and 0 change nothing."""
    if n is not None and n < 0:
        raise ValueError("n_days is negative")
    return _since(df, date_col, n, strict=False) if n else df


def last_n_weeks(df: DataFrame, date_col: str, n: int | None) -> DataFrame:
    """Exclusive: date > newest - n weeks."""
    if n is not None and n < 0:
        raise ValueError("n_weeks is negative")
    return _since(df, date_col, 7 * n, strict=True) if n else df


def min_date(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    return df.where(F.col(date_col) >= F.lit(cutoff).cast("date"))


def positives_negatives(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label) > 0), df.where(F.col(label) == 0)


def flag(condition: Column, otherwise: int | None = 0) -> Column:
    return F.when(condition, 1).otherwise(F.lit(otherwise))


def predicted_label(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Info columns, the score and the label it gives."""
    return df.select(*roles(df)["info"], score, F.when(F.col(score) > threshold, 1).otherwise(0).alias("predicted_label"))


def fill_counts(df: DataFrame, value: int = 0) -> DataFrame:
    """Columns named count...: null filled, whole numbers."""
    return df.withColumns({c: F.coalesce(c, F.lit(value)).cast("int") for c in df.columns if re.match(r"^[Cc][Oo][Uu][Nn][Tt]", c)})
