"""Forecasts of many series. In: unique_id, ds, y. Out: unique_id, ds, a column a model, one row a future step.

Closed forms are plain aggregates and windows. Fitted models run in numpy: a series is one row of arrays, as the model needs
it whole, and the series of an Arrow batch are fitted side by side (statespace.py).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import statespace
from .frames import date_cutoffs, rename

KEY = "unique_id string, ds date"


def prepare(df: DataFrame, names: dict[str, str], first: str | None = None, last: str | None = None, exogenous: list[str] | None = None) -> DataFrame:
    """Rename, cut by date, sum per series and date (and exogenous columns)."""
    cut = date_cutoffs(rename(df, names), first, last)
    return cut.groupBy("unique_id", "ds", *(exogenous or [])).agg(F.sum("y").alias("y"))


def future(df: DataFrame, h: int, step_days: int = 7) -> DataFrame:
    """unique_id, step (from 1), ds of the next h steps of each series."""
    last = df.groupBy("unique_id").agg(F.max("ds").alias("end"))
    return last.select("unique_id", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), "end").select("unique_id", "step", F.date_add("end", F.col("step") * step_days).alias("ds"))


def _flat(df: DataFrame, values: DataFrame, h: int, step_days: int, name: str) -> DataFrame:
    return future(df, h, step_days).join(values, "unique_id").select("unique_id", "ds", F.col("value").alias(name))


def naive(df: DataFrame, h: int, step_days: int = 7, name: str = "Naive") -> DataFrame:
    return _flat(df, df.groupBy("unique_id").agg(F.max_by("y", "ds").alias("value")), h, step_days, name)


def historic_average(df: DataFrame, h: int, step_days: int = 7, name: str = "HistoricAverage") -> DataFrame:
    return _flat(df, df.groupBy("unique_id").agg(F.avg("y").alias("value")), h, step_days, name)


def window_average(df: DataFrame, h: int, window: int = 4, step_days: int = 7, name: str = "WindowAverage") -> DataFrame:
    latest = F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))
    values = df.withColumn("r", latest).where(F.col("r") <= window).groupBy("unique_id").agg(F.avg("y").alias("value"))
    return _flat(df, values, h, step_days, name)


def seasonal_naive(df: DataFrame, h: int, season: int = 4, step_days: int = 7, name: str = "SeasonalNaive") -> DataFrame:
    """The value one season back, cycled; a series shorter than a season has no forecast there."""
    back = df.withColumn("r", F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))).where(F.col("r") <= season)
    wanted = future(df, h, step_days).withColumn("r", F.lit(season) - F.pmod(F.col("step") - 1, F.lit(season)))
    return wanted.join(back.select("unique_id", "r", F.col("y").alias(name)), ["unique_id", "r"], "left").select("unique_id", "ds", name)


def smoothed(df: DataFrame, h: int, alpha: float = 0.05, step_days: int = 7, name: str = "SES") -> DataFrame:
    """Simple exponential smoothing: a fold over the series' values in order."""
    packed = df.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y")))).alias("s"))
    level = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0]["y"], lambda a, x: a * (1 - alpha) + x["y"] * alpha)
    return _flat(df, packed.select("unique_id", level.alias("value")), h, step_days, name)


def fitted(df: DataFrame) -> DataFrame:
    """y with the in-sample predictions of the naive and the historic-average model."""
    w = W.partitionBy("unique_id").orderBy("ds")
    return df.select("unique_id", "ds", "y", F.lag("y").over(w).alias("Naive"), F.avg("y").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("HistoricAverage"))


# Fitted models: from the values of one series to its next h values.


def _ses(y: np.ndarray, alpha: float) -> tuple[float, float]:
    level, sse = y[0], 0.0
    for v in y[1:]:
        sse += (v - level) ** 2
        level += alpha * (v - level)
    return level, sse


def _best_ses(y: np.ndarray) -> float:
    return min((_ses(y, a)[::-1] for a in np.linspace(0.05, 0.95, 10)))[1]


def theta(y: np.ndarray, h: int) -> np.ndarray:
    """Mean of the trend line and of the smoothed line with doubled curvature."""
    t = np.arange(len(y))
    slope, base = np.polyfit(t, y, 1) if len(y) > 1 else (0.0, y[0])
    curved = 2 * y - (base + slope * t)
    return 0.5 * (base + slope * np.arange(len(y), len(y) + h)) + 0.5 * _best_ses(curved)


def _aggregated(y: np.ndarray, size: int) -> float:
    n = len(y) // size
    return _ses(y[len(y) - n * size :].reshape(n, size).sum(1), 0.1)[0] / size if n else float(y.mean())


def _mean_interval(y: np.ndarray) -> int:
    at = np.flatnonzero(y)
    return max(1, round(float(np.diff(at).mean()))) if len(at) > 1 else 1


def adida(y: np.ndarray, h: int) -> np.ndarray:
    return np.full(h, _aggregated(y, _mean_interval(y)))


def imapa(y: np.ndarray, h: int) -> np.ndarray:
    return np.full(h, np.mean([_aggregated(y, s) for s in range(1, _mean_interval(y) + 1)]))


Model = Callable[[list[np.ndarray], int, int], np.ndarray]


def _each(model: Callable[..., np.ndarray]) -> Model:
    return lambda series, h, season: np.array([model(y, h) for y in series])


#: From the values of many series, the steps ahead and the season's length to the next values, a row a series.
MODELS: dict[str, Model] = {
    "Naive": _each(lambda y, h: np.full(h, y[-1], float)),
    "HistoricAverage": _each(lambda y, h: np.full(h, y.mean())),
    "SeasonalNaive": lambda series, h, season: np.array([np.resize(y[-season:], h).astype(float) for y in series]),
    "WindowAverage": _each(lambda y, h: np.full(h, y[-4:].mean())),
    "SES": _each(lambda y, h: np.full(h, _ses(y, 0.05)[0])),
    "Theta": _each(theta),
    "AutoTheta": statespace.auto_theta,
    "ADIDA": _each(adida),
    "IMAPA": _each(imapa),
    "AutoETS": lambda series, h, season: statespace.auto_ets(series, h, season)[0],
    "AutoARIMA": lambda series, h, season: statespace.auto_arima(series, h, season)[0],
}
QUICK = ("Naive", "HistoricAverage", "SES", "WindowAverage")
TOGETHER = 256  # series of a task that are fitted side by side


def models(names: list[str] | None = None, quick: bool = False) -> dict[str, Model]:
    names = list(QUICK) if quick else (names or ["AutoETS"])
    if unknown := [n for n in names if n not in MODELS]:
        raise ValueError(f"unknown models {unknown}; there are {sorted(MODELS)}")
    return {n: MODELS[n] for n in names}


def with_fallback(model: Model, fallback: Model) -> Model:
    """The model's forecasts; the fallback's for a series on which it fails or gives no finite number."""

    def run(series: list[np.ndarray], h: int, season: int) -> np.ndarray:
        try:
            out = np.array(model(series, h, season), float)
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
            if len(series) == 1:
                return fallback(series, h, season)
            return np.concatenate([run([y], h, season) for y in series])
        bad = np.flatnonzero(~np.isfinite(out).all(axis=1))
        if len(bad):
            out[bad] = fallback([series[i] for i in bad], h, season)
        return out

    return run


def _chosen(names: list[str], fallback: str, extra: dict[str, Callable] | None) -> dict[str, Model]:
    own = {n: _each(m) for n, m in (extra or {}).items()}
    listed = [n for n in names if n not in own]
    return {n: with_fallback(m, MODELS[fallback]) for n, m in ((models(listed) if listed else {}) | own).items()}


def pack(df: DataFrame, *columns: str) -> DataFrame:
    """unique_id, ds and arrays of y and other columns, by date: a row a series. Steps without y are left out."""
    kept = [F.col(c).cast("double").alias(c) for c in ("y", *columns)]
    clean = df.where("y is not null").select(F.col("unique_id").cast("string"), F.col("ds").cast("date").alias("ds"), *kept)
    rows = clean.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "y", *columns))).alias("_s"))
    return rows.select("unique_id", *[F.col("_s")[c].alias(c) for c in ("ds", "y", *columns)])


def _parts(batches):
    for b in batches:
        for at in range(0, len(b), TOGETHER):
            yield b.iloc[at : at + TOGETHER]


def forecast(df: DataFrame, h: int, names: list[str], step_days: int = 7, fallback: str = "HistoricAverage", extra: dict[str, Callable] | None = None, season: int = 4) -> DataFrame:
    """All models side by side; a model that fails on a series gives the fallback's values there.

    A series is one row of arrays, and the series of a batch are fitted together. extra: name -> model of one series (y, h).
    """
    chosen = _chosen(names, fallback, extra)

    def run(batches):
        for part in _parts(batches):
            series = [np.asarray(y, float) for y in part["y"]]
            made = {n: m(series, h, season).ravel() for n, m in chosen.items()}
            days = [end + datetime.timedelta(days=step_days * (i + 1)) for end in part["end"] for i in range(h)]
            yield pd.DataFrame({"unique_id": np.repeat(part["unique_id"].to_numpy(), h), "ds": days} | made)

    rows = pack(df).select("unique_id", F.element_at("ds", -1).alias("end"), "y")
    return rows.mapInPandas(run, ", ".join([KEY, *[f"{n} double" for n in chosen]]))


def forecast_exogenous(df: DataFrame, future_x: DataFrame, regressors: list[str], name: str = "AutoARIMA", season: int = 1) -> DataFrame:
    """ARIMA whose regressors pass the same filter; every future step needs its regressors, past steps without are left out."""
    steps = F.sort_array(F.collect_list(F.struct("ds", *[F.col(c).cast("double").alias(c) for c in regressors])))
    later = future_x.groupBy(F.col("unique_id").cast("string").alias("unique_id")).agg(steps.alias("_x"))
    later = later.select("unique_id", F.col("_x")["ds"].alias("_days"), *[F.col("_x")[c].alias(f"_{c}") for c in regressors])
    rows = pack(df.dropna(subset=regressors), *regressors).join(later, "unique_id").drop("ds")

    def run(batches):
        for part in _parts(batches):
            series = [np.asarray(y, float) for y in part["y"]]
            past = [np.column_stack([np.asarray(v, float) for v in r]) for r in zip(*[part[c] for c in regressors], strict=True)]
            ahead = [np.column_stack([np.asarray(v, float) for v in r]) for r in zip(*[part[f"_{c}"] for c in regressors], strict=True)]
            if any(np.isnan(a).any() for a in ahead):
                raise ValueError("a future step lacks its regressors")
            h = max(map(len, ahead))
            full = [np.vstack([a, np.repeat(a[-1:], h - len(a), axis=0)]) for a in ahead]
            made = statespace.auto_arima(series, h, season, past, full)[0]
            for key, days, y, values in zip(part["unique_id"], part["_days"], series, made, strict=True):
                values = values[: len(days)] if np.isfinite(values).all() else np.full(len(days), y.mean())
                yield pd.DataFrame({"unique_id": key, "ds": list(days), name: values})

    return rows.mapInPandas(run, f"{KEY}, {name} double")


def cutoffs(df: DataFrame, n_windows: int, step: int, h: int) -> DataFrame:
    """The n_windows rolling origins, `step` periods apart, the last h periods before the end."""
    periods = df.select("ds").distinct()
    rank = F.row_number().over(W.orderBy(F.desc("ds")))  # a row a period
    return periods.withColumn("r", rank).where((F.col("r") > h) & ((F.col("r") - h - 1) % step == 0) & (F.col("r") <= h + 1 + step * (n_windows - 1))).select(F.col("ds").alias("cutoff"))


def cross_validate(df: DataFrame, h: int, n_windows: int, step: int, fit: Callable[[DataFrame], DataFrame], value_cols: list[str]) -> DataFrame:
    """unique_id, ds, cutoff, y and the forecasts of `fit` at every origin; all origins run as series of one job."""
    origins = cutoffs(df, n_windows, step, h)
    copies = df.join(F.broadcast(origins), F.col("ds") <= F.col("cutoff"))  # n_windows rows
    keyed = copies.select(F.concat_ws("\x01", "unique_id", F.col("cutoff").cast("string")).alias("unique_id"), "ds", "y")
    made = fit(keyed).withColumn("_p", F.split("unique_id", "\x01"))
    made = made.select(F.col("_p")[0].alias("unique_id"), F.col("_p")[1].cast("date").alias("cutoff"), F.row_number().over(W.partitionBy("unique_id").orderBy("ds")).alias("step"), *value_cols)
    place = F.row_number().over(W.partitionBy("unique_id", "cutoff").orderBy("ds"))
    actual = df.join(F.broadcast(origins), F.col("ds") > F.col("cutoff")).withColumn("step", place).where(F.col("step") <= h)
    return actual.join(made, ["unique_id", "cutoff", "step"]).select("unique_id", "ds", "cutoff", "y", *value_cols)


def _states(y: np.ndarray, ends: list[int], h: int, name: str, season: int) -> list[np.ndarray]:
    """The forecasts of a closed form from each of y[:end], its state being kept at the ends of one pass."""
    n = np.array(ends)
    if name == "Naive":
        last = y[n - 1]
    elif name == "HistoricAverage":
        last = np.cumsum(y)[n - 1] / n
    elif name == "WindowAverage":
        sums = np.concatenate([[0.0], np.cumsum(y)])
        last = (sums[n] - sums[np.maximum(n - 4, 0)]) / np.minimum(n, 4)
    elif name == "SES":
        levels, level = np.empty(len(y)), y[0]
        for i, v in enumerate(y):
            level += 0.05 * (v - level)
            levels[i] = level
        last = levels[n - 1]
    else:
        return [np.resize(y[max(0, e - season) : e], h) for e in ends]
    return [np.full(h, v, float) for v in last]


CLOSED = ("Naive", "HistoricAverage", "WindowAverage", "SES", "SeasonalNaive")


def cross_validate_models(df: DataFrame, h: int, n_windows: int, step: int, names: list[str], season: int = 4, fallback: str = "HistoricAverage") -> DataFrame:
    """unique_id, ds, cutoff, y and a column a model: what cross_validate gives for these models, from one pass over each series.

    A series is shuffled once, whatever the number of windows: closed forms keep their state at each cutoff, other models
    are fitted on the prefixes that the task holds already.
    """
    origins = sorted(r[0] for r in cutoffs(df, n_windows, step, h).collect())  # n_windows dates
    chosen = _chosen(names, fallback, None)

    def run(batches):
        for part in _parts(batches):
            out, asked = [], []  # a piece: unique_id, days, cutoff, values; and the prefix of each
            for key, days, y in zip(part["unique_id"], part["ds"], part["y"], strict=True):
                days, y = np.array(days), np.asarray(y, float)
                ends = [(c, int(np.searchsorted(days, c, side="right"))) for c in origins]
                ends = [(c, e) for c, e in ends if 0 < e < len(days)]
                if not ends:
                    continue
                states = {n: _states(y, [e for _, e in ends], h, n, season) for n in chosen if n in CLOSED}
                for j, (c, e) in enumerate(ends):
                    out.append((key, days[e : e + h], c, y[e : e + h], {n: s[j] for n, s in states.items()}))
                    asked.append(y[:e])
            for n, m in chosen.items():
                if n not in CLOSED and asked:
                    for piece, values in zip(out, m(asked, h, season), strict=True):
                        piece[4][n] = values
            for key, days, c, y, made in out:
                yield pd.DataFrame({"unique_id": key, "ds": list(days), "cutoff": c, "y": y} | {n: made[n][: len(days)] for n in chosen})

    columns = ", ".join([KEY, "cutoff date, y double", *[f"{n} double" for n in chosen]])
    return pack(df).mapInPandas(run, columns)


def compare(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, ["unique_id", "ds"]), frames)
