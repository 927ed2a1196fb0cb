"""Fitted forecasters: exact likelihoods, recovered parameters, seasons, regressors, one pass over windows."""

import datetime as dt

import numpy as np
import pytest

from sparrowmill.operators import series, statespace


def _gaussian(y, phi, theta):
    """-2 log likelihood of an ARMA(1, 1) with a mean, from its covariance matrix; the noise's variance is concentrated out."""
    g = [(1 + 2 * phi * theta + theta**2) / (1 - phi**2)]
    g.append(phi * g[0] + theta)
    while len(g) < len(y):
        g.append(phi * g[-1])
    cov = np.array([[g[abs(i - j)] for j in range(len(y))] for i in range(len(y))])
    one = np.ones(len(y))
    rest = y - (one @ np.linalg.solve(cov, y)) / (one @ np.linalg.solve(cov, one))
    return len(y) * (np.log(2 * np.pi * (rest @ np.linalg.solve(cov, rest)) / len(y)) + 1) + np.linalg.slogdet(cov)[1]


@pytest.mark.parametrize("missing", [0, 5])
def test_filter_gives_the_exact_likelihood(missing):
    y = np.random.default_rng(1).normal(size=30).cumsum()
    data = np.concatenate([np.full((missing, 2), np.nan), np.column_stack([y, np.ones(30)])])[None]
    v, f, _, _ = statespace.kalman(data, np.array([[0.5]]), np.array([[0.4]]))
    rest = v[0, :, 0] - v[0, :, 1] * statespace._weights(v, f)[0, 0]
    got = 30 * (np.log(2 * np.pi * (rest**2 / f[0]).sum() / 30) + 1) + np.log(f).sum()
    assert abs(got - _gaussian(y, 0.5, 0.4)) < 1e-6


def test_simplex_finds_each_rows_minimum():
    goal = np.array([[1.0, -2.0], [0.5, 3.0], [10.0, 10.0]])
    found, value = statespace.simplex(lambda rows, x: ((x - goal[rows]) ** 2 * [1, 5]).sum(1), np.zeros((3, 2)), rounds=400, tolerance=1e-12)
    assert np.abs(found - goal).max() < 1e-3 and value.max() < 1e-5


def test_moving_average_is_recovered():
    e = np.random.default_rng(2).normal(size=(20, 301))
    data = np.stack([np.column_stack([10 + x[1:] + 0.6 * x[:-1], np.ones(300)]) for x in e])
    theta = np.tanh(statespace.arma_fit(data, (0, 1, 0, 0), 1)[0][:, 0])
    assert abs(theta.mean() - 0.6) < 0.05 and theta.std() < 0.1


def test_seasonal_models_beat_seasonal_naive():
    rng, past, ahead = np.random.default_rng(3), [], []
    for i in range(12):
        n = 40 + i
        k = np.arange(n + 4)
        y = 100 + 0.5 * k + 20 * np.sin(np.pi * k / 2 + i) + rng.normal(size=n + 4) * 2
        past.append(y[:n])
        ahead.append(y[n:])
    error = lambda made: np.abs(made - np.array(ahead)).mean()
    naive = error(series.MODELS["SeasonalNaive"](past, 4, 4))
    for name in ("AutoARIMA", "AutoETS", "AutoTheta"):
        assert error(series.MODELS[name](past, 4, 4)) < naive, name
    assert error(statespace.auto_arima(past, 4, 1)[0]) > error(statespace.auto_arima(past, 4, 4)[0])
    growing = [np.exp(0.02 * np.arange(48)) * (10 + 4 * np.cos(np.pi * np.arange(48) / 2))]
    assert statespace.auto_ets(growing, 4, 4)[1][0][2] == "M"


def test_regressors_pass_the_filter(spark):
    rng, rows, later, truth = np.random.default_rng(4), [], [], {}
    day = dt.date(2024, 1, 1)
    for u in "abc":
        x, e = rng.normal(size=(64, 2)), np.zeros(64)
        for k in range(1, 64):
            e[k] = 0.6 * e[k - 1] + rng.normal() * 0.3
        y = 5 + 3 * x[:, 0] - 2 * x[:, 1] + e
        rows += [(u, day + dt.timedelta(7 * k), float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(60)]
        later += [(u, day + dt.timedelta(7 * k), float(x[k, 0]), float(x[k, 1])) for k in range(60, 64)]
        truth |= {(u, day + dt.timedelta(7 * k)): y[k] for k in range(60, 64)}
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double, x1 double, x2 double")
    future = spark.createDataFrame(later, "unique_id string, ds date, x1 double, x2 double")
    got = series.forecast_exogenous(df, future, ["x1", "x2"], "A").collect()
    assert len(got) == 12 and np.mean([abs(r.A - truth[r.unique_id, r.ds]) for r in got]) < 0.6
    with pytest.raises(Exception, match="lacks its regressors"):
        series.forecast_exogenous(df, future.selectExpr("unique_id", "ds", "x1", "CAST(NULL AS DOUBLE) AS x2"), ["x1", "x2"]).collect()


def test_short_flat_and_failing_series(spark):
    day = dt.date(2024, 1, 1)
    made = {"one": [3.0], "flat": [7.0] * 20, "line": [float(k) for k in range(30)], "gap": [1.0, None, 3.0]}
    df = spark.createDataFrame([(u, day + dt.timedelta(7 * k), y) for u, ys in made.items() for k, y in enumerate(ys)], "unique_id string, ds date, y double")
    got = series.forecast(df, 2, ["AutoARIMA", "AutoETS", "AutoTheta"]).collect()
    assert len(got) == 8 and all(np.isfinite(r[n]) for r in got for n in ("AutoARIMA", "AutoETS", "AutoTheta"))
    line = sorted((r.ds, r.AutoARIMA, r.AutoETS) for r in got if r.unique_id == "line")
    assert abs(line[1][1] - 31) < 0.1 and abs(line[1][2] - 31) < 0.5
    assert all(abs(r.AutoARIMA - 7) < 1e-6 for r in got if r.unique_id == "flat")


def test_windows_from_one_pass(spark):
    day, rng = dt.date(2024, 1, 1), np.random.default_rng(5)
    data = [(u, day + dt.timedelta(7 * k), float(y)) for u, n in (("a", 30), ("b", 26), ("c", 3)) for k, y in enumerate(rng.normal(size=n) + 5, 30 - n)]
    df = spark.createDataFrame(data, "unique_id string, ds date, y double")
    names = ["Naive", "HistoricAverage", "WindowAverage", "SES", "SeasonalNaive", "Theta"]
    got = series.cross_validate_models(df, 2, 4, 3, names)
    want = series.cross_validate(df, 2, 4, 3, lambda d: series.forecast(d, 2, names), names)
    plain = lambda d: sorted((r.unique_id, r.ds, r.cutoff, *[round(r[n], 9) for n in ["y", *names]]) for r in d.collect())
    assert plain(got) == plain(want) and got.count() > 15
    plan = series.cross_validate_models(df, 2, 4, 3, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # a series moves once, not once a window
