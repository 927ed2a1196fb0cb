"""Plans of forecasts, cross-validation and forecasting metrics, on monthly sales by segment (steps of 30 days)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, series
from .registry import query

H = 4
_LAST = "(SELECT unique_id, max(ds) AS e FROM ser GROUP BY 1) l, (SELECT unnest(range(1, 5)) AS k)"


def _flat_sql(value: str, name: str, inner: str = "ser") -> str:
    return f"SELECT l.unique_id, l.e + CAST(30 * k AS INTEGER) AS ds, round(x, 3) AS {name} FROM {_LAST}, (SELECT unique_id, {value} AS x FROM {inner} GROUP BY 1) v WHERE v.unique_id = l.unique_id"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 3) for n in names})


@query("ts_prepare", "SELECT c_mktsegment AS unique_id, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31' GROUP BY 1, 2", dates=("ds",))
def _(v):
    raw = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    made = series.prepare(raw, {"c_mktsegment": "unique_id", "day": "ds", "o_totalprice": "y"}, "1994-01-01", "1996-12-31")
    return made.withColumn("y", F.round("y", 2))


@query("ts_future", f"SELECT l.unique_id, CAST(k AS INTEGER) AS step, l.e + CAST(30 * k AS INTEGER) AS ds FROM {_LAST}", dates=("ds",))
def _(v):
    return series.future(v.ser, H, 30)


@query("ts_naive", _flat_sql("max_by(y, ds)", "Naive"), dates=("ds",))
def _(v):
    return _rounded(series.naive(v.ser, H, 30), "Naive")


@query("ts_historic_avg", _flat_sql("avg(y)", "HistoricAverage"), dates=("ds",))
def _(v):
    return _rounded(series.historic_average(v.ser, H, 30), "HistoricAverage")


@query("ts_seasonal_naive", f"WITH b AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS r FROM ser) SELECT l.unique_id, l.e + CAST(30 * k AS INTEGER) AS ds, round(y, 3) AS SeasonalNaive FROM {_LAST}, b WHERE b.unique_id = l.unique_id AND b.r = 3 - (k - 1) % 3", dates=("ds",))
def _(v):
    return _rounded(series.seasonal_naive(v.ser, H, 3, 30), "SeasonalNaive")


@query("ts_window_avg", _flat_sql("avg(y)", "WindowAverage", "(SELECT * FROM ser QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 6)"), dates=("ds",))
def _(v):
    return _rounded(series.window_average(v.ser, H, 6, 30), "WindowAverage")


_WEIGHTED = "(SELECT unique_id, y * CASE WHEN r = 1 THEN pow(0.95, n - 1) ELSE 0.05 * pow(0.95, n - r) END AS w FROM (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS r, count(*) OVER (PARTITION BY unique_id) AS n FROM ser))"


@query("ts_ses", _flat_sql("sum(w)", "SES", _WEIGHTED), dates=("ds",))
def _(v):
    return _rounded(series.smoothed(v.ser, H, 0.05, 30), "SES")


def _steps_sql(value: str, name: str) -> str:
    """Future steps with a value that may grow by step k; v holds one row a series."""
    return f"SELECT l.unique_id, l.e + CAST(30 * k AS INTEGER) AS ds, round({value}, 3) AS {name} FROM {_LAST}, v WHERE v.unique_id = l.unique_id"


_PLACED = "p AS (SELECT unique_id, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM ser)"
#: Sums of `s` neighbours smoothed by 0.1, for s from the first to the mean interval between sales.
_SUMMED = f"""{_PLACED}, m AS (SELECT unique_id, CASE WHEN count(*) > 1 THEN greatest(1, CAST(round_even((max(i) - min(i)) / (count(*) - 1.0), 0) AS BIGINT)) ELSE 1 END AS m FROM p WHERE y <> 0 GROUP BY 1),
    z AS (SELECT unique_id, m, unnest(range(1, m + 1)) AS s FROM m),
    b AS (SELECT p.unique_id, m, s, (i - (n - (n // s) * s)) // s AS j, n // s AS nb, sum(y) AS w FROM p JOIN z ON p.unique_id = z.unique_id WHERE i >= n - (n // s) * s GROUP BY 1, 2, 3, 4, 5),
    f AS (SELECT unique_id, m, s, sum(w * CASE WHEN j = 0 THEN pow(0.9, nb - 1) ELSE 0.1 * pow(0.9, nb - 1 - j) END) / s AS x FROM b GROUP BY 1, 2, 3)"""
_ADIDA = f"WITH {_SUMMED}, v AS (SELECT unique_id, x FROM f WHERE s = m) {_steps_sql('x', 'ADIDA')}"
_IMAPA = f"WITH {_SUMMED}, v AS (SELECT unique_id, avg(x) AS x FROM f GROUP BY 1) {_steps_sql('x', 'IMAPA')}"
#: The trend line, and the line of doubled curvature smoothed by the best of ten rates.
_THETA = f"""WITH {_PLACED}, g AS (SELECT unique_id, regr_slope(y, i) AS slope, regr_intercept(y, i) AS base, any_value(n) AS n FROM p GROUP BY 1),
    c AS (SELECT p.unique_id, i, p.n, 2 * y - (base + slope * i) AS x FROM p JOIN g ON p.unique_id = g.unique_id), al AS (SELECT 0.05 + 0.1 * unnest(range(0, 10)) AS a),
    lv AS (SELECT t.unique_id, a, t.i, sum(q.x * CASE WHEN q.i = 0 THEN pow(1 - a, t.i) ELSE a * pow(1 - a, t.i - q.i) END) AS level FROM c t JOIN c q ON q.unique_id = t.unique_id AND q.i <= t.i, al GROUP BY 1, 2, 3),
    er AS (SELECT lv.unique_id, a, sum((c.x - level) * (c.x - level)) AS sse FROM lv JOIN c ON c.unique_id = lv.unique_id AND c.i = lv.i + 1 GROUP BY 1, 2),
    be AS (SELECT unique_id, arg_min(a, sse) AS a FROM er GROUP BY 1),
    v AS (SELECT g.unique_id, base, slope, n, level FROM g JOIN be ON be.unique_id = g.unique_id JOIN lv ON lv.unique_id = g.unique_id AND lv.a = be.a AND lv.i = n - 1)
    {_steps_sql('0.5 * (base + slope * (n - 1 + k)) + 0.5 * level', 'Theta')}"""


def _fitted(key: str, name: str, sql: str | None = None) -> None:
    query(key, sql, dates=("ds",) if sql else ())(lambda v: _rounded(series.forecast(v.ser, H, [name], 30, season=12), name))


for _key, _name, _sql in (("ts_theta", "Theta", _THETA), ("ts_auto_theta", "AutoTheta", None), ("ts_adida", "ADIDA", _ADIDA), ("ts_imapa", "IMAPA", _IMAPA), ("ts_auto_ets", "AutoETS", None), ("ts_auto_arima", "AutoARIMA", None)):
    _fitted(_key, _name, _sql)


def _with_x(df):
    return df.withColumns({"december": (F.month("ds") == 12).cast("double"), "month": F.month("ds").cast("double")})


def _exogenous(v):
    return series.forecast_exogenous(_with_x(v.ser), _with_x(series.future(v.ser, H, 30).select("unique_id", "ds")), ["december", "month"], "WithCalendar", season=12)


@query("ts_auto_arima_x")
def _(v):
    return _exogenous(v)


@query("ts_fallback", _flat_sql("avg(y)", "Failing"), dates=("ds",))
def _(v):
    def failing(y, h):
        raise ValueError("no fit")

    return _rounded(series.forecast(v.ser, H, ["Failing"], 30, extra={"Failing": failing}), "Failing")


@query("ts_fitted", "SELECT unique_id, ds, y, lag(y) OVER w AS Naive, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS HistoricAverage FROM ser WINDOW w AS (PARTITION BY unique_id ORDER BY ds)", dates=("ds",))
def _(v):
    return _rounded(series.fitted(v.ser), "HistoricAverage")


_MENU = f"SELECT l.unique_id, l.e + CAST(30 * k AS INTEGER) AS ds, round(a, 3) AS Naive, round(b, 3) AS HistoricAverage, round(c, 3) AS SES, round(d, 3) AS WindowAverage FROM {_LAST}, (SELECT unique_id, max_by(y, ds) AS a, avg(y) AS b, avg(CASE WHEN r <= 4 THEN y END) AS d FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS r FROM ser) GROUP BY 1) v, (SELECT unique_id, sum(w) AS c FROM {_WEIGHTED} GROUP BY 1) s WHERE v.unique_id = l.unique_id AND s.unique_id = l.unique_id"


@query("ts_model_menu", _MENU, dates=("ds",))
def _(v):
    names = list(series.models(quick=True))
    return _rounded(series.forecast(v.ser, H, names, 30), *names)


_ORIGINS = "o AS (SELECT ds AS cutoff FROM (SELECT ds, row_number() OVER (ORDER BY ds DESC) AS r FROM (SELECT DISTINCT ds FROM ser)) WHERE r IN (4, 6, 8))"
_CV = f"{_ORIGINS}, tr AS (SELECT unique_id, cutoff, max_by(y, ds) AS a, avg(y) AS b FROM ser JOIN o ON ds <= cutoff GROUP BY 1, 2), te AS (SELECT unique_id, cutoff, ds, y, row_number() OVER (PARTITION BY unique_id, cutoff ORDER BY ds) AS k FROM ser JOIN o ON ds > cutoff), cv AS (SELECT te.unique_id, te.ds, te.cutoff, te.y, tr.a AS Naive, tr.b AS HistoricAverage FROM te JOIN tr ON te.unique_id = tr.unique_id AND te.cutoff = tr.cutoff WHERE k <= 3)"


def _cv(v):
    return series.cross_validate_models(v.ser, 3, 3, 2, ["Naive", "HistoricAverage"])


@query("ts_cross_validate", f"WITH {_CV} SELECT unique_id, ds, cutoff, y, round(Naive, 3) AS Naive, round(HistoricAverage, 3) AS HistoricAverage FROM cv", dates=("ds", "cutoff"))
def _(v):
    return _rounded(_cv(v), "Naive", "HistoricAverage")


@query("ts_compare_exo")
def _(v):
    return series.compare(_exogenous(v), series.forecast(v.ser, H, ["AutoARIMA"], 30, season=12))


_ERR = "avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p) / abs(y)) AS mape"


@query("met_forecast", f"WITH {_CV} SELECT round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape, 6) AS mape FROM (SELECT {_ERR.replace('p)', 'Naive)')} FROM cv)")
def _(v):
    return metrics.forecast_errors(_cv(v), "y", "Naive").select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 6).alias("mape"))


@query("met_cv_errors", f"WITH {_CV}, lg AS (SELECT unique_id, cutoff, y, 'Naive' AS model, Naive AS p FROM cv UNION ALL SELECT unique_id, cutoff, y, 'HistoricAverage', HistoricAverage FROM cv), s AS (SELECT cutoff, unique_id, model, {_ERR} FROM lg GROUP BY 1, 2, 3) SELECT cutoff, model, round(avg(mae), 3) AS mae, round(avg(rmse), 3) AS rmse, round(avg(mape), 6) AS mape FROM s GROUP BY 1, 2", dates=("cutoff",))
def _(v):
    made = metrics.cv_errors(_cv(v), ["Naive", "HistoricAverage"])
    return made.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3), "mape": F.round("mape", 6)})
