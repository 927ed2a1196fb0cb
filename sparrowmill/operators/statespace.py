"""Forecasting models as state spaces, fitted for many series at once in arrays.

Series are rows of a matrix, set flush right; steps before a series' first value are missing and change no state, so series
of any lengths share a recursion. Parameters are found by a simplex search that runs all series side by side; each row has a
simplex of its own and leaves when it has converged.

ARIMA: exact Gaussian likelihood by the Kalman filter of a seasonal ARMA process, started from its stationary state.
Regressors and the mean pass the same filter, their weights follow by least squares of the innovations. Differences come
from a stationarity test and the strength of the season; orders by steps to the neighbour with the lowest AICc.
Exponential smoothing: level, trend (none, straight, damped) and season (none, added, multiplied), with errors added or
multiplied, by AICc.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]


def stack(series: list[np.ndarray]) -> np.ndarray:
    """Rows set flush right, nan before them."""
    out = np.full((len(series), max(map(len, series))), np.nan)
    for row, y in zip(out, series, strict=True):
        row[len(row) - len(y) :] = y
    return out


def simplex(cost: Cost, start: np.ndarray, step: float = 0.5, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Nelder and Mead's search for each row of `start`. cost(rows, points) gives a value a row; nan counts as infinite."""
    n, k = start.shape

    def at(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(cost(rows, x), nan=np.inf, posinf=np.inf, neginf=np.inf)

    rows = np.arange(n)
    if not k:
        return start, at(rows, start)
    points = np.repeat(start[:, None, :], k + 1, axis=1)
    points[:, 1:] += step * np.eye(k)
    values = np.stack([at(rows, points[:, j]) for j in range(k + 1)], axis=1)
    live = rows
    for _ in range(rounds):
        order = np.argsort(values[live], axis=1, kind="stable")
        points[live] = np.take_along_axis(points[live], order[:, :, None], axis=1)
        values[live] = np.take_along_axis(values[live], order, axis=1)
        low, high = values[live, 0], values[live, -1]
        with np.errstate(invalid="ignore"):
            live = live[~((high - low <= tolerance * (np.abs(low) + tolerance)) | np.isinf(low))]
        if not len(live):
            break
        p, v = points[live], values[live]
        centre, worst = p[:, :-1].mean(1), p[:, -1]
        mirrored = 2 * centre - worst
        first = at(live, mirrored)
        best, middling = first < v[:, 0], (first >= v[:, 0]) & (first < v[:, -2])
        far = np.where(best, 2.0, np.where(first < v[:, -1], 0.5, -0.5))
        other = centre + far[:, None] * (centre - worst)
        second = np.full(len(live), np.inf)
        ask = ~middling
        if ask.any():
            second[ask] = at(live[ask], other[ask])
        take = second < np.where(best, first, np.minimum(first, v[:, -1]))
        keep = take | best | middling
        p[keep, -1] = np.where(take[:, None], other, mirrored)[keep]
        v[keep, -1] = np.where(take, second, first)[keep]
        if not keep.all():
            shrink = np.flatnonzero(~keep)
            p[shrink, 1:] = (p[shrink, 1:] + p[shrink, :1]) / 2
            for j in range(1, k + 1):
                v[shrink, j] = at(live[shrink], p[shrink, j])
        points[live], values[live] = p, v
    best = values.argmin(1)
    return points[rows, best], values[rows, best]


def aicc(minus_two_log: np.ndarray, n: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    room = n - k - 1
    return np.where(room > 0, minus_two_log + 2 * k + 2 * k * (k + 1) / np.where(room > 0, room, 1), np.inf)


# ARMA


def stationary(free: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from unbounded numbers: their tanh are its partial autocorrelations."""
    partial, out = np.tanh(free), np.zeros_like(free)
    for j in range(free.shape[1]):
        out[:, :j], out[:, j] = out[:, :j] - partial[:, j : j + 1] * out[:, :j][:, ::-1], partial[:, j]
    return out


def _seasonal_product(near: np.ndarray, far: np.ndarray, season: int) -> np.ndarray:
    """Coefficients behind the leading 1 of (1 + near B + ...)(1 + far B^season + ...)."""
    n, p = near.shape
    out = np.zeros((n, p + season * far.shape[1] + 1))
    one = np.concatenate([np.ones((n, 1)), near], axis=1)
    for j in range(far.shape[1] + 1):
        weight = 1.0 if j == 0 else far[:, j - 1 : j]
        out[:, j * season : j * season + p + 1] += weight * one
    return out[:, 1:]


def arma(free: np.ndarray, order: tuple[int, int, int, int], season: int) -> tuple[np.ndarray, np.ndarray]:
    """phi (of earlier values) and theta (of earlier errors) of order (p, q, seasonal p, seasonal q)."""
    p, q, sp, sq = order
    cuts = np.cumsum([p, q, sp])
    near_ar, near_ma, far_ar, far_ma = (stationary(x) for x in np.split(free, cuts, axis=1))
    return -_seasonal_product(-near_ar, -far_ar, season), _seasonal_product(near_ma, far_ma, season)


def kalman(data: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Innovations (series, step, column), their variances for unit noise, the state ahead of the end, and phi in full.

    data: (series, step, column); a step is missing where its first column is nan. All columns share the filter.
    """
    n, steps, columns = data.shape
    r = max(phi.shape[1], theta.shape[1] + 1)
    phi, load = np.pad(phi, ((0, 0), (0, r - phi.shape[1]))), np.pad(theta, ((0, 0), (1, r - 1 - theta.shape[1])))
    load[:, 0] = 1
    noise = load[:, :, None] * load[:, None, :]

    def ahead(x: np.ndarray) -> np.ndarray:
        """The transition applied to the rows of x."""
        out = phi[:, :, None] * x[:, :1]
        out[:, :-1] += x[:, 1:]
        return out

    power = np.zeros((n, r, r))
    power[:, :, 0] = phi
    power[:, np.arange(r - 1), np.arange(1, r)] = 1
    spread = noise.copy()
    for _ in range(14):  # sums of 2, 4, 8, ... terms
        spread = spread + power @ spread @ power.transpose(0, 2, 1)
        power = power @ power
    seen = ~np.isnan(data[:, :, 0])
    filled = np.where(seen[:, :, None], data, 0.0)
    state = np.zeros((n, r, columns))
    innovations, variances = np.zeros(data.shape), np.ones((n, steps))
    settled = False
    for t in range(steps):
        here = seen[:, t]
        if not settled:
            f = spread[:, 0, 0]
            gain = spread[:, :, 0] / f[:, None]
        v = np.where(here[:, None], filled[:, t] - state[:, 0], 0.0)
        innovations[:, t], variances[:, t] = v, np.where(here, f, 1.0)
        state = ahead(state + gain[:, :, None] * v[:, None, :])
        if not settled:
            cut = np.where(here[:, None, None], spread - gain[:, :, None] * spread[:, :1], spread)
            new = ahead(ahead(cut).transpose(0, 2, 1)).transpose(0, 2, 1) + noise
            settled = bool(seen[:, t:].all()) and np.abs(new - spread).max() < 1e-10
            spread = new
    return innovations, variances, state, phi


def _weights(innovations: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Least squares of the regressors' columns, one weight a column; columns without spread get 0."""
    scaled = innovations / np.sqrt(variances)[:, :, None]
    y, x = scaled[:, :, 0], scaled[:, :, 1:]
    if not x.shape[2]:
        return np.zeros((len(x), 0))
    gram = np.einsum("nta,ntb->nab", x, x)
    size = np.sqrt(np.einsum("naa->na", gram))
    size[size == 0] = 1
    gram = gram / size[:, :, None] / size[:, None, :] + 1e-10 * np.eye(x.shape[2])
    return np.linalg.solve(gram, np.einsum("nta,nt->na", x, y)[:, :, None] / size[:, :, None])[:, :, 0] / size


def arma_fit(data: np.ndarray, order: tuple[int, int, int, int], season: int, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Free parameters and -2 log likelihood of every row; data as in kalman, the first column being the series."""
    count = (~np.isnan(data[:, :, 0])).sum(1)

    def cost(rows: np.ndarray, free: np.ndarray) -> np.ndarray:
        v, f, _, _ = kalman(data[rows], *arma(free, order, season))
        rest = v[:, :, 0] - np.einsum("nta,na->nt", v[:, :, 1:], _weights(v, f))
        n = np.maximum(count[rows], 1)
        return n * (np.log(2 * np.pi * np.maximum((rest**2 / f).sum(1) / n, 1e-12)) + 1) + np.log(f).sum(1)

    return simplex(cost, np.full((len(data), sum(order)), 0.1), 0.4, rounds)


def _difference_weights(d: int, seasonal: int, season: int) -> np.ndarray:
    out = np.ones(1)
    for lag, times in ((1, d), (season, seasonal)):
        for _ in range(times):
            out = np.convolve(out, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    return out


def _differenced(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Along the first axis; len(weights) - 1 rows shorter."""
    n = len(x) - len(weights) + 1
    return sum(w * x[len(weights) - 1 - j : len(weights) - 1 - j + n] for j, w in enumerate(weights))


def level_statistic(y: np.ndarray) -> float:
    """KPSS: large where the level wanders. 0.463 is its 5 % point."""
    e = y - y.mean()
    n, lags = len(y), int(4 * (len(y) / 100) ** 0.25)
    spread = (e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))) / n
    return float(np.square(np.cumsum(e)).sum() / n**2 / spread) if spread > 1e-12 else 0.0


def seasonal_strength(y: np.ndarray, season: int) -> float:
    """1 - the share of what is left of the detrended series without its season."""
    width = season + 1 - season % 2
    kernel = np.ones(width)
    if season % 2 == 0:
        kernel[[0, -1]] = 0.5
    trend = np.convolve(y, kernel / season, "valid")
    rest = y[width // 2 : width // 2 + len(trend)] - trend
    place = np.arange(len(rest)) % season
    left = rest - np.array([rest[place == s].mean() for s in range(season)])[place]
    return max(0.0, 1 - left.var() / rest.var()) if rest.var() > 1e-12 else 0.0


def _differences(y: np.ndarray, season: int) -> tuple[int, int]:
    seasonal = int(season > 1 and len(y) >= 3 * season and seasonal_strength(y, season) > 0.64)
    z, d = _differenced(y, _difference_weights(0, seasonal, season)), 0
    while d < 2 and len(z) > 10 and level_statistic(z) > 0.463:
        z, d = np.diff(z), d + 1
    return d, seasonal


class Arima:
    """Fitted models of all series; see auto_arima."""

    def __init__(self, n: int):
        self.score, self.order, self.free = np.full(n, np.inf), [(0, 0, 0, 0)] * n, [np.zeros(0)] * n
        self.differences: list[tuple[int, int]] = []


def auto_arima(series: list[np.ndarray], h: int, season: int = 1, x: list[np.ndarray] | None = None, ahead: list[np.ndarray] | None = None, most: tuple[int, int, int, int] = (3, 3, 1, 1), rounds: int = 120) -> tuple[np.ndarray, Arima]:
    """Forecasts (series, h) and the models. x: the regressors of each series; ahead: those of its next h steps."""
    n, found = len(series), Arima(len(series))
    width = x[0].shape[1] if x else 0
    worked, polys = [], []
    for i, y in enumerate(series):
        base = y
        if width and len(y) > width + 2:  # differences are judged without what the regressors explain
            design = np.column_stack([np.ones(len(y)), x[i]])
            base = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        d, seasonal = _differences(base, season)
        found.differences.append((d, seasonal))
        polys.append(_difference_weights(d, seasonal, season))
        mean = np.full(len(y) - len(polys[i]) + 1, 1.0 if d + seasonal <= 1 else 0.0)
        columns = [_differenced(y, polys[i]), mean, *([] if not width else _differenced(x[i], polys[i]).T)]
        worked.append(np.column_stack(columns))
    steps = max(map(len, worked))
    data = np.full((n, steps, 2 + width), np.nan)
    for i, w in enumerate(worked):
        data[i, steps - len(w) :] = w
    scale = np.array([np.std(w[:, 0]) or 1.0 for w in worked])
    data[:, :, 0] /= scale[:, None]
    count = np.array([len(w) for w in worked])
    seasonal_too = season > 1
    starts = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)]
    clip = lambda o: tuple(min(max(a, 0), b if j < 2 or seasonal_too else 0) for j, (a, b) in enumerate(zip(o, most, strict=True)))
    tried: list[set] = [set() for _ in range(n)]
    asked = {i: {clip(o) for o in starts} for i in range(n)}
    while asked:
        by_order: dict[tuple, list[int]] = {}
        for i, orders in asked.items():
            for o in orders - tried[i]:
                tried[i].add(o)
                if count[i] > sum(o) + width + 4:
                    by_order.setdefault(o, []).append(i)
        better = set()
        for o, rows in sorted(by_order.items()):
            free, value = arma_fit(data[rows], o, season, rounds)
            drift = np.array([sum(found.differences[i]) <= 1 for i in rows])
            score = aicc(value, count[rows], sum(o) + width + 1 + drift)
            for j, i in enumerate(rows):
                if score[j] < found.score[i] - 1e-8:
                    found.score[i], found.order[i], found.free[i] = score[j], o, free[j]
                    better.add(i)
        moves = [(1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1)]
        near = [tuple(s * a for a in m) for m in moves for s in (1, -1)]
        asked = {i: {clip(a + b for a, b in zip(found.order[i], m, strict=True)) for m in near} - tried[i] for i in better}
        asked = {i: o for i, o in asked.items() if o}
    out = np.full((n, h), np.nan)
    for o in set(found.order):
        rows = [i for i in range(n) if found.order[i] == o and np.isfinite(found.score[i])]
        if not rows:
            continue
        free = np.array([found.free[i] for i in rows]).reshape(len(rows), sum(o))
        v, f, state, phi = kalman(data[rows], *arma(free, o, season))
        weights = _weights(v, f)
        for j, i in enumerate(rows):
            own, path = state[j, :, 0] - state[j, :, 1:] @ weights[j], np.empty(h)
            d, seasonal = found.differences[i]
            columns = np.full((h, 1), 1.0 if d + seasonal <= 1 else 0.0)
            if width:
                columns = np.column_stack([columns, _differenced(np.vstack([x[i], ahead[i]]), polys[i])[-h:]])
            for t in range(h):
                path[t] = own[0] + columns[t] @ weights[j]
                own = phi[j] * own[0] + np.append(own[1:], 0.0)
            whole = list(series[i])
            for value in path * scale[i]:
                whole.append(value - sum(w * whole[-k] for k, w in enumerate(polys[i][1:], 1)))
            out[i] = whole[len(whole) - h :]
    return out, found


# Exponential smoothing


def _season_start(y: np.ndarray, season: int, kind: str) -> np.ndarray:
    """Seasonal effects of the first places of a row (counted from the matrix' left), from a centred moving average."""
    out = np.full((len(y), season), 1.0 if kind == "M" else 0.0)
    for i, row in enumerate(y):
        first = int(np.isnan(row).sum())
        some = row[first : first + max(3 * season, 2 * season + 2)]
        kernel = np.ones(season + 1 - season % 2)
        if season % 2 == 0:
            kernel[[0, -1]] = 0.5
        trend = np.convolve(some, kernel / season, "valid")
        inner = some[len(kernel) // 2 : len(kernel) // 2 + len(trend)]
        with np.errstate(all="ignore"):
            rest = inner / trend if kind == "M" else inner - trend
        place = (first + len(kernel) // 2 + np.arange(len(rest))) % season
        effect = np.array([rest[place == s].mean() for s in range(season)])
        out[i] = effect / effect.mean() if kind == "M" else effect - effect.mean()
    return out


def _smooth(y: np.ndarray, level: np.ndarray, trend: np.ndarray, seasonal: np.ndarray, kind: str, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray, phi: np.ndarray):
    """One pass: what was expected of each step, and the states behind the last."""
    n, steps = y.shape
    level, trend, seasonal, season = level.copy(), trend.copy(), seasonal.copy(), seasonal.shape[1]
    expected = np.full(y.shape, np.nan)
    here = ~np.isnan(y)
    whole = here.all(0)
    for t in range(steps):
        base, s = level + phi * trend, seasonal[:, t % season]
        mu = base * s if kind == "M" else base + s
        expected[:, t] = mu
        e = y[:, t] - mu
        by = e / s if kind == "M" else e
        new_level, new_trend = base + alpha * by, phi * trend + beta * by
        new_s = s + gamma * (e / base if kind == "M" else e)
        if whole[t]:
            level, trend, seasonal[:, t % season] = new_level, new_trend, new_s
        else:
            level, trend = np.where(here[:, t], new_level, level), np.where(here[:, t], new_trend, trend)
            seasonal[:, t % season] = np.where(here[:, t], new_s, s)
    return expected, level, trend, seasonal


def ets_forms(season: int) -> list[tuple[str, str, str]]:
    """(error, trend, season): added errors with a multiplied season are left out, as their variance is unstable."""
    kinds = ("N", "A", "M") if season > 1 else ("N",)
    return [f for f in product("AM", ("N", "A", "D"), kinds) if f[0] == "M" or f[2] != "M"]


def ets_fit(y: np.ndarray, form: tuple[str, str, str], season: int, rounds: int = 150):
    """Score by AICc of every row, the fitted parts, and a function that gives forecasts of rows."""
    error, trended, kind = form
    n, steps = y.shape
    count = (~np.isnan(y)).sum(1)
    season = season if kind != "N" else 1
    seasonal = _season_start(y, season, kind) if kind != "N" else np.zeros((n, 1))
    effect = np.tile(seasonal, (1, steps // season + 1))[:, :steps]
    clear = y / effect if kind == "M" else y - effect
    width = np.nanstd(clear, axis=1) + 1e-9
    firsts = [row[~np.isnan(row)][: max(10, 2 * season)] for row in clear]
    lines = np.array([np.polyfit(np.arange(len(f)), f, 1) for f in firsts])
    level0, trend0 = (lines[:, 1] - lines[:, 0], lines[:, 0]) if trended != "N" else (np.array([np.mean(f) for f in firsts]), np.zeros(n))

    def parts(rows: np.ndarray, x: np.ndarray):
        """Rates kept in the usual region: beta below alpha, gamma below 1 - alpha, damping in 0.8 to 0.98."""
        unit = 1 / (1 + np.exp(-x))
        alpha = 0.0001 + 0.9998 * unit[:, 0]
        at = 2
        beta, phi, trend, gamma = np.zeros(len(x)), np.full(len(x), float(trended != "N")), trend0[rows], np.zeros(len(x))
        if trended != "N":
            beta, trend, at = alpha * unit[:, at], trend + x[:, at + 1] * width[rows] / 5, at + 2
        if trended == "D":
            phi, at = 0.8 + 0.18 * unit[:, at], at + 1
        if kind != "N":
            gamma = (1 - alpha) * unit[:, at]
        return level0[rows] + x[:, 1] * width[rows], trend, seasonal[rows], kind, alpha, beta, gamma, phi

    def cost(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        expected = _smooth(y[rows], *parts(rows, x))[0]
        e = y[rows] - expected
        here, m = ~np.isnan(y[rows]), count[rows]
        if error == "A":
            return m * np.log(np.maximum(np.where(here, e**2, 0).sum(1) / m, 1e-12))
        positive = np.where(here, expected > 0, True).all(1)
        safe = np.where(here & (expected > 0), expected, 1.0)
        value = m * np.log(np.maximum(np.where(here, (e / safe) ** 2, 0).sum(1) / m, 1e-12)) + 2 * np.log(safe).sum(1)
        return np.where(positive, value, np.inf)

    k = 2 + 2 * (trended != "N") + (trended == "D") + (kind != "N")
    start = np.zeros((n, k))
    start[:, 0] = -1.0
    if trended != "N":
        start[:, 2] = -2.0
    if kind != "N":
        start[:, -1] = -2.0
    x, value = simplex(cost, start, 0.6, rounds)

    def ahead(rows: np.ndarray, h: int) -> np.ndarray:
        got = parts(rows, x[rows])
        _, level, trend, s = _smooth(y[rows], *got)
        phi = got[-1]
        grown = np.cumsum(phi[:, None] ** np.arange(1, h + 1), axis=1)
        base, place = level[:, None] + grown * trend[:, None], s[:, (steps + np.arange(h)) % season]
        return base * place if kind == "M" else base + place

    return aicc(value, count, k + 1 + (season - 1 if kind != "N" else 0)), ahead


def auto_ets(series: list[np.ndarray], h: int, season: int = 1, rounds: int = 150) -> tuple[np.ndarray, list[tuple[str, str, str] | None]]:
    """Forecasts (series, h) and the chosen form of each series; series of fewer than 4 values keep their last one."""
    n = len(series)
    best, out, chosen = np.full(n, np.inf), np.array([np.full(h, y[-1], float) for y in series]), [None] * n
    lengths = np.array([len(y) for y in series])
    positive = np.array([bool((y > 0).all()) for y in series])
    for form in ets_forms(season):
        error, _, kind = form
        ok = (lengths >= 4) & ((kind == "N") | (lengths >= 2 * season + 2)) & (positive | ((error == "A") & (kind != "M")))
        rows = np.flatnonzero(ok)
        if not len(rows):
            continue
        score, ahead = ets_fit(stack([series[i] for i in rows]), form, season, rounds)
        better = np.flatnonzero(score < best[rows] - 1e-8)
        if len(better):
            made = ahead(better, h)
            fine = np.isfinite(made).all(1)
            best[rows[better[fine]]], out[rows[better[fine]]] = score[better[fine]], made[fine]
            for i in rows[better[fine]]:
                chosen[i] = form
    return out, chosen


# Theta


def _clear(y: np.ndarray, season: int, kind: str, h: int) -> tuple[np.ndarray, np.ndarray]:
    """The series without its season, and the effect at each step and at the next h."""
    effect = np.resize(_season_start(y[None, :], season, kind)[0], len(y) + h)
    return (y / effect[: len(y)] if kind == "M" else y - effect[: len(y)]), effect


def _seasonal(y: np.ndarray, season: int) -> bool:
    """Whether the autocorrelation at the season's lag passes a 10 % test."""
    if season < 2 or len(y) < 2 * season + 2:
        return False
    e = y - y.mean()
    r = np.array([e[j:] @ e[: len(e) - j] for j in range(1, season + 1)]) / max(e @ e, 1e-12)
    return abs(r[-1]) > 1.645 * np.sqrt((1 + 2 * np.square(r[:-1]).sum()) / len(y))


def _theta_fit(clear: list[np.ndarray], h: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and what was expected of each step, flush right."""
    y, n = stack(clear), len(clear)
    steps, lengths = y.shape[1], np.array([len(c) for c in clear])
    lines = np.array([np.polyfit(np.arange(len(c)), c, 1) if len(c) > 1 else (0.0, c[0]) for c in clear])
    slope, base = lines[:, 0], lines[:, 1]
    place = np.arange(steps)[None, :] - (steps - lengths)[:, None]
    width = np.nanstd(y, axis=1) + 1e-9

    def run(rows: np.ndarray, x: np.ndarray):
        alpha, rest = 0.0001 + 0.9998 / (1 + np.exp(-x[:, 0])), 1 - 1 / (1 + np.exp(np.minimum(x[:, 1], 5)))
        level, expected = y[rows, steps - lengths[rows]] + x[:, 2] * width[rows] * 0.5, np.full((len(rows), steps), np.nan)
        for t in range(steps):
            i = np.maximum(place[rows, t], 0)
            kept = (1 - alpha) ** i
            expected[:, t] = level + rest * (base[rows] * kept + slope[rows] * (1 - kept * (1 - alpha)) / alpha)
            level = np.where(place[rows, t] >= 0, level + alpha * (np.nan_to_num(y[rows, t]) - level), level)
        return expected, level, alpha, rest

    x, _ = simplex(lambda rows, x: np.nansum((y[rows] - run(rows, x)[0]) ** 2, axis=1), np.zeros((n, 3)), 0.5, rounds)
    expected, level, alpha, rest = run(np.arange(n), x)
    kept = (1 - alpha) ** lengths
    first = base * kept + slope * (1 - kept * (1 - alpha)) / alpha
    return level[:, None] + rest[:, None] * (first[:, None] + slope[:, None] * np.arange(h)), expected


def auto_theta(series: list[np.ndarray], h: int, season: int = 1, rounds: int = 150) -> np.ndarray:
    """A trend line and a smoothed series of `theta` times its curvature, mixed; rate, start and theta by the simplex.

    A season that shows is taken off, or divided out where all values are positive, whichever fits the past better.
    """
    out, best = np.full((len(series), h), np.nan), np.full(len(series), np.inf)
    shows = np.array([_seasonal(y, season) for y in series])
    positive = np.array([bool((y > 0).all()) for y in series])
    for kind, ok in (("N", ~shows), ("A", shows), ("M", shows & positive)):
        rows = np.flatnonzero(ok)
        if not len(rows):
            continue
        cleared = [_clear(series[i], season, kind, h) if kind != "N" else (series[i], np.zeros(len(series[i]) + h)) for i in rows]
        made, expected = _theta_fit([c for c, _ in cleared], h, rounds)
        for j, (i, (_, effect)) in enumerate(zip(rows, cleared, strict=True)):
            n = len(series[i])
            mean = expected[j, expected.shape[1] - n :]
            past, ahead = (mean * effect[:n], made[j] * effect[n:]) if kind == "M" else (mean + effect[:n], made[j] + effect[n:])
            sse = float(np.square(series[i] - past).sum())
            if sse < best[i]:
                best[i], out[i] = sse, ahead
    return out
