"""Seasonal ARIMA: exact Gaussian likelihood by a Kalman filter in numpy, orders by a stepwise search on AIC."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.operators.models import needed_diffs


def polynomial(own: np.ndarray, seasonal: np.ndarray, season: int, sign: float) -> np.ndarray:
    """Coefficients from lag 1 on of the product of (1 + sign own(L)) and (1 + sign seasonal(L^season)), times sign."""
    a = np.concatenate(([1.0], sign * own))
    b = np.zeros(len(seasonal) * season + 1)
    b[0] = 1.0
    b[season::season] = sign * seasonal
    return sign * np.convolve(a, b)[1:]


def stationary(partial: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients with these partial autocorrelations, all within -1 .. 1."""
    out = np.zeros(0)
    for r in partial:
        out = np.concatenate((out - r * out[::-1], [r]))
    return out


class Arma:
    """Stationary ARMA in state space; ar and ma are coefficients from lag 1 on, shocks have variance 1."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray):
        self.r = max(len(ar), len(ma) + 1)
        self.move = np.zeros((self.r, self.r))
        self.move[: len(ar), 0] = ar
        self.move[:-1, 1:] += np.eye(self.r - 1)
        load = np.zeros(self.r)
        load[0], load[1 : len(ma) + 1] = 1.0, ma
        self.shock = np.outer(load, load)

    def start(self) -> np.ndarray:
        total, move = self.shock.copy(), self.move.copy()
        for _ in range(60):
            step = move @ total @ move.T
            total, move = total + step, move @ move
            if np.abs(step).max() <= 1e-13 * np.abs(total).max():
                break
        return total

    def filtered(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(errors, their variances, the state's mean one step after the last row); a gap is nan and has no error."""
        mean, var = np.zeros(self.r), self.start()
        errors, sizes, steady = np.full(len(w), np.nan), np.full(len(w), np.nan), False
        move = self.move
        gain = None
        for t, x in enumerate(w):
            if x != x:
                mean, var, steady = move @ mean, move @ var @ move.T + self.shock, False
                continue
            error = x - mean[0]
            if not steady:
                size = var[0, 0]
                column = var[:, 0]
                gain = move @ column / size
                var = move @ (var - np.outer(column, column) / size) @ move.T + self.shock
                steady = abs(var[0, 0] - size) < 1e-10 and size < 1 + 1e-8
            errors[t], sizes[t] = error, size
            mean = move @ mean + gain * error
        return errors, sizes, mean

    def likelihood(self, w: np.ndarray, variance: float | None = None) -> tuple[float, float]:
        """(log likelihood, variance of shocks: the given one or the best)."""
        errors, sizes, _ = self.filtered(w)
        on = ~np.isnan(errors)
        n = int(on.sum())
        square = float((errors[on] ** 2 / sizes[on]).sum())
        v = square / n if variance is None else variance
        v = max(v, 1e-300)
        return -0.5 * (n * math.log(2 * math.pi * v) + float(np.log(sizes[on]).sum()) + square / v), v


def minimised(f, x: np.ndarray, rounds: int = 120, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Nelder and Mead's simplex from x."""
    n = len(x)
    if not n:
        return x, f(x)
    points = [x] + [x + 0.4 * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds * n):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < tolerance * (abs(values[0]) + 1e-9):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        value = f(tried)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            if (v := f(further)) < value:
                tried, value = further, v
        elif value >= values[-2]:
            tried = centre + 0.5 * ((tried if value < values[-1] else points[-1]) - centre)
            value = f(tried)
            if value >= values[-1]:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = tried, value
    k = int(np.argmin(values))
    return points[k], values[k]


def differenced(x: np.ndarray, d: int, seasonal: int, season: int) -> np.ndarray:
    for _ in range(seasonal):
        x = x[season:] - x[:-season]
    return np.diff(x, d) if d else x


@dataclass
class Fitted:
    order: tuple[int, int, int, int]  # p, q, P, Q
    mean: float
    model: Arma
    aic: float


def fit(w: np.ndarray, order: tuple[int, int, int, int], season: int, mean: bool) -> Fitted:
    """The ARMA of this order for differenced values w; coefficients stay stationary and invertible."""
    p, q, sp, sq = order
    base = float(np.nanmean(w)) if mean else 0.0
    z = w - base
    cut = np.cumsum([p, q, sp, sq])[:-1]

    def model(x: np.ndarray) -> Arma:
        ar, ma, sar, sma = (stationary(0.98 * np.tanh(part)) for part in np.split(x, cut))
        return Arma(polynomial(ar, sar, season, -1.0), polynomial(-ma, -sma, season, 1.0))

    x, least = minimised(lambda x: -model(x).likelihood(z)[0], np.full(sum(order), 0.1))
    return Fitted(order, base, model(x), 2 * least + 2 * (sum(order) + 1 + mean))


def search(w: np.ndarray, season: int, mean: bool, most: tuple[int, int, int, int]) -> Fitted:
    """From the empty order on, the neighbour (one order up or down, or p and q together) of least AIC, until none is better."""
    seen: dict[tuple, Fitted] = {}

    def at(order: tuple) -> Fitted:
        if order not in seen:
            seen[order] = fit(w, order, season, mean)
        return seen[order]

    best = at((0, 0, 0, 0))
    while True:
        steps = [s for k in range(4) for s in (np.eye(4, dtype=int)[k], -np.eye(4, dtype=int)[k])] + [np.asarray([1, 1, 0, 0]), np.asarray([-1, -1, 0, 0])]
        around = [tuple(int(v) for v in np.add(best.order, s)) for s in steps]
        found = min((at(o) for o in around if all(0 <= v <= m for v, m in zip(o, most))), key=lambda f: f.aic, default=best)
        if found.aic >= best.aic - 1e-8:
            return best
        best = found


def seasonal_strength(x: np.ndarray, season: int) -> float:
    """Share of the detrended variance that the seasons' means explain."""
    if season % 2 == 0:
        weights = np.concatenate(([0.5], np.ones(season - 1), [0.5])) / season
    else:
        weights = np.ones(season) / season
    half = len(weights) // 2
    rest = x[half : len(x) - half] - np.convolve(x, weights, "valid")
    phase = np.arange(len(rest)) % season
    means = np.asarray([np.nanmean(rest[phase == k]) for k in range(season)])
    noise = rest - means[phase]
    whole = np.nanvar(rest)
    return max(0.0, 1 - np.nanvar(noise) / whole) if whole > 1e-300 else 0.0


def forecast(x: np.ndarray, steps: int, season: int = 1, fast: bool = True, least: int = 36) -> tuple[np.ndarray, str]:
    """(values, status): SARIMA's forecast after x's last value; the last value itself for short series and failures.

    Status: no_steps, empty_series, too_short_locf, ok, failed_locf. Gaps before the first value are left out, others
    stay gaps. fast: orders up to 1 without seasonal ones; else up to 2, seasonal ones up to 1.
    """
    known = np.flatnonzero(~np.isnan(x))
    if steps <= 0:
        return np.zeros(0), "no_steps"
    if not len(known):
        return np.full(steps, np.nan), "empty_series"
    x = x[known[0] : known[-1] + 1]
    if len(known) < least:
        return np.full(steps, x[-1]), "too_short_locf"
    try:
        whole = np.interp(np.arange(len(x)), known - known[0], x[known - known[0]])
        up = int(season > 1 and len(x) >= 3 * season and seasonal_strength(whole, season) > 0.64)
        d = needed_diffs(differenced(whole, 0, up, season), most=2 - up)
        w = differenced(x, d, up, season)
        scale = float(np.nanstd(w)) or 1.0
        most = (1, 1, 0, 0) if fast or season == 1 else (2, 2, 1, 1)
        best = search(w / scale, season, d + up < 2, most if not (fast and season == 1) else (1, 1, 0, 0))
        errors, _, mean = best.model.filtered(w / scale - best.mean)
        ahead = []
        for _ in range(steps):
            ahead.append((mean[0] + best.mean) * scale)
            mean = best.model.move @ mean
        out = np.asarray(ahead)
        for k in range(d - 1, -1, -1):
            out = differenced(whole, k, up, season)[-1] + np.cumsum(out)
        if up:
            tail = list(whole[-season:])
            for v in out:
                tail.append(v + tail[-season])
            out = np.asarray(tail[season:])
        if not np.isfinite(out).all():
            raise ValueError("not finite")
        return out, "ok"
    except (ValueError, np.linalg.LinAlgError, FloatingPointError):
        return np.full(steps, x[-1]), "failed_locf"


def ragged_forecasts(panel: DataFrame, until: str, season: int = 1, fast: bool = True, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series_id, period_date, value, status for the months after each series' last value up to ``until``."""
    end = pd.Timestamp(until)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=[value]).sort_values(date)
        if d.empty:
            return pd.DataFrame(columns=[series, date, value, "status"])
        own = pd.Series(d[value].to_numpy(float), pd.DatetimeIndex(pd.to_datetime(d[date])).to_period("M"))
        own = own[~own.index.duplicated(keep="last")]
        own = own.reindex(pd.period_range(own.index[0], own.index[-1], freq="M"))
        months = pd.date_range(own.index[-1].to_timestamp() + pd.offsets.MonthEnd(2), end, freq="ME")
        out, status = forecast(own.to_numpy(), len(months), season, fast)
        return pd.DataFrame({series: key[0], date: months.date, value: out, "status": status})

    return panel.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} string, {date} date, {value} double, status string")
