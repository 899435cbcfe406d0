"""Statistical models in numpy: pure functions, and their application per group with applyInPandas.

Groups are series, folds or vintages, bounded by construction (a panel's months), so one group always fits one task.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CRITICAL, LEVELS = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]  # KPSS, level stationarity (fixed values)


def kpss(x: np.ndarray) -> float | None:
    """p-value of level stationarity, within 0.01 .. 0.10; None under 10 values or without variance."""
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 10:
        return None
    r = x - x.mean()
    if not (r @ r) > 0:
        return None
    gamma = lambda i: float(r[i:] @ r[: n - i])
    c = int(n ** (2 / 9))
    s0, s1 = (r @ r) / n, 0.0
    for i in range(1, c + 1):
        g = 2 * gamma(i) / n
        s0, s1 = s0 + g, s1 + i * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    var = ((r @ r) + 2 * sum((1 - i / (lags + 1)) * gamma(i) for i in range(1, lags + 1))) / n
    stat = float((np.cumsum(r) ** 2).sum()) / n**2 / var
    return float(np.interp(stat, CRITICAL, LEVELS))


#: Dickey-Fuller's tau with a constant: largest statistic of the left branch, and both branches' response surfaces
#: (MacKinnon 1994; fixed values).
TAU_STAR, TAU_SMALL, TAU_LARGE = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf(x: np.ndarray, least: int = 15) -> tuple[float, float, int] | None:
    """(statistic, p-value, lags) of the augmented Dickey-Fuller test with a constant; None under ``least`` values or
    without variance. The number of lags has the least AIC on the sample that all of them share."""
    x = x[~np.isnan(x)]
    n = len(x)
    if n < least or not x.std() > 0:
        return None
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def regression(lags: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = d[first:]
        z = np.column_stack([x[first:-1], np.ones(len(y)), *(d[first - k : len(d) - k] for k in range(1, lags + 1))])
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        return z, b, y - z @ b

    def score(lags: int) -> float:
        z, _, e = regression(lags, most)
        return len(e) * math.log(max(e @ e / len(e), 1e-300)) + 2 * z.shape[1]

    lags = min(range(most + 1), key=lambda k: (score(k), k))
    z, b, e = regression(lags, lags)
    free = len(e) - z.shape[1]
    if free < 1:
        return None
    spread = math.sqrt(max(e @ e / free * np.linalg.pinv(z.T @ z)[0, 0], 1e-300))
    stat = float(b[0] / spread)
    if stat > 2.74:
        return stat, 1.0, lags
    surface = TAU_SMALL if stat <= TAU_STAR else TAU_LARGE
    return stat, 0.5 * math.erfc(-sum(c * max(stat, -18.83) ** k for k, c in enumerate(surface)) / math.sqrt(2)), lags


def needed_diffs(x: np.ndarray, alpha: float = 0.05, most: int = 2) -> int:
    """How many first differences, up to ``most``, until level stationarity is no longer rejected."""
    for d in range(most):
        p = kpss(np.diff(x, d) if d else x)
        if p is None or p >= alpha:
            return d
    return most


class Model(ABC):
    """fit on a training frame (features and target columns), predict rows of features."""

    @abstractmethod
    def fit(self, x: np.ndarray, y: np.ndarray) -> Model: ...

    @abstractmethod
    def predict(self, x: np.ndarray) -> np.ndarray: ...


def _filled(x: np.ndarray, with_: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), with_, x)


class Standardised:
    """Median filling and scaling by the training window's own numbers."""

    def _learn(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            self.median = np.nan_to_num(np.nanmedian(x, axis=0)) if len(x) else np.zeros(x.shape[1])
        f = _filled(x, self.median)
        self.mean, sd = f.mean(axis=0), f.std(axis=0)
        self.sd = np.where(sd > 1e-12, sd, 1.0)
        return (f - self.mean) / self.sd

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return (_filled(x, self.median) - self.mean) / self.sd


def coordinate_descent(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, w: np.ndarray | None = None, rounds: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Weights of |y - x w|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|_2^2 (y and x centred)."""
    n, k = x.shape
    w = np.zeros(k) if w is None else w.copy()
    norm, rest = (x**2).sum(axis=0) / n, y - x @ w
    for _ in range(rounds):
        moved = 0.0
        for j in range(k):
            if not norm[j]:
                continue
            old = w[j]
            rho = x[:, j] @ rest / n + norm[j] * old
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (norm[j] + alpha * (1 - l1))
            if w[j] != old:
                rest -= x[:, j] * (w[j] - old)
                moved = max(moved, abs(w[j] - old))
        if moved < tol:
            break
    return w


class ElasticNet(Standardised, Model):
    """With a fixed alpha, or chosen with l1 by forward-chaining validation."""

    def __init__(self, alpha: float | None = None, l1: float | tuple[float, ...] = (0.1, 0.5, 0.9, 1.0), folds: int = 3, path: int = 20):
        self.alpha, self.l1, self.folds, self.path = alpha, (l1,) if isinstance(l1, float) else l1, folds, path

    def fit(self, x, y):
        z = self._learn(x)
        self.base = y.mean()
        best = (math.inf, self.alpha or 0.0, self.l1[0])
        if self.alpha is None:
            size = max(1, len(y) // (self.folds + 1))
            for l1 in self.l1:
                top = np.abs(z.T @ (y - self.base)).max() / (len(y) * l1) or 1.0
                errors = np.zeros(self.path)
                alphas = top * np.logspace(0, -3, self.path)
                for k in range(1, self.folds + 1):
                    cut, end = len(y) - (self.folds - k + 1) * size, len(y) - (self.folds - k) * size
                    if cut < 2:
                        continue
                    m, w = y[:cut].mean(), None
                    for i, a in enumerate(alphas):
                        w = coordinate_descent(z[:cut], y[:cut] - m, a, l1, w, rounds=60, tol=1e-5)
                        errors[i] += ((y[cut:end] - m - z[cut:end] @ w) ** 2).mean()
                i = int(errors.argmin())
                best = min(best, (errors[i], alphas[i], l1))
        self.chosen = best[1:]
        self.w = coordinate_descent(z, y - self.base, *self.chosen)
        return self

    def predict(self, x):
        return self.base + self._scale(x) @ self.w


class Ridge(Standardised, Model):
    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, x, y):
        z = self._learn(x)
        self.base = y.mean()
        self.w = np.linalg.solve(z.T @ z + self.alpha * np.eye(z.shape[1]), z.T @ (y - self.base))
        return self

    predict = ElasticNet.predict


class PrincipalComponents(Standardised, Model):
    """Least squares on the first k principal components of the training window."""

    def __init__(self, k: int = 3):
        self.k = k

    def fit(self, x, y):
        z = self._learn(x)
        _, _, v = np.linalg.svd(z, full_matrices=False)
        self.v = v[: self.k].T
        f = np.column_stack([np.ones(len(z)), z @ self.v])
        self.b = np.linalg.lstsq(f, y, rcond=None)[0]
        return self

    def predict(self, x):
        return np.column_stack([np.ones(len(x)), self._scale(x) @ self.v]) @ self.b


def ar_forecast(x: np.ndarray, p: int, steps: int) -> np.ndarray:
    """Least-squares AR(p) with intercept, iterated; the last value where there are too few to fit."""
    x = x[~np.isnan(x)]
    if not len(x):
        return np.full(steps, np.nan)
    if len(x) < p + 2:
        return np.full(steps, x[-1])
    design = np.column_stack([np.ones(len(x) - p), *(x[p - k - 1 : len(x) - k - 1] for k in range(p))])
    b = np.linalg.lstsq(design, x[p:], rcond=None)[0]
    seen = list(x)
    for _ in range(steps):
        seen.append(b[0] + sum(b[k + 1] * seen[-k - 1] for k in range(p)))
    return np.asarray(seen[-steps:]) if steps else np.zeros(0)


def auto_ar(x: np.ndarray, steps: int, most: int = 2, least: int = 36) -> tuple[np.ndarray, str]:
    """(values, status): AR order by AIC on data differenced until stationary; the last value for short series."""
    x = x[~np.isnan(x)]
    if not len(x):
        return np.full(steps, np.nan), "empty_series"
    if steps <= 0:
        return np.zeros(0), "no_steps"
    if len(x) < least:
        return np.full(steps, x[-1]), "too_short_locf"
    d = needed_diffs(x, most=1)
    z = np.diff(x, d) if d else x
    scores = []
    for p in range(most + 1):
        design = np.column_stack([np.ones(len(z) - most), *(z[most - k - 1 : len(z) - k - 1] for k in range(p))])
        e = z[most:] - design @ np.linalg.lstsq(design, z[most:], rcond=None)[0]
        scores.append((len(e) * np.log(max(e @ e / len(e), 1e-300)) + 2 * (p + 1), p))
    out = ar_forecast(z, min(scores)[1], steps)
    out = x[-1] + np.cumsum(out) if d else out
    return (out, "ok") if np.isfinite(out).all() else (np.full(steps, x[-1]), "failed_locf")


def var_design(y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([np.ones(len(y) - lags), *(y[lags - k : len(y) - k] for k in range(1, lags + 1))]), y[lags:]


def bvar_fit(y: np.ndarray, lags: int = 2, tight: float = 0.1, cross: float = 0.5, decay: float = 1.0) -> np.ndarray:
    """Posterior-mean coefficients (1 + lags * k rows, a column for each equation) under the Minnesota prior."""
    x, target = var_design(y, lags)
    k, sd = y.shape[1], y.std(axis=0) + 1e-8
    # A row for each coefficient, a column for each equation; the intercept is all but free.
    lag, variable = np.divmod(np.arange(lags * k), k)
    spread = tight / (lag + 1.0)[:, None] ** decay * np.where(variable[:, None] == np.arange(k), 1.0, cross * sd[variable][:, None] / sd)
    precision = np.vstack([np.full((1, k), 1e-6), 1 / np.clip(spread**2, 1e-12, None)])
    mean = np.zeros((1 + lags * k, k))
    mean[1 : 1 + k] = np.eye(k)
    out = np.empty_like(mean)
    for j in range(k):
        out[:, j] = np.linalg.solve(x.T @ x + np.diag(precision[:, j]), x.T @ target[:, j] + precision[:, j] * mean[:, j])
    return out


def var_forecast(y: np.ndarray, b: np.ndarray, lags: int, steps: int) -> np.ndarray:
    seen = [r for r in y[-lags:]]
    for _ in range(steps):
        seen.append(np.concatenate([[1.0], *(seen[-k] for k in range(1, lags + 1))]) @ b)
    return np.asarray(seen[lags:])


def var_fit(y: np.ndarray, lags: int = 2) -> np.ndarray:
    return np.linalg.lstsq(*var_design(y, lags), rcond=None)[0]


# Application per group ----------------------------------------------------------------------------------------------


def kpss_by_series(panel: DataFrame, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series_id, n, p_value, diffs_needed."""

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values(date)[value].to_numpy(float)
        return pd.DataFrame([(key[0], int((~np.isnan(x)).sum()), kpss(x), needed_diffs(x[~np.isnan(x)]))], columns=[series, "n", "p_value", "diffs_needed"])

    return panel.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} string, n long, p_value double, diffs_needed int")


def adf_by_series(panel: DataFrame, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series_id, n, statistic, p_value, lags; nulls where a series is too short or constant."""

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values(date)[value].to_numpy(float)
        return pd.DataFrame([(key[0], int((~np.isnan(x)).sum()), *(adf(x) or (None, None, None)))], columns=[series, "n", "statistic", "p_value", "lags"])

    return panel.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} string, n long, statistic double, p_value double, lags int")


def ragged_fill(panel: DataFrame, until: str, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """series_id, period_date, value, status for the months after each series' last value up to ``until``."""
    end = pd.Timestamp(until)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=[value]).sort_values(date)
        if d.empty:
            return pd.DataFrame(columns=[series, date, value, "status"])
        months = pd.date_range(pd.Timestamp(d[date].iloc[-1]) + pd.offsets.MonthEnd(1), end, freq="ME")
        out, status = auto_ar(d[value].to_numpy(float), len(months))
        return pd.DataFrame({series: key[0], date: months.date, value: out, "status": status})

    return panel.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} string, {date} date, {value} double, status string")


def _wide(d: pd.DataFrame, series: str, date: str, value: str) -> pd.DataFrame:
    return d.pivot_table(index=date, columns=series, values=value, aggfunc="last").sort_index()


def bvar_by_group(panel: DataFrame, group: str, lags: int = 2, steps: int = 3, bayes: bool = True, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """group, series_id, step, predicted from a VAR over the group's series; series half empty or more are left out."""

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        w = _wide(d, series, date, value)
        w = w.loc[:, w.notna().mean() > 0.5].ffill().bfill()
        names = [f"{group}", series, "step", "predicted"]
        if w.shape[1] == 0 or len(w) < 8:
            return pd.DataFrame(columns=names)
        y = w.to_numpy(float)
        p = max(1, min(lags, (len(y) - 1) // max(1, y.shape[1]) or 1))
        out = var_forecast(y, bvar_fit(y, p) if bayes else var_fit(y, p), p, steps)
        return pd.DataFrame([(key[0], s, t + 1, float(out[t, j])) for t in range(steps) for j, s in enumerate(w.columns)], columns=names)

    return panel.select(group, series, date, value).groupBy(group).applyInPandas(run, f"{group} string, {series} string, step int, predicted double")


MODELS: dict[str, type[Model]] = {"elastic_net": ElasticNet, "ridge": Ridge, "pca_regression": PrincipalComponents}


def bridge(panel: DataFrame, target: DataFrame, p: int = 2, rule: str = "mean", series: str = "series_id", date: str = "period_date", value: str = "value", y: str = "y") -> DataFrame:
    """series_id, target_date, predicted: each series is carried by AR(p) to its quarter's end, averaged, and regressed on."""
    q = target.select(date, y).toPandas().dropna() if target.limit(10_001).count() <= 10_000 else None  # one low-frequency series
    if q is None:
        raise ValueError("the target of a bridge equation is one series")
    q = q.set_index(pd.PeriodIndex(pd.to_datetime(q[date]), freq="Q"))[y]

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=[value]).sort_values(date)
        names = [series, "target_date", "predicted"]
        if len(d) < p + 3:
            return pd.DataFrame(columns=names)
        last = pd.Timestamp(d[date].iloc[-1])
        end = last.to_period("Q").end_time.normalize()
        months = pd.date_range(last + pd.offsets.MonthEnd(1), end, freq="ME")
        full = pd.Series([*d[value].astype(float), *ar_forecast(d[value].to_numpy(float), p, len(months))], index=pd.DatetimeIndex([*pd.to_datetime(d[date]), *months]))
        low = full.groupby(full.index.to_period("Q")).agg(rule)
        both = pd.concat([low.rename("x"), q.rename("y")], axis=1).dropna()
        both = both[both.index < low.index[-1]]
        if len(both) < 4:
            return pd.DataFrame(columns=names)
        b = np.linalg.lstsq(np.column_stack([np.ones(len(both)), both["x"]]), both["y"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame([(key[0], end.date(), float(b[0] + b[1] * low.iloc[-1]))], columns=names)

    return panel.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} string, target_date date, predicted double")


def evaluated(built: DataFrame, model: str, params: dict | None = None, series: str = "series_id", date: str = "period_date", value: str = "value") -> DataFrame:
    """target_quarter, label, model, predicted, n_train, n_features, status: each vintage is fitted in a task of its own.

    built comes from vintage.build: its target rows have the series "__target"; the last one, of the target quarter, is
    what is predicted, from the features known at the cutoff (each one's last value where the quarter has none yet).
    """
    from palimpsest.operators.backtests import model_class

    kind, options = model_class(model), params or {}
    names = ["target_quarter", "label", "model", "predicted", "n_train", "n_features", "status"]

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        w = _wide(d, series, date, value)
        if not any(pd.Timestamp(i) == pd.Timestamp(key[0]) for i in w.index):  # nothing is known of the target quarter yet
            w.loc[pd.Timestamp(key[0]) if isinstance(w.index, pd.DatetimeIndex) else key[0]] = np.nan
        predicted, n_train, n_features, status = np.nan, 0, 0, "failed: no target"
        at = np.asarray([pd.Timestamp(i) == pd.Timestamp(key[0]) for i in w.index])
        if "__target" in w and at.any():
            train = w["__target"].notna().to_numpy() & ~at
            f = w.drop(columns="__target").astype(float)
            if f[at].isna().all(axis=None):
                f[at] = f.ffill()[at]  # the last known values stand for a quarter that has none
            f = f.loc[:, (f[train].notna().sum() > 1) & f[at].notna().any()]
            n_train, n_features = int(train.sum()), f.shape[1]
            try:
                if n_train < 5 or n_features == 0:
                    raise ValueError("too little data")
                predicted = float(kind(**options).fit(f[train].to_numpy(float), w.loc[train, "__target"].to_numpy(float)).predict(f[at].to_numpy(float))[-1])
                status = "success"
            except (ValueError, np.linalg.LinAlgError) as e:
                status = f"failed: {e}"
        return pd.DataFrame([(key[0], int(key[1]), model, None if np.isnan(predicted) else predicted, n_train, n_features, status)], columns=names)

    schema = "target_quarter date, label int, model string, predicted double, n_train int, n_features int, status string"
    return built.select("target_quarter", "label", series, date, value).groupBy("target_quarter", "label").applyInPandas(run, schema)
