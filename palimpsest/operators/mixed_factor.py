"""Mixed-frequency dynamic factor model: monthly and quarterly series on monthly factors, with AR(1) remainders.

A monthly series is x_t = L f_t + e_t; a quarterly one, seen in its quarter's last month, is the weighted sum over five
months of the same kind of series, L sum_j w_j f_{t-j} + sum_j w_j e_{t-j}. Factors follow a vector autoregression, and
every remainder e an AR(1) of its own. All of them are states of one Kalman filter, so each month without a quarterly
value still moves the factors. Gaps may be anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from palimpsest.operators.models import Model

#: Weights of a quarterly growth rate as a sum of monthly ones, by lag.
GROWTH = np.asarray([1.0, 2.0, 3.0, 2.0, 1.0]) / 3
#: Variance of the measurement, which keeps the filter's matrices regular.
NOISE = 1e-4


@dataclass
class MixedParameters:
    loadings: np.ndarray  # series x factors
    transition: np.ndarray  # factors x (factors * order)
    shocks: np.ndarray  # factors x factors
    decay: np.ndarray  # of each series' remainder
    spread: np.ndarray  # variance of each remainder's shock
    quarterly: np.ndarray  # for each series whether it is
    weights: np.ndarray = None

    def __post_init__(self):
        self.weights = GROWTH if self.weights is None else self.weights
        self.k = self.loadings.shape[1]
        self.order = self.transition.shape[1] // self.k
        self.lags = max(self.order, len(self.weights) if self.quarterly.any() else 1)
        depth = np.where(self.quarterly, len(self.weights), 1)
        self.first = self.k * self.lags + np.cumsum(depth) - depth  # of each series' remainder in the state
        self.size = self.k * self.lags + int(depth.sum())

    def system(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(transition, variance of shocks, observation matrix) of the whole state."""
        k, m = self.k, self.size
        move, shocks = np.zeros((m, m)), np.zeros((m, m))
        move[:k, : k * self.order], shocks[:k, :k] = self.transition, self.shocks
        move[k : k * self.lags, : k * (self.lags - 1)] = np.eye(k * (self.lags - 1))
        for i, at in enumerate(self.first):
            move[at, at], shocks[at, at] = self.decay[i], self.spread[i]
            for j in range(1, len(self.weights) if self.quarterly[i] else 1):
                move[at + j, at + j - 1] = 1.0
        return move, shocks, np.vstack([self.loadings[i] @ self.carrier(i) + self.remainder(i) for i in range(len(self.loadings))])

    def carrier(self, i: int) -> np.ndarray:
        """factors x state: what the series' loadings multiply."""
        out = np.zeros((self.k, self.size))
        for j, w in enumerate(self.weights if self.quarterly[i] else (1.0,)):
            out[:, self.k * j : self.k * (j + 1)] = w * np.eye(self.k)
        return out

    def remainder(self, i: int) -> np.ndarray:
        out = np.zeros(self.size)
        w = self.weights if self.quarterly[i] else (1.0,)
        out[self.first[i] : self.first[i] + len(w)] = w
        return out

    def start(self) -> np.ndarray:
        """The stationary variance of the state by doubling; a wide one where the factors have none."""
        move, shocks, _ = self.system()
        if np.abs(np.linalg.eigvals(move)).max() >= 0.999:
            return 10 * np.eye(self.size)
        total = shocks.copy()
        for _ in range(40):
            step = move @ total @ move.T
            total, move = total + step, move @ move
            if np.abs(step).max() < 1e-12 * np.abs(total).max():
                break
        return (total + total.T) / 2


def smoothed(x: np.ndarray, p: MixedParameters, backward: bool = True) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, filtered means, smoothed means, smoothed variances, covariances of each state with the one before)."""
    move, shocks, see = p.system()
    m, steps = p.size, len(x)
    mean, var, total = np.zeros(m), p.start(), 0.0
    means, variances, filtered, kept = np.empty((steps, m)), np.empty((steps, m, m)), np.empty((steps, m)), []
    for t in range(steps):
        means[t], variances[t] = mean, var
        on = ~np.isnan(x[t])
        z = see[on]
        if on.any():
            cross = var @ z.T
            inverse = np.linalg.inv(z @ cross + NOISE * np.eye(len(z)))
            error = x[t, on] - z @ mean
            total -= 0.5 * (len(z) * np.log(2 * np.pi) - np.linalg.slogdet(inverse)[1] + error @ inverse @ error)
            gain = cross @ inverse
            filtered[t] = mean + gain @ error
            left = move - move @ gain @ z
            kept.append((z.T @ inverse @ error, z.T @ inverse @ z, left))
        else:
            filtered[t], left = mean, move
            kept.append((np.zeros(m), np.zeros((m, m)), move))
        mean = move @ filtered[t]
        var = left @ var @ move.T + shocks
        var = (var + var.T) / 2
    if not backward:
        return total, filtered, filtered, variances, variances
    smooth, smooth_var, lagged = np.empty((steps, m)), np.empty((steps, m, m)), np.zeros((steps, m, m))
    pull, weight = np.zeros(m), np.zeros((m, m))
    for t in range(steps - 1, -1, -1):
        own, information, left = kept[t]
        if t + 1 < steps:
            lagged[t + 1] = (variances[t] @ left.T @ (np.eye(m) - weight @ variances[t + 1])).T
        pull, weight = own + left.T @ pull, information + left.T @ weight @ left
        smooth[t] = means[t] + variances[t] @ pull
        smooth_var[t] = variances[t] - variances[t] @ weight @ variances[t]
    return total, filtered, smooth, smooth_var, lagged


def started(x: np.ndarray, quarterly: np.ndarray, factors: int, order: int) -> MixedParameters:
    """Principal components of the monthly series (of all, where none is monthly) and least squares for the rest."""
    base = x[:, ~quarterly] if (~quarterly).any() else x
    u, s, _ = np.linalg.svd(np.where(np.isnan(base), 0.0, base), full_matrices=False)
    f = u[:, :factors] * s[:factors]
    f = f / np.maximum(f.std(axis=0), 1e-9)
    past = np.column_stack([f[order - j - 1 : len(f) - j - 1] for j in range(order)])
    transition = np.linalg.lstsq(past, f[order:], rcond=None)[0].T
    e = f[order:] - past @ transition.T
    n = x.shape[1]
    loadings, decay, spread = np.zeros((n, factors)), np.full(n, 0.1), np.ones(n)
    width = len(GROWTH)
    summed = np.vstack([np.zeros((min(width - 1, len(f)), factors)), *(GROWTH @ f[t - width + 1 : t + 1] for t in range(width - 1, len(f)))])
    for i in range(n):
        g, on = summed if quarterly[i] else f, ~np.isnan(x[:, i])
        loadings[i] = np.linalg.lstsq(g[on], x[on, i], rcond=None)[0]
        rest = x[on, i] - g[on] @ loadings[i]
        spread[i] = max(rest.var() / (GROWTH @ GROWTH if quarterly[i] else 1.0), 1e-2)
    return MixedParameters(loadings, transition, e.T @ e / max(len(e), 1) + 1e-6 * np.eye(factors), decay, spread, quarterly)


def fitted(x: np.ndarray, quarterly: np.ndarray, factors: int = 1, order: int = 1, rounds: int = 50, tolerance: float = 1e-5) -> tuple[MixedParameters, list[float]]:
    """Parameters by expectation-maximisation, and the log likelihood before each round. x is standardised; gaps are nan."""
    p, path = started(x, quarterly, factors, order), []
    seen, k = ~np.isnan(x), factors
    for _ in range(rounds):
        total, _, s, v, lagged = smoothed(x, p)
        path.append(total)
        if len(path) > 1 and abs(path[-1] - path[-2]) <= tolerance * (abs(path[-1]) + abs(path[-2])) / 2:
            break
        square = v + s[:, :, None] * s[:, None, :]
        cross = lagged[1:] + s[1:, :, None] * s[:-1, None, :]
        now, before, between = square[1:].sum(axis=0), square[:-1].sum(axis=0), cross.sum(axis=0)
        wide = k * p.order
        transition = np.linalg.solve(before[:wide, :wide] + 1e-9 * np.eye(wide), between[:k, :wide].T).T
        shocks = (now[:k, :k] - transition @ between[:k, :wide].T) / (len(x) - 1)
        at = p.first
        decay = np.clip(between[at, at] / np.maximum(before[at, at], 1e-12), -0.99, 0.99)
        spread = np.maximum((now[at, at] - 2 * decay * between[at, at] + decay**2 * before[at, at]) / (len(x) - 1), 1e-6)
        loadings = np.empty_like(p.loadings)
        for i in range(x.shape[1]):
            on, g, h = seen[:, i], p.carrier(i), p.remainder(i)
            whole = square[on].sum(axis=0)
            loadings[i] = np.linalg.solve(g @ whole @ g.T + 1e-9 * np.eye(k), g @ (x[on, i] @ s[on]) - g @ whole @ h)
        p = MixedParameters(loadings, transition, (shocks + shocks.T) / 2 + 1e-9 * np.eye(k), decay, spread, quarterly)
    return p, path


class MixedFactor(Model):
    """The target is a quarterly series of the panel; rows are months, and most have no target.

    A column counts as quarterly if it has values only in months of the quarter in which the target has them. Columns
    without values or variance in training take no part. Test rows follow training rows in time.
    """

    gaps = True

    def __init__(self, factors: int = 1, order: int = 1, rounds: int = 50, tolerance: float = 1e-5):
        self.factors, self.order, self.rounds, self.tolerance = factors, order, rounds, tolerance

    def fit(self, x: np.ndarray, y: np.ndarray) -> MixedFactor:
        both = np.column_stack([x, y]).astype(float)
        seen = ~np.isnan(both)
        if not seen[:, -1].any():
            raise ValueError("no target")
        with np.errstate(all="ignore"):
            self.mean, self.sd = (np.where(seen.any(axis=0), f(np.where(seen.any(axis=0), both, 0.0), axis=0), np.nan) for f in (np.nanmean, np.nanstd))
        self.on = np.isfinite(self.sd) & (self.sd > 1e-12) & (seen.sum(axis=0) >= 3)
        if not self.on[-1] or self.on.sum() < 2:
            raise ValueError("too few series")
        phase = np.arange(len(both)) % 3 == np.flatnonzero(seen[:, -1])[0] % 3
        quarterly = ~(seen & ~phase[:, None]).any(axis=0)
        self.train = ((both - self.mean) / np.where(self.sd > 0, self.sd, 1))[:, self.on]
        k = max(1, min(self.factors, self.train.shape[1] - 1))
        self.parameters, self.likelihoods = fitted(self.train, quarterly[self.on], k, self.order, self.rounds, self.tolerance)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """What is known of each row's quarter, by months up to that row."""
        test = ((np.column_stack([x, np.full(len(x), np.nan)]) - self.mean) / np.where(self.sd > 0, self.sd, 1))[:, self.on]
        state = smoothed(np.vstack([self.train, test]), self.parameters, backward=False)[1][len(self.train) :]
        return state @ self.parameters.system()[2][-1] * self.sd[-1] + self.mean[-1]
