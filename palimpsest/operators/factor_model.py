"""Dynamic factor model: expectation-maximisation over a Kalman smoother, with gaps anywhere in the panel.

x_t = L f_t + e_t with diagonal R, and f_t = A (f_{t-1} .. f_{t-p}) + u_t. The filter works in information form, so its
cost grows with the number of observed values, never with the square of the number of series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from palimpsest.operators.models import Model


@dataclass
class Parameters:
    loadings: np.ndarray  # series x factors
    transition: np.ndarray  # factors x (factors * order)
    shocks: np.ndarray  # factors x factors
    noise: np.ndarray  # a variance for each series

    @property
    def companion(self) -> tuple[np.ndarray, np.ndarray]:
        k, m = self.transition.shape
        move, spread = np.zeros((m, m)), np.zeros((m, m))
        move[:k], spread[:k, :k] = self.transition, self.shocks
        move[k:, :-k] = np.eye(m - k)
        return move, spread

    def start(self) -> np.ndarray:
        """The stationary variance of the state, or a wide one where there is none."""
        move, spread = self.companion
        m = len(move)
        if np.abs(np.linalg.eigvals(move)).max() >= 0.999:
            return 10 * np.eye(m)
        return np.linalg.solve(np.eye(m * m) - np.kron(move, move), spread.ravel()).reshape(m, m)


def kalman(x: np.ndarray, p: Parameters) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, filtered means, smoothed means, smoothed variances, lag-one covariances, filtered variances)."""
    move, spread = p.companion
    k, m, steps = p.loadings.shape[1], len(move), len(x)
    seen = ~np.isnan(x)
    mean, var, total = np.zeros(m), p.start(), 0.0
    ahead, ahead_var, means, variances = (np.empty((steps, *s)) for s in ((m,), (m, m), (m,), (m, m)))
    for t in range(steps):
        if t:
            mean, var = move @ mean, move @ var @ move.T + spread
        ahead[t], ahead_var[t] = mean, var
        on = seen[t]
        if on.any():
            weighted = p.loadings[on] / p.noise[on, None]
            error = x[t, on] - p.loadings[on] @ mean[:k]
            information = np.zeros((m, m))
            information[:k, :k] = p.loadings[on].T @ weighted
            pull = np.zeros(m)
            pull[:k] = weighted.T @ error
            gain = np.eye(m) + var @ information
            var = np.linalg.solve(gain, var)
            var = (var + var.T) / 2
            total -= 0.5 * (on.sum() * np.log(2 * np.pi) + np.log(p.noise[on]).sum() + np.linalg.slogdet(gain)[1] + (error**2 / p.noise[on]).sum() - pull @ var @ pull)
            mean = mean + var @ pull
        means[t], variances[t] = mean, var
    smooth, smooth_var, lagged = means.copy(), variances.copy(), np.zeros((steps, m, m))
    for t in range(steps - 2, -1, -1):
        back = np.linalg.lstsq(ahead_var[t + 1].T, (variances[t] @ move.T).T, rcond=None)[0].T
        smooth[t] = means[t] + back @ (smooth[t + 1] - ahead[t + 1])
        smooth_var[t] = variances[t] + back @ (smooth_var[t + 1] - ahead_var[t + 1]) @ back.T
        lagged[t + 1] = smooth_var[t + 1] @ back.T
    return total, means, smooth, smooth_var, lagged, variances


def started(x: np.ndarray, factors: int, order: int) -> Parameters:
    """Principal components of the panel with gaps at its mean, and least squares for their dynamics."""
    z = np.where(np.isnan(x), 0.0, x)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    f, loadings = u[:, :factors] * s[:factors] / np.sqrt(len(x)), v[:factors].T * np.sqrt(len(x))
    f, loadings = f * np.sqrt(len(x)), loadings / np.sqrt(len(x))
    past = np.column_stack([f[order - j - 1 : len(f) - j - 1] for j in range(order)])
    transition = np.linalg.lstsq(past, f[order:], rcond=None)[0].T
    e = f[order:] - past @ transition.T
    noise = np.nanvar(x - f @ loadings.T, axis=0)
    return Parameters(loadings, transition, e.T @ e / len(e) + 1e-6 * np.eye(factors), np.maximum(noise, 1e-3))


def fitted(x: np.ndarray, factors: int = 1, order: int = 1, rounds: int = 50, tolerance: float = 1e-5) -> tuple[Parameters, list[float]]:
    """Parameters by expectation-maximisation, and the log likelihood before each round. x is standardised; gaps are nan."""
    p, path = started(x, factors, order), []
    k = factors
    seen = ~np.isnan(x)
    filled = np.where(seen, x, 0.0)
    for _ in range(rounds):
        total, _, s, v, lagged, _ = kalman(x, p)
        path.append(total)
        if len(path) > 1 and abs(path[-1] - path[-2]) <= tolerance * (abs(path[-1]) + abs(path[-2])) / 2:
            break
        f, square = s[:, :k], v[:, :k, :k] + s[:, :k, None] * s[:, None, :k]
        loadings, noise = np.empty_like(p.loadings), np.empty_like(p.noise)
        for i in range(x.shape[1]):
            on = seen[:, i]
            loadings[i] = np.linalg.solve(square[on].sum(axis=0) + 1e-9 * np.eye(k), filled[on, i] @ f[on])
            own = loadings[i]
            noise[i] = max(1e-4, np.mean((filled[on, i] - f[on] @ own) ** 2 + np.einsum("a,tab,b->t", own, v[on, :k, :k], own)))
        past = (v[:-1] + s[:-1, :, None] * s[:-1, None, :]).sum(axis=0)
        cross = (lagged[1:, :k] + s[1:, :k, None] * s[:-1, None, :]).sum(axis=0)
        transition = np.linalg.solve(past + 1e-9 * np.eye(len(past)), cross.T).T
        shocks = (square[1:].sum(axis=0) - transition @ cross.T) / (len(x) - 1)
        p = Parameters(loadings, transition, (shocks + shocks.T) / 2 + 1e-9 * np.eye(k), noise)
    return p, path


class DynamicFactor(Model):
    """The target is one more series of the panel; its nowcast is what the filtered factors say of it.

    Series without values or variance in training take no part. Test rows follow training rows in time. Rows without a
    target (nan) move the factors like any other.
    """

    gaps = True

    def __init__(self, factors: int = 2, order: int = 1, rounds: int = 50):
        self.factors, self.order, self.rounds = factors, order, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> DynamicFactor:
        both = np.column_stack([x, y])
        self.mean, self.sd = np.nanmean(both, axis=0), np.nanstd(both, axis=0)
        self.on = np.isfinite(self.sd) & (self.sd > 1e-12) & ((~np.isnan(both)).sum(axis=0) >= 3)
        self.on[-1] = True
        if self.on.sum() < 2 or not self.sd[-1] > 0:
            raise ValueError("too few series")
        self.train = ((both - self.mean) / np.where(self.sd > 0, self.sd, 1))[:, self.on]
        k = min(self.factors, self.train.shape[1] - 1, max(1, (len(y) - self.order) // 4))
        self.parameters, self.likelihoods = fitted(self.train, k, self.order, self.rounds)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        test = ((np.column_stack([x, np.full(len(x), np.nan)]) - self.mean) / np.where(self.sd > 0, self.sd, 1))[:, self.on]
        filtered = kalman(np.vstack([self.train, test]), self.parameters)[1][len(self.train) :]
        k = self.parameters.loadings.shape[1]
        return filtered[:, :k] @ self.parameters.loadings[-1] * self.sd[-1] + self.mean[-1]
