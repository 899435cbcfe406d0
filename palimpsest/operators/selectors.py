"""Selectors and compressors on a window's wide matrix, fitted on training rows only."""

from __future__ import annotations

import numpy as np

from palimpsest.operators.models import Standardised, coordinate_descent


class Identity:
    def fit(self, x, y=None):
        return self

    def transform(self, x):
        return x


class Correlated:
    """The k columns of largest absolute correlation with the target over pairs without gaps, ties by position."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, x, y):
        score = np.zeros(x.shape[1])
        for j in range(x.shape[1]):
            ok = ~(np.isnan(x[:, j]) | np.isnan(y))
            a, b = x[ok, j], y[ok]
            if ok.sum() > 2 and a.std() > 1e-12 and b.std() > 1e-12:
                score[j] = abs(np.corrcoef(a, b)[0, 1])
        self.columns = np.sort(np.argsort(-score, kind="stable")[: self.k])
        return self

    def transform(self, x):
        return x[:, self.columns]


class Varying:
    """Columns whose variance in training is above ``least``."""

    def __init__(self, least: float = 1e-12):
        self.least = least

    def fit(self, x, y=None):
        with np.errstate(all="ignore"):
            self.columns = np.flatnonzero(np.nan_to_num(np.nanvar(np.where(np.isnan(x).all(axis=0), 0.0, x), axis=0)) > self.least)
        return self

    def transform(self, x):
        return x[:, self.columns]


class Penalised(Standardised):
    """Columns with non-zero elastic-net weights, at most ``most``; the five largest least-squares weights if there is none."""

    def __init__(self, alpha: float = 0.01, l1: float = 1.0, most: int | None = None):
        self.alpha, self.l1, self.most = alpha, l1, most

    def fit(self, x, y):
        z = self._learn(x)
        w = np.abs(coordinate_descent(z, y - y.mean(), self.alpha, self.l1))
        chosen = np.flatnonzero(w > 0)
        if not len(chosen):
            w = np.abs(np.linalg.lstsq(z, y - y.mean(), rcond=None)[0])
            chosen = np.argsort(-w, kind="stable")[:5]
        order = chosen[np.argsort(-w[chosen], kind="stable")]
        self.columns = np.sort(order[: self.most] if self.most else order)
        return self

    def transform(self, x):
        return x[:, self.columns]


class Components(Standardised):
    """The first k principal components of the standardised training window."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, x, y=None):
        z = self._learn(x)
        _, s, v = np.linalg.svd(z, full_matrices=False)
        self.v = v[: self.k].T
        self.explained = (s**2 / max((s**2).sum(), 1e-300))[: self.k]
        return self

    def transform(self, x):
        return self._scale(x) @ self.v


class Factors(Components):
    """Maximum-likelihood factors by EM: loadings and unique variances, scores by regression."""

    def __init__(self, k: int, rounds: int = 200):
        super().__init__(k)
        self.rounds = rounds

    def fit(self, x, y=None):
        z = self._learn(x)
        n, p = z.shape
        cov = z.T @ z / n
        values, vectors = np.linalg.eigh(cov)
        load = vectors[:, -self.k :] * np.sqrt(np.maximum(values[-self.k :], 1e-6))
        unique = np.maximum(np.diag(cov) - (load**2).sum(axis=1), 0.01)
        for _ in range(self.rounds):
            beta = load.T @ np.linalg.inv(load @ load.T + np.diag(unique))
            second = np.eye(self.k) - beta @ load + beta @ cov @ beta.T
            load = cov @ beta.T @ np.linalg.inv(second)
            unique = np.maximum(np.diag(cov - load @ beta @ cov), 1e-4)
        self.load, self.unique = load, unique
        self.v = np.linalg.solve(load @ load.T + np.diag(unique), load)
        return self


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 8) -> np.ndarray:
    """Of each column with y, in nats, on bins of equal counts over pairs without gaps."""
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        ok = ~(np.isnan(x[:, j]) | np.isnan(y))
        if ok.sum() < 2 * bins:
            continue
        cut = lambda v: np.searchsorted(np.unique(np.quantile(v, np.arange(1, bins) / bins)), v, "right")
        joint = np.zeros((bins, bins))
        np.add.at(joint, (cut(x[ok, j]), cut(y[ok])), 1)
        joint /= joint.sum()
        outer = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
        at = joint > 0
        out[j] = (joint[at] * np.log(joint[at] / outer[at])).sum()
    return out


class Informative:
    """The k columns of most mutual information with the target, ties by position."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, x, y):
        self.columns = np.sort(np.argsort(-mutual_information(x, y), kind="stable")[: self.k])
        return self

    def transform(self, x):
        return x[:, self.columns]


KINDS = {"identity": Identity, "correlated": Correlated, "varying": Varying, "penalised": Penalised, "components": Components, "factors": Factors, "informative": Informative}


class Chain:
    """Selectors and compressors applied in turn, each learnt from what the one before leaves of the training rows.

    A chain is a value, (name, options) pairs: every fit starts from it anew, so that nothing goes from one fold to another.
    """

    def __init__(self, steps=()):
        self.steps = [(name, dict(options)) for name, options in steps]

    def fit(self, x, y):
        self.fitted = []
        for name, options in self.steps:
            self.fitted.append(KINDS[name](**options).fit(x, y))
            x = self.fitted[-1].transform(x)
            if not x.shape[1]:
                raise ValueError(f"no column is left after {name}")
        return self

    def transform(self, x):
        for step in self.fitted:
            x = step.transform(x)
        return x
