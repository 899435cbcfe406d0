"""Sequential searches: a tree-structured Parzen sampler and successive halving, over a table of results.

Trials are numbered, and a trial's suggestion depends on the seed, its number and the results of earlier batches alone, so
that a search that was broken off goes on from its table as if it never had been.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: name -> a list of choices, or (low, high, "int" | "float" | "log").
Space = dict[str, list | tuple]
TABLE = "trial long, rung int, budget int, config string, score double"


def _drawn(kind: list | tuple, r: np.random.Generator):
    if isinstance(kind, list):
        return kind[int(r.integers(len(kind)))]
    low, high, how = kind
    if how == "int":
        return int(r.integers(low, high + 1))
    return float(math.exp(r.uniform(math.log(low), math.log(high)))) if how == "log" else float(r.uniform(low, high))


def drawn(space: Space, seed: int, trial: int) -> dict:
    """The trial's uniform draw."""
    r = np.random.default_rng([seed, trial])
    return {name: _drawn(kind, r) for name, kind in space.items()}


def _scaled(kind: tuple, x) -> float:
    return math.log(x) if kind[2] == "log" else float(x)


def _density(kind: tuple, seen: list) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Centres and widths of a Parzen estimator with a wide prior component."""
    low, high = _scaled(kind, kind[0]), _scaled(kind, kind[1])
    x = np.sort([_scaled(kind, v) for v in seen])
    around = np.concatenate(([low], x, [high]))
    wide = np.maximum(np.maximum(around[1:-1] - around[:-2], around[2:] - around[1:-1]), (high - low) / min(100, 1 + len(x)))
    return np.append(x, (low + high) / 2), np.append(np.minimum(wide, high - low), high - low), low, high


def _log_mass(centres: np.ndarray, widths: np.ndarray, low: float, high: float, x: np.ndarray) -> np.ndarray:
    erf = np.vectorize(math.erf)
    cdf = lambda v: 0.5 * (1 + erf((v - centres) / widths / math.sqrt(2)))
    inside = np.maximum(cdf(high) - cdf(low), 1e-12)
    z = (x[:, None] - centres) / widths
    return np.log(np.mean(np.exp(-0.5 * z * z) / widths / inside, axis=1) + 1e-300)


def suggested(space: Space, history: list[tuple[dict, float]], seed: int, trial: int, startup: int = 10, share: float = 0.25, candidates: int = 32) -> dict:
    """The trial's configuration: where results below the best share are likely and the others are not."""
    scored = sorted((h for h in history if h[1] is not None and math.isfinite(h[1])), key=lambda h: h[1])
    if len(scored) < startup:
        return drawn(space, seed, trial)
    r = np.random.default_rng([seed, trial, 1])
    n = max(1, math.ceil(share * math.sqrt(len(scored)) * 2))
    good, bad = [c for c, _ in scored[:n]], [c for c, _ in scored[n:]]
    out = {}
    for name, kind in space.items():
        if isinstance(kind, list):
            weights = []
            for part in (good, bad):
                w = np.asarray([1 + sum(c[name] == v for c in part) for v in kind], float)
                weights.append(w / w.sum())
            picks = r.choice(len(kind), size=candidates, p=weights[0])
            out[name] = kind[int(picks[np.argmax(np.log(weights[0][picks]) - np.log(weights[1][picks]))])]
            continue
        centres, widths, low, high = _density(kind, [c[name] for c in good])
        k = r.integers(len(centres), size=candidates)
        x = np.clip(centres[k] + widths[k] * r.normal(size=candidates), low, high)
        best = x[int(np.argmax(_log_mass(centres, widths, low, high, x) - _log_mass(*_density(kind, [c[name] for c in bad]), x)))]
        value = math.exp(best) if kind[2] == "log" else best
        out[name] = int(min(max(round(value), kind[0]), kind[1])) if kind[2] == "int" else float(min(max(value, kind[0]), kind[1]))
    return out


def _table(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(TABLE).parquet(path).collect()  # a search's trials, as many as it was asked for
    except AnalysisException:
        return []


def _scored(spark: SparkSession, path: str, rows: list[tuple], run: Callable[[DataFrame, int], DataFrame]) -> None:
    """Runs configurations (trial, rung, budget, config) of one budget as one plan, and appends their scores."""
    asked = spark.createDataFrame([(str(t), c) for t, _, _, c in rows], "config_id string, config string")
    score = {r.config_id: r.score for r in run(asked, rows[0][2]).select("config_id", "score").collect()}
    done = [(t, g, b, c, score.get(str(t))) for t, g, b, c in rows]
    spark.createDataFrame(done, TABLE).coalesce(1).write.mode("append").parquet(path)


def bayesian_search(spark: SparkSession, space: Space, run: Callable[[DataFrame, int], DataFrame], trials: int, path: str, batch: int = 8, budget: int = 0, seed: int = 7, **options) -> DataFrame:
    """TABLE's rows of a search by Parzen estimators, batches of trials being one plan each.

    run: from (config_id, config as JSON) and the budget to (config_id, score), smaller scores being better. Results are
    appended to path; trials that are there already are not run again.
    """
    first = 0
    while first < trials:
        seen = {r.trial: r for r in _table(spark, path) if r.rung == 0}
        now = range(first, min(first + batch, trials))
        history = [(json.loads(seen[t].config), seen[t].score) for t in range(first) if t in seen]
        missing = [(t, 0, budget, json.dumps(suggested(space, history, seed, t, **options), sort_keys=True)) for t in now if t not in seen]
        if missing:
            _scored(spark, path, missing, run)
        first += batch
    return spark.read.schema(TABLE).parquet(path).where(f"trial < {trials}")


def successive_halving(spark: SparkSession, space: Space, run: Callable[[DataFrame, int], DataFrame], trials: int, path: str, least: int = 1, most: int = 9, eta: int = 3, seed: int = 7) -> DataFrame:
    """TABLE's rows of a search in rungs: the best 1 / eta of each rung's trials go on with eta times the budget.

    Each rung is one plan. Ties go to the smaller trial; trials without a score go no further.
    """
    now, budget, rung = {t: json.dumps(drawn(space, seed, t), sort_keys=True) for t in range(trials)}, least, 0
    while now:
        seen = {r.trial: r.score for r in _table(spark, path) if r.rung == rung}
        missing = [(t, rung, budget, c) for t, c in now.items() if t not in seen]
        if missing:
            _scored(spark, path, missing, run)
            seen = {r.trial: r.score for r in _table(spark, path) if r.rung == rung}
        if budget >= most:
            break
        order = sorted((s, t) for t, s in seen.items() if t in now and s is not None and math.isfinite(s))
        now = {t: now[t] for _, t in order[: max(1, len(now) // eta)]} if order else {}
        budget, rung = min(budget * eta, most), rung + 1
    return spark.read.schema(TABLE).parquet(path)
