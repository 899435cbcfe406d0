"""Hard negatives against a brute-force version in Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    """Sorted result rows; rows: (vec_id, label, embedding), every seventh vec_id or so being an anchor."""
    clip = lambda x: min(max(x, h.LEAST), h.MOST)
    f32 = lambda x: float(np.float32(x))
    ok = [(i, lab, [math.floor(scale * f32(x)) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, q) in enumerate(ok):
        if i % 7:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(q, v))), j, lab) for m, (j, lab, v) in enumerate(ok) if m != k]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            other = sorted(x for x in scored if x[2] != label and -low * p <= -100 * x[0] <= -high * p)[:negatives]
            out += [(i, j, r, m, -p, -n) for r, (n, m, _) in enumerate(other, 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("group", "score", "anchor", "id", "rank")})
    return sorted(map(tuple, h.hard_negatives(df, F.col("vec_id") % 7 == 0, **options).collect()))


def vectors(seed, n, width, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, width))
    made = [(k, int(lab), (centres[lab] * 0.6 + r.normal(size=width)) * r.uniform(0.5, 2)) for k, lab in enumerate(r.integers(0, labels, n))]
    return [(k, lab, [float(x) for x in v]) for k, lab, v in made]


@pytest.mark.parametrize("options", [{}, {"round_bytes": 4000}, {"positives": 2, "negatives": 7, "low": 10, "high": 120}, {"scale": 1}])
def test_equals_brute_force(spark, options):
    rows = vectors(1, 400, 24)
    want = brute(rows, **{k: v for k, v in options.items() if k != "round_bytes"})
    assert got(spark, rows, **options) == want and len(want) > 100


def test_awkward_inputs(spark):
    rows = vectors(2, 120, 8, 2)
    rows += [(7, None, [1.0] * 8), (None, 1, [1.0] * 8), (14, 1, None), (21, 1, [1.0, None]), (28, 0, [float("nan")] * 8), (35, 0, [float("inf")] + [0.0] * 7)]
    rows += [(200, 0, []), (203, 1, [2.0]), (210, 1, [0.5] * 5), rows[7], rows[7], rows[8], (-7, 0, [-1.0] * 8), (217, 9, [0.1] * 8), (300, 0, [0.0] * 8), (301, 1, [0.0] * 8)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, 1, [1.0])]) == [] and got(spark, [(7, 1, [])]) == []


def test_ties_and_one_label_that_holds_most_rows(spark):
    r = random.Random(4)
    rows = [(k, 0 if r.random() < 0.7 else 1, [float(r.randrange(3)) for _ in range(4)]) for k in range(300)]
    assert got(spark, rows, low=20) == brute(rows, low=20)


@pytest.mark.parametrize("size", [1e4, 1e7, 1e15])
def test_sums_of_any_size_are_exact(spark, size):
    rows = [(k, lab, [float(np.float32(x * size)) for x in v]) for k, lab, v in vectors(6, 90, 6)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("low, high", [(100, np.inf), (-np.inf, -50), (200, 260)])
def test_no_pair_within_range_is_discarded(low, high):
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(700, 16)) * r.uniform(0.01, 9, 16))
    axes = np.linalg.qr(r.normal(size=(16, 16)))[0]
    rows = h.Rows(*(np.arange(700),) * 4, x, axes, [3, 9])
    every = np.arange(700)
    i, j, score = h.near(rows, rows, every, every, np.full(700, float(low)), np.full(700, float(high)), [3, 9])
    whole = x @ x.T
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero((whole >= low) & (whole <= high))))}
    assert want <= set(zip(i.tolist(), j.tolist())) and (whole[i, j] == score).all()
