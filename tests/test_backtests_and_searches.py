"""Back-tests on panels of mixed frequency, selection inside folds, searches as one plan, trees and samplers."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import backtests as bk
from palimpsest.operators import boosting as bo
from palimpsest.operators import evaluation as ev
from palimpsest.operators import optimise as op
from palimpsest.operators import selectors as sl


def long(spark, frame, name="value"):
    rows = [(c, d.date(), float(v)) for c in frame for d, v in frame[c].items() if not np.isnan(v)]
    return spark.createDataFrame(rows, f"series_id string, period_date date, {name} double")


@pytest.fixture(scope="module")
def monthly(spark):
    """(wide monthly panel, quarterly target = mean of a's three months, their frames, folds)."""
    r = np.random.default_rng(5)
    months = pd.date_range("2000-01-31", periods=120, freq="ME")
    x = pd.DataFrame(r.normal(size=(120, 3)), months, ["a", "b", "c"])
    y = x["a"].groupby(x.index.to_period("Q")).mean()
    y.index = y.index.to_timestamp(how="end").normalize()
    target = spark.createDataFrame([(d.date(), float(v)) for d, v in y.items()], "period_date date, y double")
    return x, y, long(spark, x), target, ev.folds(target, 24, 2)


def test_months_between_targets_count(spark, monthly):
    x, y, panel, target, folds = monthly
    out = bk.backtest(panel, target, folds, "ridge", {"alpha": 1e-6}).toPandas()
    assert len(out) == 16 and np.allclose(out["actual"], out["predicted"], atol=1e-3)
    last = bk.backtest(panel, target, folds, "ridge", {"alpha": 1e-6}, rule="last").toPandas()
    assert abs(last["actual"] - last["predicted"]).max() > 0.1
    quarter = pd.Timestamp(out["target_date"].max())
    for model, params in (("dynamic_factor", {"factors": 1, "order": 1, "rounds": 3}), ("mixed_factor", {"factors": 1, "order": 1, "rounds": 3})):
        changed = x.copy()
        changed.loc[quarter - pd.offsets.MonthEnd(1)] += 2  # the quarter's second month
        one = folds.where(F.col("test_end") == F.lit(quarter.date())).withColumn("fold", F.lit(0))
        a, b = (bk.backtest(p, target, one, model, params).where(F.col("target_date") == F.lit(quarter.date())).first() for p in (panel, long(spark, changed)))
        assert a.status == "success" and abs(a.predicted - b.predicted) > 1e-4


def test_results_do_not_depend_on_blocks_and_lanes(monthly):
    _, _, panel, target, folds = monthly
    spark = panel.sparkSession
    configs = [{"model": "ridge", "params": {"alpha": a}, "selectors": [["correlated", {"k": 2}]]} for a in (0.1, 1.0, 10.0)] + [{"model": "boosted_trees", "params": {"trees": 5}, "window": 16}]
    rows = bk.config_rows(spark, configs)
    key = ["config_id", "fold", "target_date"]
    runs = [bk.run_all(panel, target, folds, rows, blocks=b, lanes=n).toPandas().sort_values(key).reset_index(drop=True) for b, n in ((1, 1), (3, 2), (50, 3))]
    assert len(runs[0]) == 4 * 16 and (runs[0]["status"] == "success").all()
    for other in runs[1:]:
        pd.testing.assert_frame_equal(runs[0], other)
    for c, i in zip(configs, [r.config_id for r in rows.collect()]):
        if c["model"] == "ridge":
            one = bk.backtest(panel, target, folds, "ridge", c["params"], tuple(map(tuple, c["selectors"]))).toPandas().sort_values(["fold", "target_date"])
            assert np.allclose(one["predicted"], runs[0][runs[0]["config_id"] == i]["predicted"])


def test_the_fine_stage_runs_what_the_coarse_one_promotes(monthly):
    _, _, panel, target, folds = monthly
    configs = bk.config_rows(panel.sparkSession, [{"model": "ridge", "params": {"alpha": a}} for a in (1e-3, 1.0, 1e3, 1e6)] + [{"model": "ridge", "params": {"alpha": 1.0}, "selectors": [["penalised", {"nonsense": 1}]]}] * 0)
    got = bk.staged_search(panel, target, folds, configs, top=2, coarse_folds=2).toPandas()
    coarse, fine = got[got["stage"] == "coarse"], got[got["stage"] == "fine"]
    assert len(coarse) == 4 and (coarse["n_obs"] == 4).all() and (fine["n_obs"] == 16).all()
    assert set(fine["config_id"]) == set(coarse.nsmallest(2, "rmse")["config_id"])
    whole = bk.scores(bk.run_all(panel, target, folds, configs)).toPandas().set_index("config_id")["rmse"]
    assert np.allclose(fine.set_index("config_id")["rmse"], whole.loc[fine["config_id"]])


def test_a_column_that_leaks_is_chosen_on_the_whole_panel_but_not_inside_folds(spark):
    r = np.random.default_rng(8)
    quarters = pd.date_range("1990-03-31", periods=60, freq="QE")
    y = r.normal(size=60)
    x = pd.DataFrame({"real": y + 1.5 * r.normal(size=60), "leak": r.normal(size=60)}, quarters)
    x.loc[quarters[30]:, "leak"] = 10 * y[30:]  # only the test period knows the target
    target = spark.createDataFrame([(d.date(), float(v)) for d, v in zip(quarters, y)], "period_date date, y double")
    assert sl.Correlated(1).fit(x.to_numpy(), y).columns.tolist() == [1]
    one = ev.folds(target, 30, 30)
    out = bk.backtest(long(spark, x), target, one, "ridge", {"alpha": 1e-6}, (("correlated", {"k": 1}),)).toPandas()
    assert (out["n_features"] == 2).all() and (out["n_selected"] == 1).all()
    b = np.polyfit(x["real"][:30], y[:30], 1)
    assert np.allclose(out["predicted"], np.polyval(b, x["real"][30:]), atol=1e-4)


def test_failures_are_rows(spark, monthly):
    _, _, panel, target, folds = monthly
    out = bk.backtest(panel, target, folds.where("fold = 0"), "mixed_factor", {}, (("correlated", {"k": 0}),)).toPandas()
    assert out["status"].str.startswith("failed").all() and out["predicted"].isna().all()
    assert bk.scores(bk.run_all(panel, target, folds, bk.config_rows(spark, [{"model": "ridge", "params": {}, "window": 3}]))).first().rmse is None


def exact_tree(x, y, depth, least):
    """A regression tree by trying every cut; a function of one row."""
    best = None
    for j in range(x.shape[1]) if depth and len(y) >= 2 * least else ():
        v = np.unique(x[:, j])
        for cut in (v[1:] + v[:-1]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                loss = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, j, cut)
    if best is None or best[0] >= ((y - y.mean()) ** 2).sum() - 1e-9:
        return lambda row: y.mean()
    _, j, cut = best
    sides = [exact_tree(x[s], y[s], depth - 1, least) for s in (x[:, j] <= cut, x[:, j] > cut)]
    return lambda row: sides[int(row[j] > cut)](row)


@pytest.mark.parametrize("depth, least", [(1, 1), (2, 3), (4, 2)])
def test_histogram_trees_equal_exact_ones(depth, least):
    r = np.random.default_rng(depth)
    x = r.normal(size=(60, 3)).round(1)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) + 0.1 * r.normal(size=60)
    edges = bo.bin_edges(x, 100)
    bins = bo.binned(x, edges)
    tree = bo.Tree(depth, least, 0.0).fit(bins, y, [len(e) for e in edges])
    want = exact_tree(x, y, depth, least)
    assert np.allclose(tree.predict(bins), [want(row) for row in x])


def test_boosting_learns_what_lines_cannot_and_takes_gaps():
    r = np.random.default_rng(1)
    x = r.uniform(-2, 2, size=(400, 4))
    y = x[:, 0] * x[:, 1] + np.where(np.isnan(x[:, 2]), 1, 0)
    x[::9, 2] = np.nan
    y = y + np.where(np.isnan(x[:, 2]), 2.0, 0.0)
    m = bo.BoostedTrees(300, 4, 0.1, 5).fit(x[:300], y[:300])
    assert np.corrcoef(m.predict(x[300:]), y[300:])[0, 1] > 0.9
    same = bo.BoostedTrees(300, 4, 0.1, 5).fit(x[:300], y[:300])
    assert np.array_equal(m.predict(x[300:]), same.predict(x[300:]))
    assert np.allclose(bo.BoostedTrees(5).fit(x[:50, :0], y[:50]).predict(x[50:60, :0]), y[:50].mean(), atol=0.5)
    with pytest.raises(ValueError):
        bo.BoostedTrees().fit(x[:3], y[:3])


SPACE = {"x": (-3.0, 3.0, "float"), "scale": (1e-3, 1e3, "log"), "n": (1, 9, "int"), "kind": ["a", "b", "c"]}


def loss(c):
    return (c["x"] - 1.3) ** 2 + (math.log10(c["scale"]) - 1) ** 2 + 0.1 * (c["n"] - 6) ** 2 + {"a": 1.0, "b": 0.0, "c": 2.0}[c["kind"]]


def runner(calls):
    def run(configs, budget):
        rows = configs.collect()
        calls.append((len(rows), budget))
        made = [(r.config_id, loss(json.loads(r.config)) + 1 / max(budget, 1)) for r in rows]
        return configs.sparkSession.createDataFrame(made, "config_id string, score double")

    return run


def test_the_sampler_beats_a_grid_of_the_same_size():
    history = []
    for t in range(81):
        c = op.suggested(SPACE, history, 3, t)
        assert -3 <= c["x"] <= 3 and 1e-3 <= c["scale"] <= 1e3 and 1 <= c["n"] <= 9 and c["kind"] in "abc"
        history.append((c, loss(c)))
    grid = [dict(zip(SPACE, v)) for v in itertools.product((-3.0, 0.0, 3.0), (1e-3, 1.0, 1e3), (1, 5, 9), ("a", "b", "c"))]
    assert len(grid) == 81 and min(h[1] for h in history) < min(map(loss, grid)) / 3
    assert np.mean([h[1] for h in history[60:]]) < np.mean([h[1] for h in history[:10]]) / 2


def test_searches_resume_from_their_table(spark, tmp_path):
    calls = []
    whole = op.bayesian_search(spark, SPACE, runner(calls), 12, f"{tmp_path}/a", batch=4, startup=4).orderBy("trial").collect()
    assert len(calls) == 3
    op.bayesian_search(spark, SPACE, runner([]), 4, f"{tmp_path}/b", batch=4, startup=4)
    part = spark.read.parquet(f"{tmp_path}/b").where("trial < 3").collect()
    spark.createDataFrame(part, op.TABLE).write.parquet(f"{tmp_path}/c")  # broken off inside a batch
    calls.clear()
    assert op.bayesian_search(spark, SPACE, runner(calls), 12, f"{tmp_path}/c", batch=4, startup=4).orderBy("trial").collect() == whole
    assert [n for n, _ in calls] == [1, 4, 4]
    calls.clear()
    assert op.bayesian_search(spark, SPACE, runner(calls), 12, f"{tmp_path}/c", batch=4).count() == 12 and calls == []


def test_halving_gives_the_best_more(spark, tmp_path):
    calls = []
    out = op.successive_halving(spark, SPACE, runner(calls), 9, f"{tmp_path}/h", 1, 9, 3).toPandas()
    assert calls == [(9, 1), (3, 3), (1, 9)]
    first = out[out["rung"] == 0].nsmallest(3, "score")["trial"]
    assert set(out[out["rung"] == 1]["trial"]) == set(first) and out[out["rung"] == 2]["trial"].tolist() == [first.iloc[0]]
    again = []
    assert op.successive_halving(spark, SPACE, runner(again), 9, f"{tmp_path}/h", 1, 9, 3).count() == 13 and again == []
