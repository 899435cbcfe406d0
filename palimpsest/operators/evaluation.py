"""Back-test folds, accuracy and revision metrics, leaderboards, prediction extraction, configuration grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.periods import quarter_end


def accuracy(actual: Column, predicted: Column) -> list[Column]:
    """n_obs, rmse, mae, mape over rows where both are there; an actual of 0 counts as 1e-8 in the last."""
    both = actual.isNotNull() & predicted.isNotNull()
    e = F.when(both, actual - predicted)
    return [
        F.count_if(both).alias("n_obs"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100 * F.avg(F.abs(F.try_divide(e, F.when(actual == 0, F.lit(1e-8)).otherwise(actual))))).alias("mape"),
    ]


def metrics(pred: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(*by).agg(*accuracy(F.col(actual), F.col(predicted)))


def metrics_with_overall(pred: DataFrame, by: list[str], label: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """metrics for each label and, as label 'overall', for all together: one pass of grouping sets."""
    sets = [[F.col(c) for c in [*by, label]], [F.col(c) for c in by]]
    out = pred.withColumn(label, F.col(label).cast("string")).groupingSets(sets, *by, label).agg(*accuracy(F.col(actual), F.col(predicted)), F.grouping(label).alias("__all"))
    return out.withColumn(label, F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.col(label))).drop("__all")


def revisions(pred: DataFrame, by: list[str], quarter: str, label: str, predicted: str = "predicted") -> DataFrame:
    """by, transition, avg_revision, n_revision_pairs: absolute changes between successive labels, and overall."""
    w = W.partitionBy(*by, quarter).orderBy(F.col(label).cast("int"))
    d = pred.withColumns({"__p": F.lag(predicted).over(w), "__l": F.lag(F.col(label).cast("string")).over(w)})
    d = d.where("__p is not null").withColumns({"transition": F.concat_ws(" -> ", "__l", F.col(label).cast("string")), "__d": F.abs(F.col(predicted) - F.col("__p"))})
    sets = [[F.col(c) for c in [*by, "transition"]], [F.col(c) for c in by]]
    out = d.groupingSets(sets, *by, "transition").agg(F.avg("__d").alias("avg_revision"), F.count("__d").alias("n_revision_pairs"), F.grouping("transition").alias("__all"))
    return out.withColumn("transition", F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.col("transition"))).drop("__all")


def folds(dates: DataFrame, first_train: int, step: int = 1, window: int | None = None, date: str = "period_date") -> DataFrame:
    """fold, train_start, train_end, test_end over the ordered distinct dates; rolling with a window, else expanding."""
    w = W.orderBy(date)  # the calendar of one target, a row for each period
    at = dates.select(date).distinct().withColumn("__n", F.row_number().over(w))
    last = at.agg(F.max("__n").alias("__max"))
    points = last.where(F.col("__max") > first_train).select("__max", F.explode(F.sequence(F.lit(first_train), F.col("__max") - 1, F.lit(step))).alias("__end"))
    points = points.withColumns({"fold": ((F.col("__end") - first_train) / step).cast("int"), "__lo": F.lit(1) if window is None else F.greatest(F.lit(1), F.col("__end") - window + 1), "__test": F.least("__max", F.col("__end") + step)})
    for name, n in (("train_start", "__lo"), ("train_end", "__end"), ("test_end", "__test")):
        points = points.join(at.select(F.col("__n").alias(n), F.col(date).alias(name)), n)
    return points.select("fold", "train_start", "train_end", "test_end")


def running_rmse(pred: DataFrame, by: list[str], date: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    w = W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    e = F.col(actual) - F.col(predicted)
    return pred.withColumn("running_rmse", F.sqrt(F.avg(e * e).over(w)))


def best_rows(results: DataFrame, by: list[str], score: str = "rmse", tie: str = "config_id") -> DataFrame:
    """The row of smallest score in each group, null scores last."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last(score), tie)
    return results.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def extracted(pred: DataFrame, targets: DataFrame, by: list[str], date: str = "period_date", predicted: str = "predicted") -> DataFrame:
    """One prediction for each target: exact date, else last of the same quarter, else same month, else the last of all."""
    j = targets.join(pred, by)
    d, t = F.col(date), F.col("target_date")
    mode = F.when(d == t, 1).when(quarter_end(d) == quarter_end(t), 2).when(F.last_day(d) == F.last_day(t), 3).otherwise(4)
    w = W.partitionBy(*by, "target_date").orderBy("__m", F.desc(date))
    names = F.array(*map(F.lit, ("exact", "same_quarter", "same_month", "last")))
    return j.withColumn("__m", mode).withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*by, "target_date", F.col(predicted), F.element_at(names, F.col("__m")).alias("mode"))


def config_grid(spark: SparkSession, **options: list) -> DataFrame:
    """Every combination of the options with config_id, an md5 over its sorted JSON without private (_) names."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in options.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), frames)  # parameter tables of a few rows
    public = sorted(c for c in grid.columns if not c.startswith("_"))
    return grid.withColumn("config_id", F.md5(F.to_json(F.struct(*public))))


def pending(grid: DataFrame, done: DataFrame, key: list[str] = ("config_id",)) -> DataFrame:
    return grid.join(done.select(*key).distinct(), list(key), "left_anti")
