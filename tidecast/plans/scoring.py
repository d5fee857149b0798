"""Scores of fold forecasts, and the scoring of logged runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.errors import n_scored, rmse
from tidecast.operators.base import quoted
from tidecast.sources.runlog import RunLog


def summarize_cv(
    df: DataFrame,
    *,
    date_col: str = "date",
    target_col: str = "sales",
    forecast_col: str = "forecast",
    by: Sequence[str] = ("cv",),
    strict: bool = False,
) -> DataFrame:
    """One row per fold: training and forecast bounds, RMSE, and how many rows it is over.

    Rows without target or forecast are left out of the RMSE; with ``strict``
    they are an error.
    """
    scored = n_scored(target_col, forecast_col)
    error = rmse(target_col, forecast_col)
    if strict:
        error = F.when(scored == F.count(F.lit(1)), error).otherwise(
            F.raise_error(F.lit(f"rows without {target_col} or {forecast_col}")).cast("double")
        )
    return (
        df.dropna(subset=list(by))
        .groupBy(*by)
        .agg(
            F.min("train_start").alias("train_start"),
            F.max("train_end").alias("train_end"),
            F.min(date_col).alias("forecast_start"),
            F.max(date_col).alias("forecast_end"),
            error.alias("rmse"),
            F.count(F.lit(1)).alias("n_rows"),
            scored.alias("n_scored"),
        )
    )


def mean_of_folds(folds: DataFrame) -> DataFrame:
    """The unweighted mean of the fold RMSEs."""
    return folds.agg(F.avg("rmse").alias("rmse"))


def rmse_by_column(
    df: DataFrame, columns: Sequence[str] | None = None, *, target_col: str = "sales", digits: int = 3
) -> DataFrame:
    """RMSE of each forecast column over the rows that have it, and their mean.

    ``columns`` are by default those with ``cv`` in their name. One pass serves
    all of them.
    """
    columns = [c for c in df.columns if "cv" in c] if columns is None else list(columns)
    scores = df.agg(*[rmse(quoted(target_col), quoted(c)).alias(c) for c in columns])
    known = F.array_compact(F.array(*map(quoted, columns)))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    rows = [F.struct(F.lit(c).alias("fold"), F.round(quoted(c), digits).alias("rmse")) for c in columns]
    rows.append(F.struct(F.lit("mean").alias("fold"), F.round(mean, digits).alias("rmse")))
    return scores.select(F.inline(F.array(*rows)))


def evaluate(log: RunLog, *, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Score every run that has no metric yet, log the results, and return all metrics.

    All waiting runs are scored together. The fold scores are stored first and
    the run scores are taken from there, so a call that breaks off is made good
    by the next one.
    """
    if log.unscored().isEmpty():
        return log.metrics()
    waiting = log.forecasts().join(log.unscored().select("run_id"), "run_id", "left_semi")
    log.log_fold_metrics(summarize_cv(waiting, date_col=date_col, target_col=target_col, by=("run_id", "cv")))
    new = log.fold_metrics().join(log.metrics().select("run_id"), "run_id", "left_anti")
    log.log_metrics(new.groupBy("run_id").agg(F.lit("rmse").alias("key"), F.avg("rmse").alias("value")))
    return log.metrics()
