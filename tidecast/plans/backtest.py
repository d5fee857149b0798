"""Cross-validated forecasts, one model per horizon block, final fits and future scores."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, is_dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.periods import Frequency, shift
from tidecast.models import Forecaster, TrainingRange, forecaster
from tidecast.operators import Fold, TimeBasedSplit
from tidecast.operators.base import quoted
from tidecast.sources.config import BacktestConfig, Block
from tidecast.sources.files import read_parquet, write_csv, write_parquet
from tidecast.sources.runlog import RunLog
from tidecast.storage import scratch_path

LAG = re.compile(r"_lag_(\d+)_")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables of one form."""
    return reduce(DataFrame.unionByName, frames)


def in_parallel(df: DataFrame, tasks: Sequence[Callable[[], Any]], threads: int) -> list[Any]:
    """Run independent Spark jobs from several driver threads; results in order."""
    if threads <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    spark = df.sparkSession
    with ThreadPoolExecutor(min(threads, len(tasks))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [w.result() for w in waiting]


#: Days of a unit: the fewest and the most.
UNIT_DAYS = {
    Frequency.YEAR: (365, 366),
    Frequency.MONTH: (28, 31),
    Frequency.WEEK: (7, 7),
    Frequency.DAY: (1, 1),
    Frequency.HOUR: (1 / 24, 1 / 24),
    Frequency.MINUTE: (1 / 1440, 1 / 1440),
    Frequency.SECOND: (1 / 86_400, 1 / 86_400),
    Frequency.MICROSECOND: (1 / 86_400e6, 1 / 86_400e6),
}


def check_leak(block: Block, date_frequency: str = "days", lag_frequency: str | None = None) -> None:
    """Error if a feature's lag may be shorter than the last step the block forecasts.

    Steps count in ``date_frequency``, lags in ``lag_frequency`` (the same unless
    given). Between two units, the shortest lag is held against the longest step.
    """
    steps = Frequency.parse(date_frequency)
    lags = steps if lag_frequency is None else Frequency.parse(lag_frequency)
    furthest = max(block.forecast_horizon)
    least = furthest if lags is steps else furthest * UNIT_DAYS[steps][1] / UNIT_DAYS[lags][0]
    short = [c for c in block.feature_cols if (m := LAG.search(c)) and int(m.group(1)) < least]
    if short:
        raise ValueError(f"features {short} see closer than {furthest} {steps.value}s back, the furthest step forecast")


def check_blocks(config: BacktestConfig) -> None:
    for block in config.models.values():
        check_leak(block, config.date_frequency, config.lag_frequency)


def fitted_models(
    model: Forecaster, df: DataFrame, ranges: Sequence[TrainingRange], *, target_col: str, threads: int
) -> list[PipelineModel]:
    """A model for each range: in shared passes if the forecaster can, else fitted one by one."""
    together = model.fit_ranges(df, ranges, target_col=target_col)
    if together is not None:
        return together

    def rows(r: TrainingRange) -> DataFrame:
        out, date = df, quoted(r.date_col) if r.date_col else None
        if r.until is not None:
            out = out.where(date <= F.lit(r.until).cast(r.date_type))
        return out if r.after is None else out.where(date > F.lit(r.after).cast(r.date_type))

    tasks = [lambda r=r: model.fit(rows(r), feature_cols=r.feature_cols, target_col=target_col) for r in ranges]
    return in_parallel(df, tasks, threads)


def training_range(fold: Fold, feature_cols: Sequence[str]) -> TrainingRange:
    return TrainingRange(tuple(feature_cols), fold.date_col, fold.date_type, fold.train_after, fold.train_end)


def fold_forecast(
    fitted: PipelineModel,
    fold: Fold,
    df: DataFrame,
    *,
    feature_cols: Sequence[str],
    target_col: str,
    id_cols: Sequence[str],
) -> DataFrame:
    """Forecast a fold's test rows."""
    date_col = fold.date_col
    first, last = fold.bounds()
    wanted = list(dict.fromkeys([*id_cols, date_col, target_col, *feature_cols]))
    return fitted.transform(fold.test(df).select(*map(quoted, wanted))).select(
        *map(quoted, id_cols),
        quoted(date_col),
        quoted(target_col),
        quoted("forecast"),
        F.lit(fold.number).alias("cv"),
        first.alias("train_start"),
        last.alias("train_end"),
    )


def cross_val_forecast(
    *,
    model: Forecaster,
    cv: Sequence[Fold] | TimeBasedSplit,
    df: DataFrame,
    date_col: str,
    feature_cols: Sequence[str],
    target_col: str,
    id_cols: Sequence[str],
    threads: int = 1,
) -> DataFrame:
    """Forecasts of all folds, with fold number and the first and last training date."""
    folds = cv.folds(df) if isinstance(cv, TimeBasedSplit) else list(cv)
    if any(f.date_col != date_col for f in folds):
        raise ValueError(f"the folds are over another column than {date_col}")

    models = fitted_models(model, df, [training_range(f, feature_cols) for f in folds], target_col=target_col, threads=threads)
    return stack(
        [
            fold_forecast(m, f, df, feature_cols=feature_cols, target_col=target_col, id_cols=id_cols)
            for m, f in zip(models, folds)
        ]
    )


def block_split(config: BacktestConfig, block: Block) -> TimeBasedSplit:
    """The split of one block; all blocks share their training ends."""
    furthest = max(block.forecast_horizon)
    return TimeBasedSplit(
        date_col=config.date_col,
        date_frequency=config.date_frequency,
        n_splits=config.splits,
        forecast_horizon=block.forecast_horizon,
        end_offset=config.test_size - furthest,
        step_length=config.test_size,
    )


def multi_horizon_forecast(
    df: DataFrame, config: BacktestConfig, model: Forecaster | None = None, threads: int = 4
) -> DataFrame:
    """Cross-validated forecasts of all horizon blocks."""
    model = forecaster(config.hyperparameters) if model is None else model
    blocks = list(config.models.values())
    check_blocks(config)
    unit = Frequency.parse(config.date_frequency)
    # All blocks share their training ends: one search for them, and the steps of each block.
    shared = block_split(config, Block(tuple(sorted({h for b in blocks for h in b.forecast_horizon})), ())).folds(df)
    jobs = [(b, fold.with_horizon(b.forecast_horizon, unit)) for b in blocks for fold in shared]
    ranges = [training_range(fold, b.feature_cols) for b, fold in jobs]
    models = fitted_models(model, df, ranges, target_col=config.target_col, threads=threads)
    return stack(
        [
            fold_forecast(m, fold, df, feature_cols=b.feature_cols, target_col=config.target_col, id_cols=[config.id_col])
            for m, (b, fold) in zip(models, jobs)
        ]
    )


def final_fit(
    df: DataFrame, config: BacktestConfig, model: Forecaster | None = None, threads: int = 4
) -> dict[str, PipelineModel]:
    """One model per block, fitted to all rows that have a target."""
    model = forecaster(config.hyperparameters) if model is None else model
    check_blocks(config)
    ranges = [TrainingRange(tuple(b.feature_cols)) for b in config.models.values()]
    return dict(zip(config.models, fitted_models(model, df, ranges, target_col=config.target_col, threads=threads)))


def score_future(
    df: DataFrame, models: dict[str, PipelineModel], config: BacktestConfig, last_date: str
) -> DataFrame:
    """Forecasts for the periods after ``last_date``, each by the model of its horizon block."""
    unit, last = Frequency.parse(config.date_frequency), dt.datetime.fromisoformat(last_date)
    kind = df.select(quoted(config.date_col)).schema[0].dataType.simpleString()
    parts = []
    for name, block in config.models.items():
        moments = [shift(last, h, unit) for h in block.forecast_horizon]
        rows = df.where(quoted(config.date_col).isin([F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind) for m in moments]))
        parts.append(
            models[name]
            .transform(rows)
            .select(quoted(config.id_col), quoted(config.date_col), F.lit(name).alias("model"), quoted("forecast"))
        )
    return stack(parts)


def cross_validate(
    df: DataFrame,
    config: BacktestConfig,
    log: RunLog,
    model: Forecaster | None = None,
    run_id: str | None = None,
    threads: int = 4,
    store_input: bool = True,
) -> str:
    """The whole back-test into the run log: parameters, forecasts, final models. Returns the run id.

    The forecasts are also written as CSV to the run's artifact ``output_dir/output_file``. All fits read the columns that they
    need from one stored copy of ``df``; ``store_input=False`` leaves that out, for a table that is stored already.
    """
    if store_input:
        names = [config.id_col, config.date_col, config.target_col, *(f for b in config.models.values() for f in b.feature_cols)]
        pruned = df.select(*map(quoted, dict.fromkeys(names)))
        df = read_parquet(df.sparkSession, write_parquet(pruned, scratch_path(df.sparkSession, "back-test")))
    run_id = log.new_run(run_id)
    log.log_params(run_id, config.hyperparameters if model is None else parameters_of(model))
    log.log_forecast(run_id, multi_horizon_forecast(df, config, model, threads))
    write_csv(log.forecast(run_id), log.artifact(run_id, f"{config.output_dir}/{config.output_file}"))
    for name, fitted in final_fit(df, config, model, threads).items():
        features = df.select(*map(quoted, config.models[name].feature_cols)).schema
        log.log_model(run_id, name, fitted, features)
    log.finish(run_id)
    return run_id


def parameters_of(model: Forecaster) -> dict[str, Any]:
    """The kind of a forecaster and what it was made with."""
    given = {f.name: getattr(model, f.name) for f in fields(model)} if is_dataclass(model) else {}
    return {"model": type(model).__name__, **{k: v for k, v in given.items() if not callable(v)}}
