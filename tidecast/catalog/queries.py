"""The queries: each takes a session and the folder of the tables, and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.catalog import panels
from tidecast.functions import rmse
from tidecast.models import (
    LeastSquares,
    Passthrough,
    StackedForecaster,
    TweedieBoostedTrees,
    boosted_trees,
    tweedie_linear,
)
from tidecast.operators import (
    Checkpointer,
    ColumnSelect,
    ColumnType,
    ConvertToDate,
    CreateFutureSet,
    DateCutoff,
    DateFeatures,
    Densify,
    JoinDataFrame,
    MeltDataFrame,
    PivotForecasts,
    TargetEncoder,
    TimeBasedSplit,
    TriangleEventEncoder,
    members,
)
from tidecast.functions.dateparts import DATE_PARTS
from tidecast.operators.base import quoted
from tidecast.plans.backtest import stack as stacked_rows
from tidecast.plans import (
    calendar_pipeline,
    cross_val_forecast,
    cross_validate,
    evaluate,
    feature_pipeline,
    filter_panel,
    final_fit,
    forecast_panel,
    mean_of_folds,
    multi_horizon_forecast,
    rmse_by_column,
    score_future,
    series_by_date,
    summarize_cv,
)
from tidecast.sources import (
    BacktestConfig,
    RunLog,
    read_csv_strings,
    read_csv_typed,
    read_parquet,
    table,
    write_csv,
    write_parquet,
)
from tidecast.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in the form both engines agree on: bigint, rounded double, ISO date text."""

    def column(field: T.StructField):
        col = quoted(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(field.dataType, T.IntegralType):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.FractionalType):
            col = F.round(col.cast("double"), digits)
        return col.alias(field.name)

    return df.select(*map(column, df.schema.fields))


def query(fn: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return shown(fn(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


# -- projections and filters ------------------------------------------------


@query
def select_columns(spark, folder):
    return ColumnSelect(["L_OrderKey", "l_linenumber", "l_quantity", "l_returnflag"])(table(spark, folder, "lineitem"))


@query
def cast_columns(spark, folder):
    """Quantities as text, with an unreadable mark on the open ones."""
    text = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.when(F.col("l_linestatus") == "O", "x").otherwise(""), F.col("l_quantity").cast("string")).alias("qty"),
        F.col("l_suppkey").cast("string").alias("supplier"),
    )
    return ColumnType(input_cols=["qty", "supplier"], value="float", output_cols=["qty", "supplier_number"])(text)


@query
def parse_dates(spark, folder):
    """Dates as text in two forms, of which one fits the pattern."""
    text = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy/MM/dd"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("shipped"),
    )
    return ConvertToDate(input_cols=["shipped"], date_format="yyyy-MM-dd", output_cols=["day"])(text)


@query
def parquet_scan_cutoff(spark, folder):
    orders = DateCutoff("o_orderdate", "2000-01-01")(table(spark, folder, "orders"))
    return orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


@query
def filter_dimensions(spark, folder):
    panel = panels.brand_panel(spark, folder)
    return filter_panel(panel, products=["Brand#2", "Brand#17", None], locations=["All"])


@query
def dimension_members(spark, folder):
    return members(panels.brand_panel(spark, folder), "item_id")


# -- sources and sinks --------------------------------------------------------


def orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("day"),
    )


ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, day date"


@query
def parquet_roundtrip(spark, folder):
    path = write_parquet(orders(spark, folder), scratch_path(spark, "orders"))
    return read_parquet(spark, path)


@query
def csv_string_scan(spark, folder):
    path = write_csv(
        orders(spark, folder).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)")),
        scratch_path(spark, "orders"),
    )
    return read_csv_strings(spark, path)


@query
def csv_typed_scan(spark, folder):
    path = write_csv(orders(spark, folder), scratch_path(spark, "orders"))
    return read_csv_typed(spark, path, ORDERS)


@query
def csv_roundtrip(spark, folder):
    """Fold forecasts through CSV, as a report reads them."""
    forecasts = panels.fold_forecasts(spark, folder)
    path = write_csv(forecasts, scratch_path(spark, "forecast"))
    return read_csv_typed(spark, path, forecasts.schema)


@query
def checkpoint_passthrough(spark, folder):
    return Checkpointer(eager=True)(orders(spark, folder))


# -- joins --------------------------------------------------------------------


def customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment")


def customer_orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")


def event_users(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"))


def daily_orders(spark, folder):
    day = F.col("o_orderdate").cast("date").alias("day")
    return table(spark, folder, "orders").groupBy(day).agg(F.count(F.lit(1)).alias("n_orders"))


def daily_lines(spark, folder):
    day = F.col("l_shipdate").cast("date").alias("day")
    return table(spark, folder, "lineitem").groupBy(day).agg(F.sum("l_quantity").alias("qty"))


@query
def join_inner(spark, folder):
    return JoinDataFrame(df=customer_orders(spark, folder), on="c_custkey", how="inner")(customers(spark, folder))


@query
def join_left(spark, folder):
    return JoinDataFrame(df=customer_orders(spark, folder), on="c_custkey", how="left")(customers(spark, folder))


@query
def join_right(spark, folder):
    return JoinDataFrame(df=daily_lines(spark, folder), on=["day"], how="right")(daily_orders(spark, folder))


@query
def join_full(spark, folder):
    return JoinDataFrame(df=daily_lines(spark, folder), on=["day"], how="full")(daily_orders(spark, folder))


@query
def join_semi(spark, folder):
    return JoinDataFrame(df=event_users(spark, folder), on="c_custkey", how="left_semi")(customers(spark, folder))


@query
def join_anti(spark, folder):
    return JoinDataFrame(df=event_users(spark, folder), on="c_custkey", how="left_anti")(customers(spark, folder))


@query
def join_calendar(spark, folder):
    days = panels.calendar(spark, folder).select("d", F.col("date").alias("day"), "snap_CA")
    return JoinDataFrame(df=days, on="d", how="left", broadcast_rows=100_000)(melted(spark, folder))


# -- reshape ------------------------------------------------------------------


def melted(spark, folder):
    wide = panels.wide(spark, folder, panels.flag_panel(spark, folder))
    days = [c for c in wide.columns if c.startswith("d_")]
    return MeltDataFrame(id_vars=["id", "item_id", "store_id"], value_vars=days, var_name="d", value_name="sales")(wide)


@query
def melt_listed(spark, folder):
    return melted(spark, folder)


@query
def melt_rest(spark, folder):
    wide = panels.wide(spark, folder, panels.flag_panel(spark, folder))
    return MeltDataFrame(id_vars=panels.SERIES_COLUMNS, var_name="d", value_name="sales")(wide)


@query
def pivot_fold_forecasts(spark, folder):
    return PivotForecasts(index=["id", "date"], folds=[0, 1])(panels.fold_forecasts(spark, folder))


# -- dates --------------------------------------------------------------------


@query
def date_features(spark, folder):
    return DateFeatures(input_col="date", features=list(DATE_PARTS))(panels.flag_panel(spark, folder))


@query
def date_features_renamed(spark, folder):
    return DateFeatures(
        input_col="date", features=["month", "quarter", "year"], output_cols=["m", "q", "y"]
    )(panels.flag_panel(spark, folder))


def future(unit, **options):
    return CreateFutureSet(
        date_col="date", n_periods=28, date_frequency=unit, group_cols=["id", "item_id", "store_id"], **options
    )


@query
def future_day(spark, folder):
    return future("day")(panels.flag_panel(spark, folder))


@query
def future_week(spark, folder):
    return future("week")(panels.flag_panel(spark, folder))


@query
def future_month(spark, folder):
    return future("month")(panels.flag_panel(spark, folder))


@query
def future_per_group(spark, folder):
    return future("day", per_group=True)(panels.flag_panel(spark, folder))


@query
def future_no_group(spark, folder):
    return CreateFutureSet(date_col="day", n_periods=28, date_frequency="day")(daily_lines(spark, folder))


@query
def densify(spark, folder):
    return Densify(date_col="date", value_col="sales", group_cols=["item_id", "store_id"])(
        panels.brand_panel(spark, folder).drop("id")
    )


# -- rolling features ---------------------------------------------------------


def rolling(unit, windows, lags, functions=("mean", "std"), **options):
    options = {"value_col": "sales", "date_col": "date", "partition_cols": ["item_id", "store_id"], **options}
    return TargetEncoder(
        rolling_windows=windows, lags=lags, functions=functions, date_frequency=unit, output_col_prefix="r", **options
    )


@query
def encode_day(spark, folder):
    return rolling("day", [7, 30], [7, 28], one_row_per_period=True)(panels.brand_panel(spark, folder))


@query
def encode_week(spark, folder):
    return rolling("week", [2, 8], [1, 4], one_row_per_period=True)(panels.brand_panel(spark, folder))


@query
def encode_month(spark, folder):
    return rolling("month", [1, 3], [1, 2], one_row_per_period=True)(panels.flag_panel(spark, folder))


def line_rows(spark, folder):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return panels.shipped(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "date", "l_quantity", charge.alias("charge")
    )


@query
def encode_coarse(spark, folder):
    """Single order lines, many to a day, with the past of their return flag."""
    rows = rolling("day", [7, 30], [1, 7], value_col="l_quantity", partition_cols=["l_returnflag"])(
        line_rows(spark, folder)
    )
    return rows.drop("charge")


@query
def encode_price(spark, folder):
    """As encode_coarse, over amounts that are no whole numbers."""
    rows = rolling("day", [30], [7], value_col="charge", partition_cols=["l_returnflag"])(
        line_rows(spark, folder)
    )
    return shown(rows.select("l_orderkey", "l_linenumber", "r_window_30_lag_7_mean", "r_window_30_lag_7_std"), 4)


@query
def encode_no_partition(spark, folder):
    rows = rolling("day", [7, 30], [1], value_col="l_quantity", partition_cols=None)(line_rows(spark, folder))
    return rows.drop("charge")


ALL_FUNCTIONS = ("mean", "std", "min", "max", "sum", "count", "var", "stddev_pop", "var_pop")


@query
def encode_functions(spark, folder):
    return rolling("day", [7], [7], functions=ALL_FUNCTIONS)(panels.flag_panel(spark, folder))


# -- event proximity ------------------------------------------------------------


def proximity(unit, window, **options):
    return TriangleEventEncoder(
        partition_cols=["user_id"],
        input_cols=["event"],
        date_col="day",
        window=window,
        date_frequency=unit,
        output_cols=["nearest"],
        **options,
    )


@query
def event_proximity_day(spark, folder):
    return proximity("day", 3, one_row_per_date=True)(panels.purchases(spark, folder))


@query
def event_proximity_week(spark, folder):
    return proximity("week", 1, one_row_per_date=True)(panels.purchases(spark, folder))


@query
def event_proximity_month(spark, folder):
    return proximity("month", 1, one_row_per_date=True)(panels.purchases(spark, folder))


@query
def event_proximity_ties(spark, folder):
    """Single events, many to a user and day, two flags at once."""
    rows = table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").alias("day"),
        (F.col("event_type") == "purchase").cast("int").cast("string").alias("bought"),
        (F.col("event_type") == "error").cast("int").alias("failed"),
    )
    return TriangleEventEncoder(
        partition_cols=["user_id"],
        input_cols=["bought", "failed"],
        date_col="day",
        window=2,
        date_frequency="day",
    )(rows)


# -- chains ---------------------------------------------------------------------


@query
def calendar_table(spark, folder):
    """The calendar chain: columns picked, dates parsed, lineage cut."""
    return calendar_pipeline(panels.calendar(spark, folder))


def features_of_wide(spark, folder):
    """The feature table, 58 columns wide, of the wide table of the flag panel."""
    wide = panels.wide(spark, folder, panels.flag_panel(spark, folder))
    days = [c for c in wide.columns if c.startswith("d_")]
    return feature_pipeline(wide, calendar_pipeline(panels.calendar(spark, folder)), day_columns=days)


@query
def feature_table(spark, folder):
    return features_of_wide(spark, folder)


@query
def minimum_slice(spark, folder):
    """Daily series, 28 future days, rolling features and date parts."""
    panel = future("day")(panels.flag_panel(spark, folder))
    featured = rolling("day", [7, 30], [7, 28], one_row_per_period=True)(panel)
    return DateFeatures(input_col="date", features=["day_of_week", "week_of_month", "month", "year"])(featured)


# -- folds ----------------------------------------------------------------------


def tagged(spark, folder, **options):
    options = {"date_frequency": "days", "date_col": "date", **options}
    panel = panels.flag_panel(spark, folder).select("id", "date")
    return TimeBasedSplit(**options).split(panel)


@query
def cv_split_expanding(spark, folder):
    return tagged(spark, folder, forecast_horizon=list(range(1, 8)), n_splits=3)


@query
def cv_split_sliding(spark, folder):
    return tagged(spark, folder, forecast_horizon=list(range(1, 8)), n_splits=3, max_train_size=90)


@query
def cv_split_gap(spark, folder):
    """Steps 8, 11 and 14 ahead, folds 28 days apart, 14 days kept out at the end."""
    return tagged(spark, folder, forecast_horizon=[8, 11, 14], n_splits=3, end_offset=14, step_length=28)


@query
def cv_split_month(spark, folder):
    return tagged(spark, folder, date_frequency="months", forecast_horizon=[1, 2], n_splits=3, max_train_size=12)


@query
def cv_split_hour(spark, folder):
    """Folds below a day, over the time stamps of the events cut to the hour."""
    hours = table(spark, folder, "events").select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    )
    return TimeBasedSplit(
        date_frequency="hours", date_col="hour", forecast_horizon=[1, 2, 3, 6], n_splits=2, max_train_size=48
    ).split(hours)


# -- back-test --------------------------------------------------------------------


@query
def cv_forecast_passthrough(spark, folder):
    return panels.fold_forecasts(spark, folder)


def backtest(spark, folder, model, features, functions=("mean",), windows=(7,)):
    return cross_val_forecast(
        model=model,
        cv=panels.BACKTEST,
        df=panels.stored(panels.lagged(panels.flag_panel(spark, folder), windows=windows, functions=functions)),
        date_col="date",
        feature_cols=features,
        target_col="sales",
        id_cols=["id"],
    )


@query
def cv_forecast_ols(spark, folder):
    return backtest(spark, folder, LeastSquares(), ["item_store_window_7_lag_28_mean"])


def blocks(windows=(7,), functions=("mean",), parts=()):
    """Four horizon blocks of a week, each with the features of its own lag."""
    return BacktestConfig.from_dict(
        {
            "data": {"id_col": "id", "target_col": "sales", "date_col": "date", "date_frequency": "days"},
            "hyperparameters": {"objective": "least_squares"},
            "cv": {"splits": 2, "test_size": 28},
            "models": {
                f"week_{i}": {
                    "forecast_horizon": list(range(7 * i - 6, 7 * i + 1)),
                    "feature_cols": [
                        *[f"item_store_window_{w}_lag_{7 * i}_{f}" for w in windows for f in functions],
                        *parts,
                    ],
                }
                for i in (1, 2, 3, 4)
            },
        }
    )


@query
def cv_direct_multi_horizon(spark, folder):
    rows = panels.stored(panels.lagged(panels.flag_panel(spark, folder), lags=(7, 14, 21, 28)))
    return multi_horizon_forecast(rows, blocks())


def by_weekday(spark, folder, model, features=("day_of_week",)):
    """A back-test over few-valued features, of which SQL can tell the fitted model."""
    panel = DateFeatures(input_col="date", features=["day_of_week"])(panels.flag_panel(spark, folder))
    rows = panels.stored(panel.withColumn("weekend", F.col("day_of_week").isin(1, 7).cast("int")))
    return cross_val_forecast(
        model=model, cv=panels.BACKTEST, df=rows, date_col="date", feature_cols=list(features), target_col="sales", id_cols=["id"]
    )


@query
def cv_forecast_gbt(spark, folder):
    return by_weekday(spark, folder, boosted_trees(depth=6))


@query
def cv_forecast_tweedie(spark, folder):
    return by_weekday(spark, folder, TweedieBoostedTrees(depth=6))


@query
def cv_forecast_tweedie_linear(spark, folder):
    return shown(by_weekday(spark, folder, tweedie_linear(regularisation=0.0), ["weekend"]), 4)


@query
def stacked_predictions(spark, folder):
    """Three forecasters side by side on the test rows of all folds."""
    rows = panels.stored(panels.lagged(panels.flag_panel(spark, folder), windows=(7, 30)))
    week, month = (["item_store_window_7_lag_28_mean"], ["item_store_window_30_lag_28_mean"])
    stack = StackedForecaster([Passthrough(), LeastSquares(), LeastSquares()])
    parts = []
    for fold in panels.BACKTEST.folds(rows):
        model = stack.fit(fold.train(rows), feature_sets=[week, week, month], target_col="sales")
        parts.append(model.transform(fold.test(rows)).withColumn("cv", F.lit(fold.number)))
    return stacked_rows(parts).select("id", "date", "sales", "cv", "pred_1", "pred_2", "pred_3")


@query
def final_fit_predict(spark, folder):
    """Fit each block to all rows, then forecast the 28 days after the last one."""
    config = blocks()
    panel = panels.flag_panel(spark, folder)
    featured = panels.stored(panels.lagged(future("day")(panel), lags=(7, 14, 21, 28)))
    last = panel.agg(F.max("date").cast("string")).first()[0]
    return score_future(featured, final_fit(featured, config), config, last)


def final_fit_at(spark, folder, unit):
    """The flag panel by week or month: fit to all rows, forecast the four periods after the last one."""
    config = BacktestConfig.from_dict(
        {
            "data": {"id_col": "id", "target_col": "sales", "date_col": "date", "date_frequency": unit + "s"},
            "hyperparameters": {"objective": "least_squares"},
            "cv": {"splits": 1, "test_size": 4},
            "models": {
                name: {"forecast_horizon": steps, "feature_cols": [f"r_window_2_lag_{max(steps)}_mean"]}
                for name, steps in {"near": [1, 2], "far": [3, 4]}.items()
            },
        }
    )
    panel = (
        panels.flag_panel(spark, folder)
        .groupBy("id", "item_id", "store_id", F.date_trunc(unit, "date").cast("date").alias("date"))
        .agg(F.sum("sales").alias("sales"))
    )
    more = CreateFutureSet(date_col="date", n_periods=4, date_frequency=unit, group_cols=["id", "item_id", "store_id"])
    featured = panels.stored(rolling(unit, [2], [2, 4], one_row_per_period=True)(more(panel)))
    last = panel.agg(F.max("date").cast("string")).first()[0]
    return score_future(featured, final_fit(featured, config), config, last)


@query
def final_fit_predict_week(spark, folder):
    return final_fit_at(spark, folder, "week")


@query
def final_fit_predict_month(spark, folder):
    return final_fit_at(spark, folder, "month")


# -- scores and run log -------------------------------------------------------------


@query
def rmse_global(spark, folder):
    return panels.fold_forecasts(spark, folder).agg(rmse("sales", "forecast").alias("rmse"))


@query
def fold_summary(spark, folder):
    return summarize_cv(panels.fold_forecasts(spark, folder))


@query
def rmse_mean_of_folds(spark, folder):
    return mean_of_folds(summarize_cv(panels.fold_forecasts(spark, folder)))


@query
def rmse_by_fold_column(spark, folder):
    return rmse_by_column(panel_with_forecasts(spark, folder))


@query
def runlog_append(spark, folder):
    """A back-test logged and scored: the stored fold scores, with the stored mean."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    log.log_params("first", {"objective": "passthrough"})
    log.log_forecast("first", panels.fold_forecasts(spark, folder))
    log.finish("first", "passthrough")
    scores = evaluate(log).select("run_id", F.col("value").alias("mean_rmse"))
    return log.fold_metrics().join(scores, "run_id").select("run_id", "cv", "n_rows", "rmse", "mean_rmse")


@query
def runlog_unscored(spark, folder):
    """Of two logged runs, one scored before the other came: the one that waits."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    forecasts = panels.fold_forecasts(spark, folder)
    for run in ("first", "second"):
        log.log_forecast(run, forecasts)
        log.finish(run)
        if run == "first":
            evaluate(log)
    waiting = log.unscored().select("run_id")
    return log.forecasts().join(waiting, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def logged_backtest(spark, folder):
    """The whole back-test: run log, stored models, scores."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    rows = panels.stored(panels.lagged(panels.flag_panel(spark, folder), lags=(7, 14, 21, 28)))
    cross_validate(rows, blocks(), log, run_id="run")
    evaluate(log)
    return log.fold_metrics().select(
        "run_id", "cv", "train_start", "train_end", "forecast_start", "forecast_end", "n_rows", "rmse"
    )


# -- report -------------------------------------------------------------------------


def panel_with_forecasts(spark, folder):
    wide = panels.wide(spark, folder, panels.flag_panel(spark, folder))
    days = calendar_pipeline(panels.calendar(spark, folder), columns=["d", "date"], cut=False)
    panel = forecast_panel(wide, days, panels.fold_forecasts(spark, folder), folds=[0, 1])
    return ColumnType(input_cols=["sales"], value="double")(panel)


@query
def dash_panel(spark, folder):
    return panel_with_forecasts(spark, folder)


@query
def dash_series_by_date(spark, folder):
    return series_by_date(filter_panel(panel_with_forecasts(spark, folder), products=["A", "R"]))
