"""Panels derived from the tables: what the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.models import Passthrough
from tidecast.operators import TargetEncoder, TimeBasedSplit
from tidecast.plans.backtest import cross_val_forecast
from tidecast.plans.features import SERIES_COLUMNS
from tidecast.sources import read_csv_strings, read_parquet, table, write_csv, write_parquet
from tidecast.storage import broadcast_within, scratch_path

#: Parts or suppliers that are sent to all executors at most; each is a number and a short name.
DIMENSION_ROWS = 1_000_000


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))


def flag_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity by day, return flag and line status (panel D)."""
    return (
        shipped(spark, folder)
        .groupBy("l_returnflag", "l_linestatus", "date")
        .agg(F.sum("l_quantity").alias("sales"))
        .select(
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("id"),
            F.col("l_returnflag").alias("item_id"),
            F.col("l_linestatus").alias("store_id"),
            "date",
            "sales",
        )
    )


def brand_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity by day, brand and region of the supplier (panel P).

    The lines meet parts and suppliers where they are read, if those tables are
    within the bounds of a broadcast, and are shuffled once, summed up. Beyond
    the bounds the joins shuffle, and adaptive execution splits a hot part.
    """
    brands = table(spark, folder, "part").select("p_partkey", "p_brand")
    regions = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    return (
        shipped(spark, folder)
        .join(broadcast_within(brands, DIMENSION_ROWS), F.col("l_partkey") == F.col("p_partkey"))
        .join(broadcast_within(regions, DIMENSION_ROWS), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("p_brand", "r_name", "date")
        .agg(F.sum("l_quantity").alias("sales"))
        .select(
            F.concat_ws("_", "p_brand", "r_name").alias("id"),
            F.col("p_brand").alias("item_id"),
            F.col("r_name").alias("store_id"),
            "date",
            "sales",
        )
    )


def day_span(spark: SparkSession, folder: str) -> tuple[Column, Column]:
    """First and last shipping day, as scalar subqueries."""
    rows = shipped(spark, folder)
    return rows.agg(F.min("date")).scalar(), rows.agg(F.max("date")).scalar()


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day, all text: key, date, three event flags and a column nobody asks for (panel C)."""
    first, last = day_span(spark, folder)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"), first.alias("first"))
    month_day = F.dayofmonth("day")
    return days.select(
        day_key(F.col("day"), F.col("first")).alias("d"),
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.when(month_day <= 10, "1").otherwise("0").alias("snap_CA"),
        F.when(month_day % 2 == 1, "1").otherwise("0").alias("snap_TX"),
        F.when(month_day % 3 == 0, "1").otherwise("0").alias("snap_WI"),
        F.date_format("day", "E").alias("weekday"),
    )


def day_key(day: Column, first: Column) -> Column:
    return F.concat(F.lit("d_"), (F.datediff(day, first) + 1).cast("string"))


def wide(spark: SparkSession, folder: str, long: DataFrame) -> DataFrame:
    """A panel as a CSV file with six id columns and one per day, ``d_1`` and so on, read as text (panel W)."""
    rows = shipped(spark, folder)
    span = rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    names = [f"d_{i}" for i in range(1, (span["last"] - span["first"]).days + 2)]
    ids = {
        "id": F.col("id"),
        "item_id": F.col("item_id"),
        "dept_id": F.concat(F.lit("dept_"), "item_id"),
        "cat_id": F.lit("cat"),
        "store_id": F.col("store_id"),
        "state_id": F.concat(F.lit("state_"), "store_id"),
    }
    keyed = long.select(
        *[ids[c].alias(c) for c in SERIES_COLUMNS],
        day_key(F.col("date"), F.lit(span["first"])).alias("d"),
        F.col("sales").cast("int").alias("sales"),
    )
    pivoted = keyed.groupBy(*SERIES_COLUMNS).pivot("d", names).agg(F.sum("sales"))
    return read_csv_strings(spark, write_csv(pivoted, scratch_path(spark, "actuals")))


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a user bought, by user and day (panel E)."""
    return (
        table(spark, folder, "events")
        .select("user_id", F.col("ts").cast("date").alias("day"), (F.col("event_type") == "purchase").alias("bought"))
        .groupBy("user_id", "day")
        .agg(F.max(F.col("bought").cast("int")).alias("event"))
    )


def lagged(panel: DataFrame, windows=(7,), lags=(28,), functions=("mean",)) -> DataFrame:
    """A panel with its rolling features by series."""
    return TargetEncoder(
        value_col="sales",
        date_col="date",
        rolling_windows=windows,
        lags=lags,
        functions=functions,
        date_frequency="day",
        output_col_prefix="item_store",
        partition_cols=["item_id", "store_id"],
        one_row_per_period=True,
    )(panel)


def stored(df: DataFrame) -> DataFrame:
    """The rows through a Parquet table, for steps that read them many times."""
    return read_parquet(df.sparkSession, write_parquet(df, scratch_path(df.sparkSession, "features")))


BACKTEST = TimeBasedSplit(date_frequency="days", date_col="date", forecast_horizon=range(1, 29), n_splits=2)


def fold_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts of two folds of 28 days: the week's mean of 28 days before (panel F)."""
    return cross_val_forecast(
        model=Passthrough(),
        cv=BACKTEST,
        df=stored(lagged(flag_panel(spark, folder))),
        date_col="date",
        feature_cols=["item_store_window_7_lag_28_mean"],
        target_col="sales",
        id_cols=["id"],
    )
