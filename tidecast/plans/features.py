"""From the wide sales table and a calendar to the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import (
    Chain,
    Checkpointer,
    ColumnSelect,
    ColumnType,
    ConvertToDate,
    CreateFutureSet,
    DateFeatures,
    JoinDataFrame,
    MeltDataFrame,
    Operator,
    TargetEncoder,
)
from tidecast.operators.base import text_literal

# Columns, windows, lags and date parts of the sales panel.
CALENDAR_COLUMNS = ("d", "date", "Snap_CA", "Snap_TX", "Snap_WI")
SERIES_COLUMNS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
WINDOWS = (7, 15, 30, 90, 180)
LAGS = (7, 14, 21, 28)
DATE_PARTS = ("day_of_week", "day_of_month", "week_of_year", "week_of_month", "month", "year")

#: A calendar of up to this many days is sent to all executors: 270 years.
CALENDAR_ROWS = 100_000


def calendar_pipeline(calendar: DataFrame, *, columns: Sequence[str] = CALENDAR_COLUMNS, cut: bool = True) -> DataFrame:
    """The calendar columns with a parsed date; ``cut`` materialises them."""
    steps: list[Operator] = [
        ColumnSelect(columns),
        ConvertToDate(input_cols=["date"], date_format="yyyy-MM-dd"),
    ]
    if cut:
        steps.append(Checkpointer(eager=True))
    return Chain(*steps)(calendar)


@dataclass(frozen=True, kw_only=True)
class FeatureBuild(Operator):
    """Melt, cast, calendar join, future days, rolling features, date parts.

    Takes the wide table: one row per series, one column per day. A series in
    several rows gets its future days once. ``one_row_per_period`` leaves out the
    sums by period before the windows; unless given, the rows of the wide table
    are counted by ``partition_cols`` to see whether each has one. ``cut`` writes
    the joined panel to the checkpoint folder before the windows. The windows read
    the panel once, so it is off unless asked for.
    """

    calendar: DataFrame
    day_columns: Sequence[str] | None = None
    series_columns: Sequence[str] = SERIES_COLUMNS
    partition_cols: Sequence[str] = ("item_id", "store_id")
    n_periods: int = 28
    windows: Sequence[int] = WINDOWS
    lags: Sequence[int] = LAGS
    functions: Sequence[str] = ("mean", "std")
    prefix: str = "item_store"
    one_row_per_period: bool | None = None
    cut: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        ids = {c.lower() for c in self.series_columns}
        days = self.day_columns or [c for c in df.columns if c.lower() not in ids]
        # Each series has a cell for each day column, so the calendar knows the last date.
        melted_days = self.calendar.where(F.expr(f"d IN ({', '.join(map(text_literal, days))})"))
        steps: list[Operator] = [
            MeltDataFrame(
                id_vars=self.series_columns, value_vars=days, var_name="d", value_name="sales"
            ),
            ColumnType(input_cols=["sales"], value="float"),
            JoinDataFrame(df=self.calendar, on="d", how="left", broadcast_rows=CALENDAR_ROWS),
            CreateFutureSet(
                group_cols=self.series_columns,
                date_col="date",
                n_periods=self.n_periods,
                date_frequency="day",
                keys=df.select(*self.series_columns).dropDuplicates(),
                last_date=melted_days.agg(F.max("date")).scalar(),
            ),
        ]
        if self.cut:
            steps.append(Checkpointer(eager=True))
        unique = self.one_row_per_period
        if unique is None:
            unique = df.groupBy(*self.partition_cols).count().where("count > 1").isEmpty()
        steps += [
            TargetEncoder(
                partition_cols=self.partition_cols,
                rolling_windows=self.windows,
                lags=self.lags,
                functions=self.functions,
                date_frequency="day",
                value_col="sales",
                date_col="date",
                output_col_prefix=self.prefix,
                one_row_per_period=unique,
            ),
            DateFeatures(input_col="date", features=DATE_PARTS),
        ]
        return Chain(*steps)(df)


def feature_pipeline(actual: DataFrame, calendar: DataFrame, **options) -> DataFrame:
    """The feature table of a wide sales table and a prepared calendar."""
    return FeatureBuild(calendar=calendar, **options)(actual)
