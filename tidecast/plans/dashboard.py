"""The tables behind the forecast report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators import Chain, JoinDataFrame, MeltDataFrame, MemberFilter, PivotForecasts
from tidecast.operators.base import quoted
from tidecast.plans.features import CALENDAR_ROWS, SERIES_COLUMNS

ID_COLUMNS = SERIES_COLUMNS


def forecast_panel(
    actual: DataFrame,
    calendar: DataFrame,
    forecasts: DataFrame,
    folds: Sequence[int],
    id_vars: Sequence[str] = ID_COLUMNS,
) -> DataFrame:
    """Actuals of the wide table side by side with each fold's forecast.

    Days without a forecast and forecasts without an actual both stay.
    """
    long = Chain(
        MeltDataFrame(id_vars=id_vars, var_name="d", value_name="sales"),
        JoinDataFrame(df=calendar.select("d", "date"), on="d", how="left", broadcast_rows=CALENDAR_ROWS),
    )(actual)
    pivoted = PivotForecasts(index=["id", "date"], folds=folds)(forecasts)
    cells = [f"cv_{f}" for f in folds]
    joined = long.join(pivoted, ["id", "date"], "full")
    return joined.select(*[quoted(c) for c in [*id_vars, "d", "sales", "date", *cells]])


def filter_panel(
    df: DataFrame,
    *,
    product: str = "item_id",
    products: Sequence[str | None] = ("All",),
    location: str = "store_id",
    locations: Sequence[str | None] = ("All",),
) -> DataFrame:
    """The rows of the chosen products and locations."""
    return Chain(MemberFilter(product, products), MemberFilter(location, locations))(df)


def series_by_date(df: DataFrame, date_col: str = "date") -> DataFrame:
    """All numeric columns summed by date; NULL where a date has no value at all."""
    numbers = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != date_col
    ]
    return df.dropna(subset=[date_col]).groupBy(date_col).agg(*[F.sum(quoted(c)).alias(c) for c in numbers])
