"""Forecast error measures as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(actual: str | Column, forecast: str | Column) -> Column:
    """Root mean squared error over the rows where both sides are present."""
    actual = F.col(actual) if isinstance(actual, str) else actual
    forecast = F.col(forecast) if isinstance(forecast, str) else forecast
    miss = actual.cast("double") - forecast.cast("double")
    return F.sqrt(F.avg(miss * miss))


def n_scored(actual: str, forecast: str) -> Column:
    """Number of rows that :func:`rmse` uses."""
    return F.count(F.when(F.col(actual).isNotNull() & F.col(forecast).isNotNull(), 1))
