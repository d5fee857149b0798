"""Integer parts of a date, by feature name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_month(day: Column) -> Column:
    """Week of the month, weeks starting on Sunday and week 1 holding the first day."""
    days_before = F.dayofweek(F.trunc(day, "month")) - 1
    return F.ceil((F.dayofmonth(day) + days_before) / 7).cast("int")


DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "day_of_week": F.dayofweek,
    "day_of_year": F.dayofyear,
    "day_of_month": F.dayofmonth,
    "week_of_year": F.weekofyear,
    "week_of_month": week_of_month,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
}
