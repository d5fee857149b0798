"""Calendar frequencies, and period arithmetic on columns and on single moments."""

from __future__ import annotations

import calendar
import datetime as dt
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Frequency(str, Enum):
    """A calendar unit. :meth:`parse` takes the singular and the plural name."""

    YEAR = "year"
    MONTH = "month"
    WEEK = "week"
    DAY = "day"
    HOUR = "hour"
    MINUTE = "minute"
    SECOND = "second"
    MICROSECOND = "microsecond"

    @classmethod
    def parse(cls, name: "str | Frequency", allowed: "tuple[Frequency, ...] | None" = None) -> "Frequency":
        allowed = tuple(cls) if allowed is None else allowed
        if isinstance(name, cls):
            unit = name
        else:
            unit = {n: u for u in cls for n in (u.value, u.value + "s")}.get(name)
        if unit not in allowed:
            raise ValueError(f"date frequency {name!r} is not one of {', '.join(u.value for u in allowed)}")
        return unit

    @property
    def below_a_day(self) -> bool:
        return self in (Frequency.HOUR, Frequency.MINUTE, Frequency.SECOND, Frequency.MICROSECOND)


#: Frequencies of the column operators, which work at day resolution.
PANEL_FREQUENCIES = (Frequency.DAY, Frequency.WEEK, Frequency.MONTH)


def add_periods(start: Column, n: Column, unit: Frequency) -> Column:
    """``start`` moved ``n`` days, weeks or months ahead (month ends are clipped)."""
    if unit is Frequency.MONTH:
        return F.add_months(start, n)
    return F.date_add(start, n * 7 if unit is Frequency.WEEK else n)


def periods_between(later: Column, earlier: Column, unit: Frequency) -> Column:
    """Signed distance in periods: whole for days, fractional for weeks and months."""
    if unit is Frequency.MONTH:
        return F.months_between(later, earlier)
    days = F.datediff(later, earlier)
    return days / 7 if unit is Frequency.WEEK else days


def shift(moment: dt.datetime, n: int, unit: Frequency) -> dt.datetime:
    """``moment`` moved by ``n`` calendar units; years and months clip at the month end."""
    if unit in (Frequency.YEAR, Frequency.MONTH):
        months = moment.year * 12 + moment.month - 1 + n * (12 if unit is Frequency.YEAR else 1)
        year, month = divmod(months, 12)
        last = calendar.monthrange(year, month + 1)[1]
        return moment.replace(year=year, month=month + 1, day=min(moment.day, last))
    return moment + dt.timedelta(**{unit.value + "s": n})
