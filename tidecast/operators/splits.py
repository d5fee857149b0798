"""Time-based train and test folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.periods import Frequency, shift
from tidecast.operators.base import Operator, quoted

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Fold:
    """One fold: its bounds, and what the table holds inside them.

    Training rows have ``train_after < date <= train_end`` (``train_after`` is
    None for an expanding window), test rows one of ``test_dates``. All moments
    are text that casts to the type of the date column.
    """

    number: int
    date_col: str
    date_type: str
    train_after: str | None
    train_end: str
    test_dates: tuple[str, ...]
    first_train: str | None = None
    last_train: str | None = None
    n_train: int = 0
    n_test: int = 0

    def _at(self, moment: str) -> Column:
        return F.lit(moment).cast(self.date_type)

    @property
    def is_train(self) -> Column:
        test = quoted(self.date_col) <= self._at(self.train_end)
        if self.train_after is not None:
            test = test & (quoted(self.date_col) > self._at(self.train_after))
        return test

    @property
    def is_test(self) -> Column:
        return quoted(self.date_col).isin([self._at(d) for d in self.test_dates])

    def train(self, df: DataFrame) -> DataFrame:
        return df.where(self.is_train)

    def test(self, df: DataFrame) -> DataFrame:
        # The range lets a scan skip files and row groups; the list picks the dates.
        first, last = min(self.test_dates), max(self.test_dates)
        return df.where(quoted(self.date_col).between(self._at(first), self._at(last)) & self.is_test)

    def with_horizon(self, steps: Sequence[int], unit: Frequency) -> Fold:
        """The same training rows, tested at these steps after their end; ``n_test`` is left as it was."""
        end, whole_days = dt.datetime.fromisoformat(self.train_end), len(self.train_end) == 10
        moments = [shift(end, h, unit) for h in steps]
        return replace(self, test_dates=tuple(m.date().isoformat() if whole_days else m.isoformat(" ", "microseconds") for m in moments))

    def bounds(self) -> tuple[Column, Column]:
        """First and last training date of the table, as typed columns."""
        return (
            F.lit(self.first_train).cast(self.date_type),
            F.lit(self.last_train).cast(self.date_type),
        )


@dataclass(frozen=True, kw_only=True)
class TimeBasedSplit(Operator):
    """Folds that train on the past and test on dates at given horizons after it.

    Fold 0 is the latest. Fold ``i`` trains up to ``i * step_length + end_offset +
    max(forecast_horizon)`` units before the last date of the table. Frequencies
    from microseconds to years; years and months clip at the month end.
    """

    date_frequency: str
    date_col: str
    forecast_horizon: Sequence[int] | None = None
    max_train_size: int | None = None
    n_splits: int = 5
    end_offset: int = 0
    step_length: int | None = None
    fold_col: str = "fold"
    role_col: str = "role"
    row_local = False

    def __post_init__(self) -> None:
        Frequency.parse(self.date_frequency)
        if self.forecast_horizon is not None and (
            len(self.forecast_horizon) == 0 or any(h < 1 for h in self.forecast_horizon)
        ):
            raise ValueError(f"forecast_horizon needs positive steps, not {self.forecast_horizon}")
        if self.max_train_size is not None and self.max_train_size < 0:
            raise ValueError(f"max_train_size must be positive, or 0 or None for no limit, not {self.max_train_size}")
        if self.n_splits < 1:
            raise ValueError(f"n_splits must be positive, not {self.n_splits}")
        if self.end_offset < 0:
            raise ValueError(f"end_offset must not be negative, not {self.end_offset}")
        if self.step_length is not None and self.step_length < 1:
            raise ValueError(f"step_length must be positive, not {self.step_length}")

    @property
    def horizon(self) -> list[int]:
        return list(self.forecast_horizon or [1])

    def folds(self, df: DataFrame) -> list[Fold]:
        """The folds over the dates of ``df``.

        Reads the date column twice, once for the last date and once to count
        each fold's rows, and brings back one row each time.
        """
        kind = self._date_type(df)
        moment = quoted(self.date_col)
        newest = df.agg(F.max(moment).cast("timestamp_ntz").alias("newest")).first()["newest"]
        if newest is None:
            raise ValueError(f"{self.date_col} holds no date")
        planned = [self._plan(i, newest, kind) for i in range(self.n_splits)]

        found = df.where(moment.isNotNull()).agg(
            *[
                agg.alias(f"{name}_{fold.number}")
                for fold in planned
                for name, agg in (
                    ("first", F.min(F.when(fold.is_train, moment)).cast("string")),
                    ("last", F.max(F.when(fold.is_train, moment)).cast("string")),
                    ("train", F.count_if(fold.is_train)),
                    ("test", F.count_if(fold.is_test)),
                )
            ]
        ).first()
        folds = [
            replace(
                fold,
                first_train=found[f"first_{fold.number}"],
                last_train=found[f"last_{fold.number}"],
                n_train=found[f"train_{fold.number}"],
                n_test=found[f"test_{fold.number}"],
            )
            for fold in planned
        ]
        empty = [f.number for f in folds if f.n_train == 0]
        if empty:
            raise ValueError(
                f"too many splits: no training rows in folds {empty} with n_splits={self.n_splits}, "
                f"forecast_horizon={self.horizon}, step_length={self._step()}, max_train_size={self.max_train_size}"
            )
        return folds

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` with fold number and role, once for each fold and role they are in."""
        return self.tag(df, self.folds(df))

    def split(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def tag(self, df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
        """The tagged rows, for folds that are known already: no join and no shuffle."""
        places = [
            F.when(test, F.struct(F.lit(f.number).alias(self.fold_col), F.lit(role).alias(self.role_col)))
            for f in folds
            for role, test in (("train", f.is_train), ("test", f.is_test))
        ]
        member = reduce(or_, [f.is_train | f.is_test for f in folds])
        return df.where(member).select("*", F.inline(F.array_compact(F.array(*places))))

    def _step(self) -> int:
        return self.step_length or max(self.horizon)

    def _plan(self, number: int, newest: dt.datetime, kind: str) -> Fold:
        unit = Frequency.parse(self.date_frequency)
        end = shift(newest, -(number * self._step() + self.end_offset + max(self.horizon)), unit)
        after = None if not self.max_train_size else shift(end, -self.max_train_size, unit)

        whole_days = kind == "date" and not unit.below_a_day

        def shown(moment: dt.datetime) -> str:
            return moment.date().isoformat() if whole_days else moment.isoformat(" ", "microseconds")

        return Fold(
            number,
            self.date_col,
            "timestamp_ntz" if kind == "date" and not whole_days else kind,
            None if after is None else shown(after),
            shown(end),
            tuple(shown(shift(end, h, unit)) for h in self.horizon),
        )

    def _date_type(self, df: DataFrame) -> str:
        field = next((f for f in df.schema.fields if f.name.lower() == self.date_col.lower()), None)
        if field is None:
            raise ValueError(f"no column {self.date_col!r} among {df.columns}")
        if not isinstance(field.dataType, DATE_TYPES):
            raise ValueError(f"{self.date_col} must be a date or timestamp, not {field.dataType.simpleString()}")
        return {T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz"}[
            type(field.dataType)
        ]
