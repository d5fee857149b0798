"""Distance of each row to the nearest event of its series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.periods import PANEL_FREQUENCIES, Frequency, periods_between
from tidecast.operators.base import Operator, fresh, paired, quoted, replace_columns


@dataclass(frozen=True, kw_only=True)
class TriangleEventEncoder(Operator):
    """Periods to the next event, else minus the periods since the last one.

    An input column flags events with 1 (a number or its text). Distances beyond
    ``window`` count as no event; with neither event in reach the result is NULL,
    and on the day of an event it is 0. Rows of one date share their result.

    Rows are reduced to one per partition and date before the windows run, so a
    partition never brings more rows into a task than it has dates; the result is
    joined back. ``one_row_per_date`` skips both for a panel that is of this form
    already.
    """

    partition_cols: Sequence[str]
    input_cols: Sequence[str]
    date_col: str
    window: int
    date_frequency: str
    output_cols: Sequence[str] | None = None
    one_row_per_date: bool = False

    def __post_init__(self) -> None:
        Frequency.parse(self.date_frequency, PANEL_FREQUENCIES)
        paired(self.input_cols, self.output_cols)
        if self.window < 0:
            raise ValueError(f"window must not be negative, not {self.window}")

    def transform(self, df: DataFrame) -> DataFrame:
        parts = list(self.partition_cols)
        pairs = paired(self.input_cols, self.output_cols)
        day, *names = fresh(df, "day", *[f"event_{i}" for i in range(2 * len(pairs))])
        events, nearest = names[: len(pairs)], names[len(pairs) :]
        dated = df.select("*", quoted(self.date_col).cast("date").alias(day))
        flags = [
            F.when(quoted(i).try_cast("double") == 1, F.col(day)).alias(e) for (i, _), e in zip(pairs, events)
        ]
        if self.one_row_per_date:
            found = self._distances(dated.select("*", *flags), parts, day, events, nearest)
            return found.select(*replace_columns(df, {o: F.col(n) for (_, o), n in zip(pairs, nearest)}))

        days = (
            dated.where(F.col(day).isNotNull())
            .select(*map(quoted, parts), day, *flags)
            .groupBy(*map(quoted, parts), day)
            .agg(*[F.max(e).alias(e) for e in events])
        )
        found = self._distances(days, parts, day, events, nearest)
        keys = fresh(dated, *[f"key_{c}" for c in parts], "key_day")
        found = found.select(
            *[quoted(c).alias(k) for c, k in zip(parts, keys)], F.col(day).alias(keys[-1]), *nearest
        )
        same = F.col(day) == F.col(keys[-1])
        for c, k in zip(parts, keys):
            same = same & quoted(c).eqNullSafe(F.col(k))
        joined = dated.join(found, same, "left")
        return joined.select(*replace_columns(df, {o: F.col(n) for (_, o), n in zip(pairs, nearest)}))

    def _distances(
        self, days: DataFrame, parts: list[str], day: str, events: list[str], nearest: list[str]
    ) -> DataFrame:
        unit = Frequency.parse(self.date_frequency)
        series = Window.partitionBy(*map(quoted, parts))
        # Both frames grow from the start of their order, so each row is added once.
        so_far = series.orderBy(F.col(day).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        from_here = series.orderBy(F.col(day).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

        def distance(event: str) -> Column:
            to_next = periods_between(F.min(event).over(from_here), F.col(day), unit)
            since_last = periods_between(F.max(event).over(so_far), F.col(day), unit)
            return F.greatest(
                F.when(to_next <= self.window, to_next), F.when(since_last >= -self.window, since_last)
            )

        return days.select("*", *[distance(e).alias(n) for e, n in zip(events, nearest)])
