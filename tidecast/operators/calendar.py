"""Date parts and future periods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dateparts import DATE_PARTS
from tidecast.functions.periods import PANEL_FREQUENCIES, Frequency, add_periods
from tidecast.operators.base import Operator, fresh, paired, quoted


@dataclass(frozen=True, kw_only=True)
class DateFeatures(Operator):
    """Integer date parts of one date column; see :data:`DATE_PARTS` for the names."""

    input_col: str
    features: Sequence[str]
    output_cols: Sequence[str] | None = None
    row_local = True

    def __post_init__(self) -> None:
        unknown = [f for f in self.features if f not in DATE_PARTS]
        if unknown:
            raise ValueError(f"unknown date features {unknown}; known are {', '.join(DATE_PARTS)}")
        paired(self.features, self.output_cols)

    def transform(self, df: DataFrame) -> DataFrame:
        day = quoted(self.input_col)
        return df.withColumns({o: DATE_PARTS[f](day) for f, o in paired(self.features, self.output_cols)})


@dataclass(frozen=True, kw_only=True)
class CreateFutureSet(Operator):
    """Append ``n_periods`` rows per series after the last date of the whole table.

    All columns but the keys and the date are NULL in the new rows. With
    ``per_group`` each series goes on from its own last date. ``keys``, a table
    that already holds each series once (such as the wide table before the
    melt), saves the distinct over the long table; ``last_date``, a scalar column,
    saves the search for the last date.
    """

    date_col: str
    n_periods: int
    date_frequency: str
    group_cols: Sequence[str] | None = None
    per_group: bool = False
    keys: DataFrame | None = None
    last_date: Column | None = None

    def __post_init__(self) -> None:
        Frequency.parse(self.date_frequency, PANEL_FREQUENCIES)
        if self.n_periods < 1:
            raise ValueError(f"n_periods must be positive, not {self.n_periods}")
        if self.per_group and (self.keys is not None or self.last_date is not None):
            raise ValueError("per_group finds the last dates in the table itself, so it takes no keys and no last_date")

    def transform(self, df: DataFrame) -> DataFrame:
        unit = Frequency.parse(self.date_frequency, PANEL_FREQUENCIES)
        groups = list(self.group_cols or [])
        last, step, rows = fresh(df, "last", "step", "rows")
        newest = F.max(quoted(self.date_col)).alias(last)
        start = self.last_date
        if not groups:
            series = df.agg(newest, F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 0)
            start = F.col(last) if start is None else start
        elif self.per_group:
            series = df.groupBy(*groups).agg(newest)
            start = F.col(last)
        else:
            # One aggregate over the table holds the series and their last dates; over it, the last date of all
            # enters as a scalar subquery that reads the same shuffle.
            ends = df.groupBy(*groups).agg(newest)
            series = ends if self.keys is None else self.keys.select(*groups)
            if start is None:
                start = (ends if self.keys is None else df).agg(F.max(F.col(last) if self.keys is None else quoted(self.date_col))).scalar()
        steps = series.select("*", F.explode(F.sequence(F.lit(1), F.lit(self.n_periods))).alias(step))

        keep = {c.lower() for c in groups}
        future = []
        for field in df.schema.fields:
            if field.name.lower() == self.date_col.lower():
                value = add_periods(start, F.col(step), unit).cast(field.dataType)
            elif field.name.lower() in keep:
                value = quoted(field.name)
            else:
                value = F.lit(None).cast(field.dataType)
            future.append(value.alias(field.name))
        return df.unionByName(steps.select(*future))


@dataclass(frozen=True, kw_only=True)
class Densify(Operator):
    """Give every series a row for every day between the first and last date of the table.

    Days without a row get one with ``fill`` as its value and NULL in all other
    columns. Rows that are there stay as they are: repeated rows of a day, NULL
    values, and rows without a date. The melted wide table has a row for each day
    by itself; a panel summed from transactions has not.
    """

    date_col: str
    value_col: str
    group_cols: Sequence[str]
    fill: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        groups = list(self.group_cols)
        first, last, day, made, row = fresh(df, "first", "last", "day", "made", "row")
        dated = quoted(self.date_col).cast("date")
        # One aggregate holds the series and, over all of them, the span.
        series = df.groupBy(*map(quoted, groups)).agg(F.min(dated).alias(first), F.max(dated).alias(last))
        begin, end = series.agg(F.min(first)).scalar(), series.agg(F.max(last)).scalar()
        keys = dict(zip(groups, fresh(df, *[f"key{i}" for i in range(len(groups))])))
        cells = series.select(
            *[quoted(g).alias(k) for g, k in keys.items()],
            F.explode(F.sequence(begin, end)).alias(day),
            F.lit(True).alias(made),
        )
        meet = dated == F.col(day)
        for group, key in keys.items():
            meet = meet & quoted(group).eqNullSafe(F.col(key))
        # Rows without a date meet no cell and stay; cells without a row become one.
        gap = F.col(row).isNull()
        both = df.withColumn(row, F.lit(True)).join(cells, meet, "full")
        folded = {g.lower(): k for g, k in keys.items()}
        out = []
        for field in df.schema.fields:
            kept, name = quoted(field.name), field.name.lower()
            if name in folded:
                kept = F.when(gap, F.col(folded[name])).otherwise(kept)
            elif name == self.date_col.lower():
                kept = F.when(gap, F.col(day).cast(field.dataType)).otherwise(kept)
            elif name == self.value_col.lower():
                kept = F.when(gap, F.lit(self.fill).cast(field.dataType)).otherwise(kept)
            out.append(kept.alias(field.name))
        return both.select(*out)

