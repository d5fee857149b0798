"""Select, cast, parse, join and filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.base import Operator, paired, quoted, type_of
from tidecast.storage import broadcast_within, shared_folder

ALL = "All"


@dataclass(frozen=True)
class ColumnSelect(Operator):
    """Keep the named columns, in this order and spelling (lookup ignores case)."""

    cols: Sequence[str]
    row_local = True

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.cols)


@dataclass(frozen=True, kw_only=True)
class ColumnType(Operator):
    """Cast columns to one type.

    A value that cannot be cast gives NULL, or an error if ``strict``.
    """

    input_cols: Sequence[str]
    value: str
    output_cols: Sequence[str] | None = None
    strict: bool = False
    row_local = True

    def __post_init__(self) -> None:
        paired(self.input_cols, self.output_cols)

    def transform(self, df: DataFrame) -> DataFrame:
        def converted(name: str):
            col = quoted(name)
            return col.cast(self.value) if self.strict else col.try_cast(self.value)

        return df.withColumns({o: converted(i) for i, o in paired(self.input_cols, self.output_cols)})


@dataclass(frozen=True, kw_only=True)
class ConvertToDate(Operator):
    """Parse strings as dates by a pattern.

    A string that does not match gives NULL, or an error if ``strict``.
    """

    input_cols: Sequence[str]
    date_format: str
    output_cols: Sequence[str] | None = None
    strict: bool = False
    row_local = True

    def __post_init__(self) -> None:
        paired(self.input_cols, self.output_cols)

    def transform(self, df: DataFrame) -> DataFrame:
        parse = F.to_date if self.strict else F.try_to_date
        return df.withColumns(
            {o: parse(quoted(i), self.date_format) for i, o in paired(self.input_cols, self.output_cols)}
        )


@dataclass(frozen=True, kw_only=True)
class JoinDataFrame(Operator):
    """Join with another table on columns of the same name; any Spark join type.

    With ``broadcast_rows`` the other table is counted up to that number and
    broadcast only if it is no larger. Without it Spark decides by its own size
    estimate.
    """

    df: DataFrame
    on: str | Sequence[str]
    how: str
    broadcast_rows: int | None = None

    @property
    def row_local(self) -> bool:  # type: ignore[override]
        return self.how in ("inner", "left", "left_outer", "leftouter", "left_semi", "left_anti")

    def transform(self, df: DataFrame) -> DataFrame:
        other = self.df
        if self.broadcast_rows is not None:
            other = broadcast_within(other, self.broadcast_rows)
        on = self.on if isinstance(self.on, str) else list(self.on)
        return df.join(other, on=on, how=self.how)


@dataclass(frozen=True)
class MemberFilter(Operator):
    """Keep rows whose column holds one of the values.

    ``"All"`` among the values keeps every row; ``None`` among them also keeps
    rows where the column is NULL.
    """

    column: str
    values: Sequence[Any]
    row_local = True

    def transform(self, df: DataFrame) -> DataFrame:
        if ALL in self.values:
            return df
        present = [v for v in self.values if v is not None]
        test = quoted(self.column).isin(present)
        if len(present) < len(self.values):
            test = test | quoted(self.column).isNull()
        return df.where(test)


def members(df: DataFrame, column: str) -> DataFrame:
    """The distinct values a :class:`MemberFilter` on this column can name."""
    return df.select(column).distinct()


@dataclass(frozen=True)
class DateCutoff(Operator):
    """Keep rows strictly before a date (``yyyy-MM-dd``)."""

    date_col: str
    before: str
    row_local = True

    def transform(self, df: DataFrame) -> DataFrame:
        kind = type_of(df, self.date_col).simpleString()
        return df.where(quoted(self.date_col) < F.lit(self.before).cast("date" if kind == "string" else kind))


@dataclass(frozen=True)
class Checkpointer(Operator):
    """Cut the lineage at this point with a checkpoint in the shared folder.

    The rows are written to reliable storage, so they outlive the executors
    that made them.
    """

    eager: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        shared_folder(df.sparkSession)
        return df.checkpoint(self.eager)
