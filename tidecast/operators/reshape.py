"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.base import Operator, quoted, text_literal, ticked


@dataclass(frozen=True, kw_only=True)
class MeltDataFrame(Operator):
    """Turn value columns into rows, keeping NULL cells.

    Without ``value_vars`` every column outside ``id_vars`` is melted. Values
    take their common type. The cells go through one array per row, which stays
    fast for thousands of value columns, where one projection per column (as in
    ``DataFrame.unpivot``) does not.
    """

    id_vars: Sequence[str]
    var_name: str
    value_name: str
    value_vars: Sequence[str] | None = None
    row_local = True

    def transform(self, df: DataFrame) -> DataFrame:
        values = self.value_vars
        if values is None:
            ids = {c.lower() for c in self.id_vars}
            values = [c for c in df.columns if c.lower() not in ids]
        # SQL text, since thousands of Column objects take long to build from Python.
        names = F.expr(f"array({', '.join(map(text_literal, values))})")
        cells = F.expr(f"array({', '.join(map(ticked, values))})")
        return df.select(
            *[quoted(c).alias(c) for c in self.id_vars],
            F.inline(F.arrays_zip(names.alias("name"), cells.alias("value"))).alias(self.var_name, self.value_name),
        )


@dataclass(frozen=True, kw_only=True)
class PivotForecasts(Operator):
    """One column per fold, ``cv_0`` and so on, from rows of (keys, fold, forecast).

    Several forecasts of one cell are averaged. Rows with a NULL key are left
    out. ``folds`` names the folds that get a column, which saves a pass over the
    rows; forecasts of other folds are then left out. Without it, all folds found
    get one, in order.
    """

    index: Sequence[str]
    folds: Sequence[Any] | None = None
    fold_col: str = "cv"
    value_col: str = "forecast"
    prefix: str = "cv_"

    def transform(self, df: DataFrame) -> DataFrame:
        folds = self.folds
        if folds is None:  # one row for each fold
            folds = sorted(r[0] for r in df.select(quoted(self.fold_col)).dropna().distinct().collect())
        cells = [
            F.avg(F.when(quoted(self.fold_col) == F.lit(f), quoted(self.value_col))).alias(f"{self.prefix}{f}")
            for f in folds
        ]
        found = df.dropna(subset=[*self.index, self.value_col]).where(quoted(self.fold_col).isin(list(folds)))
        return found.groupBy(*self.index).agg(*cells)
