"""Forecasters with a closed form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tidecast.models.base import Forecaster, TrainingRange, added, fitted
from tidecast.models.gram import least_squares
from tidecast.operators.base import ticked


@dataclass(frozen=True)
class Passthrough(Forecaster):
    """The forecast is the one feature column, such as a lagged mean."""

    def fit(
        self, df: DataFrame, *, feature_cols: Sequence[str], target_col: str, output_col: str = "forecast"
    ) -> PipelineModel:
        if len(feature_cols) != 1:
            raise ValueError(f"the forecast is one feature column, not {list(feature_cols)}")
        return fitted([added(ticked(feature_cols[0]), output_col)])


@dataclass(frozen=True)
class LeastSquares(Forecaster):
    """Ordinary least squares over all feature columns.

    Over one feature, rows without it are not fitted and get no forecast. Over more, gaps are filled with the training mean
    and marked by a 0/1 column. Any number of fits over ranges of dates follow from one aggregate of products by
    segment of dates; the equations of each are solved on the driver.
    """

    def fit(
        self, df: DataFrame, *, feature_cols: Sequence[str], target_col: str, output_col: str = "forecast"
    ) -> PipelineModel:
        return self.fit_ranges(df, [TrainingRange(tuple(feature_cols))], target_col=target_col, output_col=output_col)[0]

    def fit_ranges(
        self, df: DataFrame, ranges: Sequence[TrainingRange], *, target_col: str, output_col: str = "forecast"
    ) -> list[PipelineModel]:
        return [fitted([added(e, output_col)]) for e in least_squares(df, ranges, target_col)]
