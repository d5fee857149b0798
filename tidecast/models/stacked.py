"""Several forecasters side by side on one target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tidecast.models.base import Forecaster


@dataclass(frozen=True)
class StackedForecaster:
    """Fits each forecaster on its own features; predictions stay side by side, unmixed.

    The result adds the columns ``pred_1`` to ``pred_k``.
    """

    estimators: Sequence[Forecaster]
    prefix: str = "pred_"

    def fit(self, df: DataFrame, *, feature_sets: Sequence[Sequence[str]], target_col: str) -> PipelineModel:
        if len(feature_sets) != len(self.estimators):
            raise ValueError(f"{len(self.estimators)} estimators but {len(feature_sets)} feature sets")
        models = [
            estimator.fit(df, feature_cols=features, target_col=target_col, output_col=f"{self.prefix}{i}")
            for i, (estimator, features) in enumerate(zip(self.estimators, feature_sets), start=1)
        ]
        return PipelineModel(models)
