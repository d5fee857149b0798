"""Forecasters around Spark ML regressors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from tidecast.models.base import TEMP, Forecaster, added, dropped, fitted, labelled, prepare
from tidecast.storage import shared_folder


@dataclass(frozen=True)
class RegressorForecaster(Forecaster):
    """Any Spark ML regressor behind gap filling and a vector of the features.

    ``make`` builds the regressor; it is called at each fit, so that none is
    shared between fits that run side by side.
    """

    make: Callable[[], Any]

    def fit(
        self, df: DataFrame, *, feature_cols: Sequence[str], target_col: str, output_col: str = "forecast"
    ) -> PipelineModel:
        shared_folder(df.sparkSession)
        rows = labelled(df, feature_cols, target_col)
        prep = prepare(rows, feature_cols)
        raw = TEMP + "prediction"
        regressor = self.make()
        regressor = regressor.copy(
            {
                regressor.featuresCol: prep.vector,
                regressor.labelCol: TEMP + "label",
                regressor.predictionCol: raw,
            }
        )
        # The fit passes over its rows many times, and not every regressor keeps them itself.
        vectors = fitted(prep.stages).transform(rows).select(prep.vector, TEMP + "label")
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = regressor.fit(vectors)
        finally:
            vectors.unpersist()
        return fitted([*prep.stages, model, added(raw, output_col), dropped([*prep.temporary, raw])])


def boosted_trees(
    *, rounds: int = 100, step: float = 0.1, depth: int = 5, loss: str = "squared", seed: int = 0
) -> RegressorForecaster:
    """Gradient-boosted trees with squared or absolute loss."""
    return RegressorForecaster(
        lambda: GBTRegressor(
            maxIter=rounds, stepSize=step, maxDepth=depth, lossType=loss, minInstancesPerNode=20, maxBins=64, seed=seed
        )
    )


def tweedie_linear(*, power: float = 1.5, regularisation: float = 1e-3, rounds: int = 25) -> RegressorForecaster:
    """A generalised linear model with Tweedie loss and log link; the target must not be negative."""
    return RegressorForecaster(
        lambda: GeneralizedLinearRegression(
            family="tweedie", variancePower=power, linkPower=0.0, regParam=regularisation, maxIter=rounds
        )
    )
