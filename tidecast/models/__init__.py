from tidecast.models.base import Forecaster, TrainingRange
from tidecast.models.choose import forecaster
from tidecast.models.ml import RegressorForecaster, boosted_trees, tweedie_linear
from tidecast.models.simple import LeastSquares, Passthrough
from tidecast.models.stacked import StackedForecaster
from tidecast.models.tweedie import TweedieBoostedTrees

__all__ = [
    "Forecaster",
    "LeastSquares",
    "Passthrough",
    "RegressorForecaster",
    "StackedForecaster",
    "TrainingRange",
    "TweedieBoostedTrees",
    "boosted_trees",
    "forecaster",
    "tweedie_linear",
]
