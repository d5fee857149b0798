"""From hyperparameters, as a config file names them, to a forecaster."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from tidecast.models.base import Forecaster
from tidecast.models.ml import boosted_trees, tweedie_linear
from tidecast.models.simple import LeastSquares, Passthrough
from tidecast.models.tweedie import TweedieBoostedTrees


def forecaster(hyperparameters: Mapping[str, Any]) -> Forecaster:
    """The forecaster for an ``objective`` and its options.

    Objectives: ``tweedie`` and ``regression`` (trees), ``regression_l1``
    (trees), ``tweedie_linear``, ``least_squares``, ``passthrough``. Options of
    the trees: ``n_estimators``, ``learning_rate``, ``max_depth``, ``max_bin``,
    ``min_child_samples``, ``tweedie_variance_power``, ``random_state``.
    """
    given = dict(hyperparameters)
    objective = given.pop("objective", "regression")
    names = {"n_estimators": "rounds", "learning_rate": "rate", "max_depth": "depth", "random_state": "seed"}
    if objective == "tweedie":
        names |= {"max_bin": "bins", "min_child_samples": "min_rows", "tweedie_variance_power": "power"}
        make = TweedieBoostedTrees
    elif objective in ("regression", "regression_l1"):
        names["learning_rate"] = "step"
        loss = "absolute" if objective.endswith("l1") else "squared"
        make = lambda **options: boosted_trees(loss=loss, **options)
    elif objective == "tweedie_linear":
        names = {"n_estimators": "rounds", "tweedie_variance_power": "power", "reg_lambda": "regularisation"}
        make = tweedie_linear
    elif objective in ("least_squares", "passthrough"):
        names, make = {}, {"least_squares": LeastSquares, "passthrough": Passthrough}[objective]
    else:
        raise ValueError(f"unknown objective {objective!r}")
    unknown = sorted(set(given) - set(names))
    if unknown:
        raise ValueError(f"objective {objective!r} takes no {', '.join(unknown)}; it takes {', '.join(names) or 'none'}")
    return make(**{names[k]: v for k, v in given.items()})
