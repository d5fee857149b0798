from tidecast.plans.backtest import (
    cross_val_forecast,
    cross_validate,
    final_fit,
    multi_horizon_forecast,
    score_future,
)
from tidecast.plans.dashboard import filter_panel, forecast_panel, series_by_date
from tidecast.plans.features import FeatureBuild, calendar_pipeline, feature_pipeline
from tidecast.plans.scoring import evaluate, mean_of_folds, rmse_by_column, summarize_cv

__all__ = [
    "FeatureBuild",
    "calendar_pipeline",
    "cross_val_forecast",
    "cross_validate",
    "evaluate",
    "feature_pipeline",
    "filter_panel",
    "final_fit",
    "forecast_panel",
    "mean_of_folds",
    "multi_horizon_forecast",
    "rmse_by_column",
    "score_future",
    "series_by_date",
    "summarize_cv",
]
