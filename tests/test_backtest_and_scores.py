import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel

from plain_rows import rows
from tidecast.models import (
    LeastSquares,
    Passthrough,
    StackedForecaster,
    TweedieBoostedTrees,
    boosted_trees,
    forecaster,
    tweedie_linear,
)
from tidecast.operators import TimeBasedSplit
from tidecast.plans import (
    cross_val_forecast,
    cross_validate,
    evaluate,
    final_fit,
    mean_of_folds,
    multi_horizon_forecast,
    rmse_by_column,
    score_future,
    series_by_date,
    summarize_cv,
)
from tidecast.sources import BacktestConfig, RunLog


@pytest.fixture(scope="module")
def panel(spark):
    """Two series of 120 days; the target is 2x + 1, one feature has gaps and one is empty."""
    return spark.sql("""
        SELECT s AS id, date, 2 * x + 1 AS sales, x AS x_lag_28_mean,
               CASE WHEN n % 5 > 0 THEN double(n % 5) END AS gappy_lag_28_std, CAST(NULL AS DOUBLE) AS empty_lag_28_mean
        FROM (SELECT s, date_add(date'2020-01-01', n) AS date, n, double((n * 7 + ascii(s)) % 13) AS x
              FROM VALUES ('a'), ('b') t(s) LATERAL VIEW explode(sequence(0, 119)) AS n)""").cache()


CONFIG = {
    "data": {"id_col": "id", "target_col": "sales", "date_col": "date", "date_frequency": "days"},
    "hyperparameters": {"objective": "least_squares"},
    "cv": {"splits": 2, "test_size": 28},
    "models": {
        "near": {"forecast_horizon": list(range(1, 15)), "feature_cols": ["x_lag_28_mean"]},
        "far": {"forecast_horizon": list(range(15, 29)), "feature_cols": ["x_lag_28_mean"]},
    },
}
FEATURES = ["x_lag_28_mean", "gappy_lag_28_std", "empty_lag_28_mean"]
SPLIT = TimeBasedSplit(date_frequency="days", date_col="date", forecast_horizon=list(range(1, 29)), n_splits=2)


def run(model, panel, features=FEATURES):
    return cross_val_forecast(
        model=model, cv=SPLIT, df=panel, date_col="date", feature_cols=features, target_col="sales", id_cols=["id"]
    )


def test_passthrough_and_result_columns(panel):
    got = run(Passthrough(), panel, FEATURES[:1])
    assert got.columns == ["id", "date", "sales", "forecast", "cv", "train_start", "train_end"]
    assert got.count() == 2 * 2 * 28
    assert got.where("forecast <> (sales - 1) / 2").count() == 0
    assert rows(got.select("cv", "train_start", "train_end").distinct()) == [
        (0, dt.date(2020, 1, 1), dt.date(2020, 4, 1)),
        (1, dt.date(2020, 1, 1), dt.date(2020, 3, 4)),
    ]


def test_least_squares_finds_the_line(panel):
    assert all(abs(r["sales"] - r["forecast"]) < 1e-9 for r in run(LeastSquares(), panel, FEATURES[:1]).collect())
    assert all(abs(r["sales"] - r["forecast"]) < 1e-5 for r in run(LeastSquares(), panel).collect())


def test_least_squares_over_two_features(spark):
    df = spark.range(1, 40).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id * id AS DOUBLE) AS b", "CAST(3 * id * id - id + 2 AS DOUBLE) AS y")
    got = LeastSquares().fit(df, feature_cols=["a", "b"], target_col="y").transform(df)
    assert all(abs(r["y"] - r["forecast"]) < 1e-5 for r in got.collect())
    with pytest.raises(ValueError, match="one feature"):
        Passthrough().fit(df, feature_cols=["a", "b"], target_col="y")


@pytest.mark.parametrize("model,limit", [
    (boosted_trees(rounds=10, step=0.5), 3.0),
    (tweedie_linear(), 6.0),
    (TweedieBoostedTrees(rounds=8, rate=0.5, checkpoint_every=3), 3.0),
])
def test_fitted_models_beat_the_mean_despite_gaps(panel, model, limit):
    scores = summarize_cv(run(model, panel)).collect()
    assert len(scores) == 2 and all(r["n_scored"] == 56 and r["rmse"] < limit for r in scores)


def test_tweedie_rejects_negative_targets(panel):
    with pytest.raises(ValueError, match="non-negative"):
        TweedieBoostedTrees(rounds=1).fit(panel.selectExpr("sales - 9 AS sales", "x_lag_28_mean"), feature_cols=FEATURES[:1], target_col="sales")


def test_rows_without_target_do_not_train(panel):
    holes = panel.selectExpr("id", "date", "CASE WHEN day(date) > 3 THEN sales END AS sales", "x_lag_28_mean")
    assert all(abs(2 * (r["sales"] - 1) / 2 + 1 - r["forecast"]) < 1e-9 for r in run(LeastSquares(), holes, FEATURES[:1]).dropna().collect())


def test_blocks_cover_the_horizon_once(panel):
    got = multi_horizon_forecast(panel, BacktestConfig.from_dict(CONFIG))
    assert got.count() == got.select("id", "date", "cv").distinct().count() == 2 * 2 * 28


def test_a_leaking_feature_is_refused(panel):
    leaky = {**CONFIG, "models": {"far": {"forecast_horizon": [29], "feature_cols": ["x_lag_28_mean"]}}}
    with pytest.raises(ValueError, match="closer"):
        multi_horizon_forecast(panel, BacktestConfig.from_dict(leaky))


def test_config_file(path):
    import yaml

    with open(path + "/c.yml", "w") as file:
        yaml.safe_dump(CONFIG, file)
    assert BacktestConfig.from_yaml(path + "/c.yml") == BacktestConfig.from_dict(CONFIG)


def test_final_fit_and_future(spark, panel):
    config = BacktestConfig.from_dict(CONFIG)
    models = final_fit(panel, config)
    future = spark.sql("""SELECT id, date_add(date'2020-04-29', n) AS date, CAST(NULL AS DOUBLE) AS sales, double(n) AS x_lag_28_mean
                          FROM VALUES ('a'), ('b') t(id) LATERAL VIEW explode(sequence(-2, 40)) AS n""")
    got = score_future(future, models, config, "2020-04-29").collect()
    assert len(got) == 2 * 28
    assert all(math.isclose(r["forecast"], 2 * (r["date"] - dt.date(2020, 4, 29)).days + 1) for r in got)
    assert {r["model"] for r in got if r["date"] <= dt.date(2020, 5, 13)} == {"near"}


def test_stacked_predictions_stay_apart(panel, path):
    stack = StackedForecaster([Passthrough(), LeastSquares()])
    model = stack.fit(panel, feature_sets=[["x_lag_28_mean"], ["x_lag_28_mean"]], target_col="sales")
    model.write().save(path + "/m")
    got = PipelineModel.load(path + "/m").transform(panel).first()
    assert math.isclose(2 * got["pred_1"] + 1, got["pred_2"]) and math.isclose(got["pred_2"], got["sales"])
    with pytest.raises(ValueError):
        stack.fit(panel, feature_sets=[["x_lag_28_mean"]], target_col="sales")


def test_hyperparameters():
    assert forecaster({"objective": "tweedie", "n_estimators": 7, "learning_rate": 0.2}) == TweedieBoostedTrees(rounds=7, rate=0.2)
    assert forecaster({"objective": "passthrough"}) == Passthrough()
    for wrong in ({"objective": "poisson"}, {"objective": "tweedie", "leaves": 3}):
        with pytest.raises(ValueError):
            forecaster(wrong)


def test_run_log_scores_each_run_once(spark, panel, path):
    log, config = RunLog(spark, path + "/log"), BacktestConfig.from_dict(CONFIG)
    assert log.runs().count() == 0 and log.unscored().count() == 0 and evaluate(log).count() == 0
    with pytest.raises(ValueError):
        log.finish("a/b")
    first = cross_validate(panel, config, log, run_id="001")
    assert rows(log.params(), "run_id", "key", "value") == [("001", "objective", "least_squares")]
    assert [r["run_id"] for r in log.unscored().collect()] == [first]
    evaluate(log)
    assert log.unscored().count() == 0
    second = cross_validate(panel, config, log, Passthrough())
    assert [r["run_id"] for r in log.unscored().collect()] == [second]
    scores = {r["run_id"]: r["value"] for r in evaluate(log).collect()}
    assert scores["001"] < 1e-6 < scores[second]
    assert log.fold_metrics().groupBy("run_id").count().where("count = 2").count() == 2
    assert evaluate(log).count() == 2
    assert "forecast" in log.model("001", "near").transform(panel).columns
    assert log.forecast("001").count() == log.forecasts().where("run_id = '001'").count() == 112


@pytest.fixture
def forecasts(spark):
    d = dt.date
    data = [(0, d(2020, 1, 2), 1.0, 2.0), (0, d(2020, 1, 1), 3.0, 3.0), (1, d(2020, 1, 1), 1.0, 4.0), (1, d(2020, 1, 3), None, 4.0), (None, d(2020, 1, 1), 1.0, 99.0)]
    df = spark.createDataFrame(data, "cv int, date date, sales double, forecast double")
    return df.selectExpr("*", "date'2019-01-01' AS train_start", "date'2019-12-31' AS train_end")


def test_fold_summary(forecasts):
    got = summarize_cv(forecasts)
    assert rows(got, "cv", "rmse", "n_rows", "n_scored") == [(0, math.sqrt(0.5), 2, 2), (1, 3.0, 2, 1)]
    assert rows(got, "forecast_start", "forecast_end")[0] == (dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    assert math.isclose(mean_of_folds(got).first()[0], (math.sqrt(0.5) + 3) / 2)
    with pytest.raises(PySparkException, match="rows without"):
        summarize_cv(forecasts, strict=True).collect()
    assert summarize_cv(forecasts.dropna(), strict=True).count() == 2


def test_rmse_by_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, 2.0), (None, 5.0, 5.0)], "sales double, cv_0 double, cv_1 double")
    assert rows(rmse_by_column(df)) == [("cv_0", 1.0), ("cv_1", 0.0), ("mean", 0.5)]
    none = df.selectExpr("sales", "cv_0", "CAST(NULL AS DOUBLE) AS cv_1")
    assert rows(rmse_by_column(none)) == [("cv_0", 1.0), ("cv_1", None), ("mean", 1.0)]


def test_sums_by_date_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None), ("a", 2, None), (None, None, 7.0)], "id string, date int, v double")
    assert rows(series_by_date(df)) == [(1, 1.0), (2, None)]


def blocks_of(unit, lag, horizon, lag_unit=None):
    return BacktestConfig.from_dict(
        {
            "data": {"id_col": "id", "target_col": "sales", "date_col": "date", "date_frequency": unit, "lag_frequency": lag_unit},
            "hyperparameters": {"objective": "least_squares"},
            "cv": {"splits": 1, "test_size": 4},
            "models": {"m": {"forecast_horizon": list(horizon), "feature_cols": [f"x_lag_{lag}_mean"]}},
        }
    )


@pytest.mark.parametrize("config,leaks", [
    (blocks_of("weeks", 7, range(1, 5), "days"), True),
    (blocks_of("weeks", 28, range(1, 5), "days"), False),
    (blocks_of("weeks", 4, range(1, 5)), False),
    (blocks_of("months", 28, [1], "days"), True),
    (blocks_of("months", 31, [1], "days"), False),
    (blocks_of("days", 1, range(1, 8), "weeks"), False),
])
def test_leaks_across_units(spark, config, leaks):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d), float(d)) for d in (1, 2, 3)], f"id string, date date, sales double, {config.models['m'].feature_cols[0]} double")
    if leaks:
        with pytest.raises(ValueError, match="see closer"):
            final_fit(df, config)
    else:
        assert list(final_fit(df, config)) == ["m"]


def test_future_weeks_are_scored(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2020, 1, 6) + dt.timedelta(7 * i), float(i) if i < 10 else None, float(i)) for i in range(14)],
        "id string, date date, sales double, x_lag_4_mean double",
    )
    config = blocks_of("weeks", 4, range(1, 5))
    got = score_future(df, final_fit(df, config), config, "2020-03-09").collect()
    assert [round(r["forecast"], 6) for r in sorted(got, key=lambda r: r["date"])] == [10.0, 11.0, 12.0, 13.0]


def test_run_log_tells_what_was_done(spark, path):
    df = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1) + dt.timedelta(i), float(i), float(i)) for i in range(60)], "id string, date date, sales double, x_lag_4_mean double"
    )
    config, log = blocks_of("days", 4, range(1, 5)), RunLog(spark, path)
    cross_validate(df, config, log, model=LeastSquares(), run_id="r")
    run = log.runs().collect()[0]
    assert run["started"] < run["ended"]
    assert {r["key"]: r["value"] for r in log.params().collect()} == {"model": "LeastSquares"}
    assert [tuple(r) for r in log.signatures().select("model", "position", "feature", "type").collect()] == [("m", 0, "x_lag_4_mean", "double")]
    log.check_signature("r", "m", df)
    with pytest.raises(ValueError, match="x_lag_4_mean double"):
        log.check_signature("r", "m", df.withColumn("x_lag_4_mean", df["x_lag_4_mean"].cast("string")))
    assert spark.read.option("header", True).csv(log.artifact("r", "cv/forecast")).count() == 4
    evaluate(log)
    assert log.fold_metric("r").count() == 1


def test_all_linear_fits_come_from_one_aggregate(spark, panel, monkeypatch):
    """Folds with a lower bound, sets of features that overlap, gaps: each equals a fit to its own rows."""
    import numpy as np

    from tidecast.models import TrainingRange, gram

    table = panel.selectExpr("*", "CASE WHEN sales > 20 THEN sin(sales * 3) * 1e4 + 1e6 END AS wave", "sales + cos(day(date)) AS noisy").cache()
    ranges = [
        TrainingRange(("x_lag_28_mean",), "date", "date", None, "2020-03-01"),
        TrainingRange(("wave",), "date", "date", "2020-02-01", "2020-03-10"),
        TrainingRange(("x_lag_28_mean", "wave", "gappy_lag_28_std"), "date", "date", None, "2020-03-10"),
        TrainingRange(("gappy_lag_28_std", "x_lag_28_mean", "empty_lag_28_mean"), "date", "date", "2020-02-01", None),
        TrainingRange(("wave", "gappy_lag_28_std"), "date", "date"),
    ]
    aggregates = []
    real = gram.Moments
    monkeypatch.setattr(gram, "Moments", lambda *a: aggregates.append(1) or real(*a))
    models = LeastSquares().fit_ranges(table, ranges, target_col="noisy")
    assert len(aggregates) == 1
    local = table.orderBy("id", "date").toPandas()
    for r, model in zip(ranges, models):
        inside = np.ones(len(local), bool)
        days = local["date"].astype(str)
        if r.until:
            inside &= (days <= r.until).to_numpy()
        if r.after:
            inside &= (days > r.after).to_numpy()
        x = local[list(r.feature_cols)].to_numpy(float)
        if len(r.feature_cols) == 1:
            inside &= ~np.isnan(x[:, 0])
            design = np.column_stack([np.ones(len(x)), x])
        else:
            parts = [np.ones(len(x))]
            for c in x.T:
                if np.isnan(c[inside]).all():
                    continue
                parts.append(np.where(np.isnan(c), np.nanmean(c[inside]), c) - np.nanmean(c[inside]))
                if np.isnan(c[inside]).any():
                    parts.append(np.isnan(c).astype(float))
            design = np.column_stack(parts)
        want = design @ np.linalg.lstsq(design[inside], local["noisy"].to_numpy()[inside], rcond=1e-10)[0]
        got = np.array([np.nan if v["forecast"] is None else v["forecast"] for v in model.transform(table).orderBy("id", "date").collect()])
        assert np.allclose(got, want, rtol=1e-8, atol=1e-8, equal_nan=True)


def test_a_feature_of_one_value_has_no_line(panel):
    with pytest.raises(ValueError, match="fewer than two values"):
        LeastSquares().fit(panel.selectExpr("sales", "7.3D AS flat"), feature_cols=["flat"], target_col="sales")
