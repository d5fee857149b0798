import datetime as dt

import pytest

from plain_rows import rows
from tidecast.functions import Frequency, shift
from tidecast.operators import TimeBasedSplit

D = dt.date


@pytest.fixture(scope="module")
def days(spark):
    return spark.sql("SELECT explode(sequence(date'2011-01-29', date'2016-04-30')) AS date").cache()


def split(**options):
    return TimeBasedSplit(**{"date_frequency": "days", "date_col": "date", **options})


def test_recorded_folds(days):
    """The dates of the two recorded folds: last day 2016-04-30, 28 days of test."""
    for horizon in (range(1, 8), range(8, 15), range(15, 22), range(22, 29)):
        cv = split(n_splits=2, forecast_horizon=list(horizon), end_offset=28 - max(horizon), step_length=28)
        folds = cv.folds(days)
        assert [(f.first_train, f.last_train, f.train_end) for f in folds] == [
            ("2011-01-29", "2016-04-02", "2016-04-02"),
            ("2011-01-29", "2016-03-05", "2016-03-05"),
        ]
        assert folds[0].test_dates[0] == str(D(2016, 4, 2) + dt.timedelta(min(horizon)))
        assert folds[1].test_dates[-1] == str(D(2016, 3, 5) + dt.timedelta(max(horizon)))
        assert [f.n_test for f in folds] == [7, 7]


def test_tagged_rows_match_the_fold_filters(days):
    cv = split(n_splits=3, forecast_horizon=[1, 3], max_train_size=10, step_length=5)
    tagged = cv.split(days)
    assert tagged.columns == ["date", "fold", "role"]
    for fold in cv.folds(days):
        mine = tagged.where(f"fold = {fold.number}")
        assert rows(mine.where("role = 'train'"), "date") == rows(fold.train(days))
        assert rows(mine.where("role = 'test'"), "date") == rows(fold.test(days))
        assert (fold.n_train, fold.n_test) == (10, 2)


def test_tagging_shuffles_nothing(days):
    cv = split(n_splits=3, forecast_horizon=[1, 3])
    plan = cv.tag(days, cv.folds(days))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_train_and_test_apart_and_in_order(days):
    for fold in split(n_splits=4, forecast_horizon=[2, 7]).folds(days):
        last = fold.train(days).agg({"date": "max"}).first()[0]
        first = fold.test(days).agg({"date": "min"}).first()[0]
        assert last < first


def test_months_clip_at_the_month_end(spark):
    df = spark.sql("SELECT explode(sequence(date'2015-01-01', date'2016-03-31')) AS date")
    fold = split(date_frequency="months", n_splits=1, forecast_horizon=[1]).folds(df)[0]
    assert fold.train_end == "2016-02-29" and fold.test_dates == ("2016-03-29",)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_hours_on_time_stamps(spark, kind):
    df = spark.sql(
        f"SELECT explode(sequence(timestamp_ntz'2024-01-01 00:30:00', timestamp_ntz'2024-01-02 00:30:00', interval 1 hour)) AS t"
    ).selectExpr(f"cast(t AS {kind}) AS date")
    folds = split(date_frequency="hours", n_splits=2, forecast_horizon=[1, 2], max_train_size=3).folds(df)
    assert [(f.n_train, f.n_test) for f in folds] == [(3, 2), (3, 2)]
    assert folds[0].last_train.startswith("2024-01-01 22:30:00")


def test_part_of_a_day_on_dates(days):
    fold = split(date_frequency="hours", n_splits=1, forecast_horizon=[24]).folds(days)[0]
    assert (fold.last_train, fold.n_test) == ("2016-04-29", 1)


@pytest.mark.parametrize("unit,n,then", [
    ("years", -1, (2015, 2, 28)), ("months", 12, (2017, 2, 28)), ("weeks", 1, (2016, 3, 7)), ("day", -29, (2016, 1, 31)), ("hours", 48, (2016, 3, 2)),
])
def test_shift(unit, n, then):
    assert shift(dt.datetime(2016, 2, 29), n, Frequency.parse(unit)) == dt.datetime(*then)


@pytest.mark.parametrize("wrong", [
    {"forecast_horizon": [0]}, {"forecast_horizon": []}, {"forecast_horizon": [-1]}, {"step_length": 0}, {"step_length": -1},
    {"n_splits": 0}, {"end_offset": -1}, {"max_train_size": -1}, {"date_frequency": "quarters"},
])
def test_settings(wrong):
    with pytest.raises(ValueError):
        split(**wrong)


def test_tables_that_cannot_be_split(spark, days):
    with pytest.raises(ValueError, match="too many splits"):
        split(n_splits=100, forecast_horizon=[28]).folds(days)
    gap = days.where("date < date'2015-01-01' OR date > date'2016-04-01'")
    with pytest.raises(ValueError, match="too many splits"):
        split(n_splits=3, forecast_horizon=[28], max_train_size=30).folds(gap)
    with pytest.raises(ValueError, match="no column"):
        split(date_col="day").folds(days)
    with pytest.raises(ValueError, match="must be a date"):
        split().folds(days.selectExpr("cast(date AS string) AS date"))
    with pytest.raises(ValueError, match="holds no date"):
        split().folds(days.where("false"))
