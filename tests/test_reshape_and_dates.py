import datetime as dt

import pytest

from plain_rows import rows
from tidecast.operators import CreateFutureSet, DateFeatures, Densify, MeltDataFrame, PivotForecasts

D = dt.date


def test_melt_keeps_nulls_widens_types_and_takes_odd_names(spark):
    df = spark.createDataFrame([("k", 1, 2.5, None)], "id string, `a b` int, `c.d` double, `it's` double")
    got = MeltDataFrame(id_vars=["id"], value_vars=["a b", "c.d", "it's"], var_name="name", value_name="v")(df)
    assert rows(got) == [("k", "a b", 1.0), ("k", "c.d", 2.5), ("k", "it's", None)]


def test_melt_of_all_other_columns(spark):
    df = spark.createDataFrame([("k", 1, 2)], "id string, x int, y int")
    assert rows(MeltDataFrame(id_vars=["ID"], var_name="n", value_name="v")(df), "n", "v") == [("x", 1), ("y", 2)]


def test_melt_then_pivot_is_the_identity(spark):
    df = spark.createDataFrame([("k", 1, 2), ("m", 3, None)], "id string, x int, y int")
    long = MeltDataFrame(id_vars=["id"], var_name="n", value_name="v")(df)
    assert rows(long.groupBy("id").pivot("n", ["x", "y"]).agg({"v": "max"})) == rows(df)


def test_pivot_averages_duplicates_and_drops_null_keys(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 0, 1.0), ("a", D(2020, 1, 1), 0, 3.0), ("a", None, 1, 9.0), ("b", D(2020, 1, 1), 1, None)],
        "id string, date date, cv int, forecast double",
    )
    got = PivotForecasts(index=["id", "date"], folds=[0, 1])(df)
    assert rows(got) == [("a", D(2020, 1, 1), 2.0, None)]


def test_date_parts(spark):
    df = spark.createDataFrame([(D(2016, 1, 1),), (D(2016, 2, 29),), (D(2021, 8, 1),)], "d date")
    names = ["day_of_week", "day_of_year", "day_of_month", "week_of_year", "week_of_month", "month", "quarter", "year"]
    got = rows(DateFeatures(input_col="d", features=names)(df), *names)
    assert got == [(1, 213, 1, 30, 1, 8, 3, 2021), (2, 60, 29, 9, 5, 2, 1, 2016), (6, 1, 1, 53, 1, 1, 1, 2016)]


def test_week_of_month_by_counting_sundays(spark):
    df = spark.sql("SELECT explode(sequence(date'2015-01-01', date'2018-12-31')) AS d")
    for day, got in rows(DateFeatures(input_col="d", features=["week_of_month"], output_cols=["w"])(df)):
        sundays = sum(D(day.year, day.month, i).isoweekday() == 7 for i in range(2, day.day + 1))
        assert got == 1 + sundays


def test_date_part_names(spark):
    df = spark.createDataFrame([(D(2020, 5, 1),)], "d date")
    assert DateFeatures(input_col="d", features=["month"], output_cols=["m"])(df).columns == ["d", "m"]
    with pytest.raises(ValueError):
        DateFeatures(input_col="d", features=["fortnight"])
    with pytest.raises(ValueError):
        DateFeatures(input_col="d", features=["month", "year"], output_cols=["m"])


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(
        [("a", D(2016, 1, 30), 1.0, "x"), ("a", D(2016, 1, 31), 2.0, "y"), ("b", D(2016, 1, 2), 3.0, None)],
        "k string, date date, v double, extra string",
    )


@pytest.mark.parametrize("unit,days", [
    ("day", [D(2016, 2, 1), D(2016, 2, 2)]),
    ("weeks", [D(2016, 2, 7), D(2016, 2, 14)]),
    ("month", [D(2016, 2, 29), D(2016, 3, 31)]),
])
def test_future_goes_on_from_the_last_date_of_all(panel, unit, days):
    got = CreateFutureSet(date_col="date", n_periods=2, date_frequency=unit, group_cols=["k"])(panel)
    assert got.columns == panel.columns and got.dtypes == panel.dtypes
    new = [r for r in rows(got, "k", "date", "v", "extra") if r[2] is None]
    assert new == [(k, d, None, None) for k in "ab" for d in days]
    assert got.count() == 3 + 2 * 2


def test_future_per_group(panel):
    got = CreateFutureSet(date_col="date", n_periods=1, date_frequency="day", group_cols=["k"], per_group=True)(panel)
    assert [r[:2] for r in rows(got) if r[2] is None] == [("a", D(2016, 2, 1)), ("b", D(2016, 1, 3))]


def test_future_with_given_keys_needs_no_distinct(panel, spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    make = dict(date_col="date", n_periods=3, date_frequency="day", group_cols=["k"])
    assert rows(CreateFutureSet(**make, keys=keys)(panel)) == rows(CreateFutureSet(**make)(panel))


def test_future_without_groups(panel):
    one = panel.select("date", "v")
    step = CreateFutureSet(date_col="date", n_periods=2, date_frequency="day")
    assert step(one).count() == 5
    assert step(one.where("false")).count() == 0


def test_future_has_no_cross_join(panel):
    plan = CreateFutureSet(date_col="date", n_periods=2, date_frequency="day", group_cols=["k"])(panel)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_future_settings():
    with pytest.raises(ValueError):
        CreateFutureSet(date_col="d", n_periods=1, date_frequency="year")
    with pytest.raises(ValueError):
        CreateFutureSet(date_col="d", n_periods=0, date_frequency="day")


def test_densify(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("b", D(2020, 1, 3), 2.0)], "k string, date date, v double")
    got = rows(Densify(date_col="date", value_col="v", group_cols=["k"])(df))
    assert got == [(k, D(2020, 1, d), v) for k, vs in (("a", (1.0, 0.0, 0.0)), ("b", (0.0, 0.0, 2.0))) for d, v in zip((1, 2, 3), vs)]


def test_densify_loses_nothing(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 1.0, "x"), ("a", D(2020, 1, 1), 5.0, "y"), ("a", None, None, "z"), (None, D(2020, 1, 2), None, "w")],
        "k string, date date, v double, extra string",
    )
    got = rows(Densify(date_col="date", value_col="v", group_cols=["k"])(df))
    assert got == sorted(
        [
            ("a", D(2020, 1, 1), 1.0, "x"), ("a", D(2020, 1, 1), 5.0, "y"), ("a", D(2020, 1, 2), 0.0, None), ("a", None, None, "z"),
            (None, D(2020, 1, 1), 0.0, None), (None, D(2020, 1, 2), None, "w"),
        ],
        key=lambda r: tuple((v is None, v if v is not None else 0) for v in r),
    )


def test_pivot_finds_all_folds(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", None, 4.0)], "id string, cv int, forecast double")
    assert PivotForecasts(index=["id"])(df).columns == ["id", "cv_0", "cv_2"]
