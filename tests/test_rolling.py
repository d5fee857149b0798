import datetime as dt
import math
import statistics
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plain_rows import rows
from tidecast.operators import TargetEncoder

START = dt.date(2020, 1, 1)
ALL = ["mean", "std", "min", "max", "sum", "count", "var", "stddev_pop", "var_pop"]
SCHEMA = "k string, date date, v {}"


def day(n):
    return START + dt.timedelta(n)


def encoder(**options):
    options = {"partition_cols": ["k"], "functions": ["mean", "std"], "date_frequency": "day", **options}
    return TargetEncoder(value_col="v", date_col="date", output_col_prefix="p", **options)


def by_hand(data, windows, lags, functions, unit=1):
    """The frames by definition: all rows of the partition so many days back."""
    out = []
    for k, d, v in data:
        cells = []
        for w, lag, f in product(windows, lags, functions):
            if d is None:
                cells.append(None)
                continue
            near, far = d - dt.timedelta(unit * lag), d - dt.timedelta(unit * (lag + w - 1))
            xs = [x for kk, dd, x in data if kk == k and dd is not None and far <= dd <= near and x is not None]
            cells.append(aggregate(f, xs))
        out.append((k, d, v, *cells))
    return out


def aggregate(f, xs):
    if f == "count":
        return len(xs)
    if not xs or (f in ("std", "var") and len(xs) < 2):
        return None
    if any(math.isnan(x) for x in xs) and f != "min":
        return math.nan
    if f == "min":
        return min((x for x in xs if not math.isnan(x)), default=math.nan)
    if f == "max":
        return max(xs)
    if f == "sum":
        return math.fsum(xs)
    if f == "mean":
        return statistics.fmean(xs)
    if any(math.isinf(x) for x in xs):
        return math.nan
    return {"std": statistics.stdev, "var": statistics.variance, "stddev_pop": statistics.pstdev, "var_pop": statistics.pvariance}[f](xs)


def same(a, b, tolerance=1e-6):
    def key(r):
        return tuple((v is None, str(v)) for v in r[:3])

    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for i, (p, q) in enumerate(zip(x, y)):
            if isinstance(p, float) and isinstance(q, float):
                assert p == q or (math.isnan(p) and math.isnan(q)) or math.isclose(p, q, rel_tol=tolerance, abs_tol=tolerance), (i, x, y)
            else:
                assert p == q, (i, x, y)


WHOLE = [("a", day(n), float(n * n % 17)) for n in range(60) if n % 7] + [("b", day(n), 5.0) for n in range(0, 60, 3)]
PRICES = [("a", day(n), 1000 + math.sin(n) * 1e-3) for n in range(60)] + [("b", day(n), 0.1 * n) for n in range(60)]
TIES = [("a", day(n // 3), float(n % 5)) for n in range(90)] + [(None, day(n), float(n)) for n in range(9)]
ODD = [("a", None, 4.0), ("a", None, 8.0), ("a", day(0), None), ("a", day(1), math.nan), ("a", day(20), math.inf)] + [
    ("a", day(n), 0.5 * n) for n in range(2, 50)
]
LARGE = [("a", day(n), float(n % 3) + 1e9 * (n == 5)) for n in range(50)]
LEVELS = [("a", day(n // (1 + n % 3)), 1e9 * (n > 50) + n % 7 / 8) for n in range(100)]


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("totals", [False, True])
@pytest.mark.parametrize("data", [WHOLE, PRICES, TIES, ODD, LARGE, LEVELS], ids=["whole", "prices", "ties", "odd", "large", "levels"])
def test_all_functions_by_definition(spark, data, totals, unique):
    df = spark.createDataFrame(data, SCHEMA.format("double"))
    got = encoder(rolling_windows=[1, 7], lags=[1, 14], functions=ALL, running_totals=totals, one_row_per_period=unique)(df)
    same([tuple(r) for r in got.collect()], by_hand(data, [1, 7], [1, 14], ALL))


def test_weeks_are_seven_days(spark):
    df = spark.createDataFrame(WHOLE, SCHEMA.format("double"))
    got = encoder(rolling_windows=[2], lags=[1], date_frequency="week")(df)
    same([tuple(r) for r in got.collect()], by_hand(WHOLE, [2], [1], ["mean", "std"], unit=7))


def test_months(spark):
    data = [("a", dt.date(2020, m, 1), float(m)) for m in range(1, 13)]
    got = encoder(rolling_windows=[3], lags=[2], date_frequency="month", functions=["sum"])(
        spark.createDataFrame(data, SCHEMA.format("double"))
    )
    assert [r[3] for r in rows(got)] == [None, None] + [sum(float(i) for i in range(max(1, m - 4), m - 1)) for m in range(3, 13)]


def test_names_types_and_column_order(spark):
    df = spark.createDataFrame([("a", day(0), 1)], SCHEMA.format("int"))
    got = encoder(rolling_windows=[7, 15], lags=[7], functions=["mean", "sum", "count", "max"])(df)
    assert got.columns[3:] == [f"p_window_{w}_lag_7_{f}" for w in (7, 15) for f in ("mean", "sum", "count", "max")]
    assert [t for _, t in got.dtypes[3:7]] == ["double", "bigint", "bigint", "int"]


def test_names_in_any_spelling(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(1), 1)], "K string, DATE date, V int")
    got = encoder(rolling_windows=[1], lags=[1], functions=["sum"])(df)
    assert got.columns == ["K", "DATE", "V", "p_window_1_lag_1_sum"] and [r[3] for r in rows(got)] == [None, 1]


def test_long_integer_sums_are_exact(spark):
    data = [("a", day(0), 2**60 + 1), ("a", day(1), 1), ("a", day(2), 0)]
    got = encoder(rolling_windows=[2], lags=[1], functions=["sum"])(spark.createDataFrame(data, SCHEMA.format("bigint")))
    assert [r[3] for r in rows(got)] == [None, 2**60 + 1, 2**60 + 2]


def test_no_partition(spark):
    df = spark.createDataFrame(TIES, SCHEMA.format("double"))
    got = encoder(rolling_windows=[7], lags=[1], partition_cols=None)(df)
    merged = by_hand([("x", d, v) for _, d, v in TIES], [7], [1], ["mean", "std"])
    same([("x", *tuple(r)[1:]) for r in got.collect()], merged)


def test_user_columns_with_helper_names_survive(spark):
    df = spark.createDataFrame([("a", day(0), 1.0, 7, 8), ("a", day(1), 2.0, 9, 10)], SCHEMA.format("double") + ", __period int, period_number int")
    got = encoder(rolling_windows=[1], lags=[1], functions=["mean"])(df)
    assert rows(got) == [("a", day(0), 1.0, 7, 8, None), ("a", day(1), 2.0, 9, 10, 1.0)]


def test_a_lag_never_sees_the_days_after_it(spark):
    cut = [(k, d, v if d <= day(40) else 1e6) for k, d, v in WHOLE]
    make = encoder(rolling_windows=[7], lags=[7])
    before = make(spark.createDataFrame(WHOLE, SCHEMA.format("double"))).where(f"date <= date'{day(47)}'")
    after = make(spark.createDataFrame(cut, SCHEMA.format("double"))).where(f"date <= date'{day(47)}'")
    assert rows(before.drop("v")) == rows(after.drop("v"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.one_of(st.none(), st.integers(-99, 99))), min_size=1, max_size=60))
def test_any_rows_in_any_order(spark, data):
    data = [(k, day(n), None if v is None else float(v)) for k, n, v in data]
    got = encoder(rolling_windows=[3], lags=[1, 5], functions=ALL)(spark.createDataFrame(data, SCHEMA.format("double")))
    same([tuple(r) for r in got.collect()], by_hand(data, [3], [1, 5], ALL))


def test_settings():
    with pytest.raises(ValueError):
        encoder(rolling_windows=[7], lags=[0])
    with pytest.raises(ValueError):
        encoder(rolling_windows=[0], lags=[1])
    with pytest.raises(ValueError):
        encoder(rolling_windows=[7], lags=[1], functions=["median; drop"])
    with pytest.raises(ValueError):
        encoder(rolling_windows=[7], lags=[1], date_frequency="year")


def test_allowed_leak_sees_the_row_itself(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 3.0), ("a", day(2), 5.0)], SCHEMA.format("double"))
    got = encoder(rolling_windows=[1], lags=[0, -1], functions=["mean"], allow_leak=True)(df)
    assert [r[3:] for r in rows(got)] == [(1.0, 3.0), (3.0, 5.0), (5.0, None)]


def test_one_shuffle_for_a_panel(spark, path):
    spark.createDataFrame(WHOLE, SCHEMA.format("double")).write.parquet(path + "/t")
    df = encoder(rolling_windows=[7, 30], lags=[7, 28], one_row_per_period=True)(spark.read.parquet(path + "/t"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("+- Exchange hashpartitioning") == 1 and plan.count("ReusedExchange") == 1
    assert plan.count("FileScan") == 1


def test_a_hot_day_of_a_hot_key_is_split(spark, path):
    """Half of all rows on one key and day: the join back splits them over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    spark.sql(f"""SELECT CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 97) END AS k,
                         date_add(date'{START}', CASE WHEN id % 2 = 0 THEN 30 ELSE int(id % 61) END) AS date,
                         double(id % 7) AS v, uuid() AS payload
                  FROM range(40000)""").write.parquet(path + "/t")
    df = spark.read.parquet(path + "/t")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = encoder(rolling_windows=[7], lags=[1])(df)
        assert len(got.collect()) == 40000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
