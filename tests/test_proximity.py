import datetime as dt
import random

import pytest

from plain_rows import rows
from tidecast.operators import TriangleEventEncoder

START = dt.date(2016, 1, 1)


def day(n):
    return START + dt.timedelta(n)


def encoder(**options):
    options = {"partition_cols": ["k"], "input_cols": ["e"], "date_col": "d", "window": 3, "date_frequency": "day", "output_cols": ["near"], **options}
    return TriangleEventEncoder(**options)


def by_hand(data, window):
    out = []
    for k, d, e in data:
        events = [(dd - d).days for kk, dd, ee in data if kk == k and ee == 1]
        ahead = [x for x in events if 0 <= x <= window]
        behind = [x for x in events if -window <= x <= 0]
        both = ([min(ahead)] if ahead else []) + ([max(behind)] if behind else [])
        out.append((k, d, e, max(both) if both else None))
    return out


@pytest.mark.parametrize("unique", [False, True])
def test_by_definition(spark, unique):
    draw = random.Random(1)
    data = [(k, day(n), int(draw.random() < 0.1)) for k in "abc" for n in range(80) if draw.random() < 0.7]
    got = encoder(one_row_per_date=unique)(spark.createDataFrame(data, "k string, d date, e int"))
    assert sorted(map(str, rows(got))) == sorted(map(str, by_hand(data, 3)))


@pytest.mark.parametrize("order", [1, -1])
def test_tied_dates_agree_in_any_order(spark, order):
    data = [("a", day(0), 0), ("a", day(0), 1), ("a", day(5), 1)][::order]
    for unique in (False, True):
        got = encoder(one_row_per_date=unique)(spark.createDataFrame(data, "k string, d date, e int"))
        assert [r[3] for r in rows(got)] == [0, 0, 0]


def test_text_flags_and_overwrite(spark):
    data = [("a", day(0), "1", True), ("a", day(2), "x", False), ("a", day(9), None, None)]
    df = spark.createDataFrame(data, "k string, d date, e string, f boolean")
    got = encoder(input_cols=["e", "f"], output_cols=None)(df)
    assert got.columns == df.columns
    assert rows(got) == [("a", day(0), 0, 0), ("a", day(2), -2, -2), ("a", day(9), None, None)]


def test_weeks_and_months_are_fractions(spark):
    df = spark.createDataFrame([("a", day(0), 0), ("a", day(10), 1)], "k string, d date, e int")
    assert rows(encoder(date_frequency="week")(df), "near") == [(0.0,), (10 / 7,)]
    assert rows(encoder(date_frequency="month")(df), "near") == [(0.0,), (0.32258065,)]


def test_null_dates_and_null_keys(spark):
    df = spark.createDataFrame([(None, day(0), 1), (None, day(1), 0), ("a", None, 1), ("a", day(1), 0)], "k string, d date, e int")
    assert rows(encoder()(df)) == [("a", day(1), 0, None), ("a", None, 1, None), (None, day(0), 1, 0), (None, day(1), 0, -1)]


def test_settings():
    for wrong in ({"date_frequency": "hour"}, {"window": -1}, {"output_cols": ["a", "b"]}):
        with pytest.raises(ValueError):
            encoder(**wrong)
