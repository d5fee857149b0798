"""Each query against its SQL, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, tables
from tidecast.catalog import panels
from tidecast.catalog.oracle import SQL
from tidecast.catalog.queries import QUERIES, features_of_wide
from tidecast.plans.features import LAGS, WINDOWS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    verdict = compare(spark, con, SMALL, name, oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() == 5119


def test_feature_table_form(spark):
    table = features_of_wide(spark, SMALL)
    assert len(table.columns) == 58
    assert table.columns[:12] == ["d", "id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "sales", "date", "Snap_CA", "Snap_TX", "Snap_WI"]
    names = [f"item_store_window_{w}_lag_{l}_{f}" for w in WINDOWS for l in LAGS for f in ("mean", "std")]
    assert table.columns[12:52] == names
    assert table.columns[52:] == ["day_of_week", "day_of_month", "week_of_year", "week_of_month", "month", "year"]
    types = dict(table.dtypes)
    assert types["sales"] == "float" and types["date"] == "date" and {types[n] for n in names} == {"double"}


def test_forecasts_join_on_dates(spark):
    assert dict(panels.fold_forecasts(spark, SMALL).dtypes)["date"] == "date"
