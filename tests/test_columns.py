import pytest
from pyspark.errors import AnalysisException, PySparkException

from plain_rows import rows
from tidecast.operators import (
    Chain,
    Checkpointer,
    ColumnSelect,
    ColumnType,
    ConvertToDate,
    DateCutoff,
    JoinDataFrame,
    MemberFilter,
    members,
)


@pytest.fixture
def text(spark):
    return spark.createDataFrame([("1", "2020-02-30"), ("x", "2020-02-29"), ("", None), (None, "2020/01/01")], "a string, b string")


def test_select_takes_requested_spelling_and_order(text):
    assert ColumnSelect(["B", "a"])(text).columns == ["B", "a"]


def test_bad_numbers_become_null(text):
    got = ColumnType(input_cols=["a"], value="float")(text)
    assert dict(got.dtypes)["a"] == "float"
    assert rows(got, "a") == [(1.0,), (None,), (None,), (None,)]


def test_strict_cast_raises(text):
    with pytest.raises(PySparkException):
        ColumnType(input_cols=["a"], value="float", strict=True)(text).collect()


def test_cast_to_new_columns_keeps_the_input(text):
    assert ColumnType(input_cols=["a"], value="int", output_cols=["n"])(text).columns == ["a", "b", "n"]


def test_bad_dates_become_null(text):
    got = ConvertToDate(input_cols=["b"], date_format="yyyy-MM-dd", output_cols=["day"])(text)
    assert [str(r["day"]) for r in got.orderBy("b").collect()] == ["None", "2020-02-29", "None", "None"]


def test_strict_date_raises(text):
    with pytest.raises(PySparkException):
        ConvertToDate(input_cols=["b"], date_format="yyyy-MM-dd", strict=True)(text).collect()


@pytest.mark.parametrize("make", [
    lambda: ColumnType(input_cols=["a"], value="int", output_cols=["x", "y"]),
    lambda: ConvertToDate(input_cols=["a", "b"], date_format="yyyy", output_cols=["x"]),
])
def test_name_lists_must_match(make):
    with pytest.raises(ValueError):
        make()


@pytest.mark.parametrize("how,n", [("inner", 1), ("left", 2), ("right", 2), ("full", 3), ("left_semi", 1), ("left_anti", 1)])
@pytest.mark.parametrize("limit", [None, 0, 10])
def test_join_types_with_and_without_broadcast(spark, how, n, limit):
    left = spark.createDataFrame([("p", 1, "a"), ("q", 2, "b")], "v string, k int, w string")
    right = spark.createDataFrame([(1, True), (3, False)], "k int, f boolean")
    got = JoinDataFrame(df=right, on="k", how=how, broadcast_rows=limit)(left)
    assert got.count() == n
    assert got.columns[0] == "k"


def test_broadcast_only_below_the_limit(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.range(5).withColumnRenamed("id", "k")

    def hinted(limit):
        plan = JoinDataFrame(df=right, on="k", how="left", broadcast_rows=limit)(left)
        return "strategy=broadcast" in plan._jdf.queryExecution().logical().toString()

    assert hinted(5) and not hinted(4)


def test_member_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert MemberFilter("k", ["All", "a"])(df).count() == 3
    assert rows(MemberFilter("k", ["a"])(df)) == [("a",)]
    assert rows(MemberFilter("k", ["a", None])(df)) == [("a",), (None,)]
    assert rows(members(df.union(df), "k")) == [("a",), ("b",), (None,)]


def test_cutoff_is_strict_and_pushed_down(spark, path):
    df = spark.sql("SELECT explode(sequence(date'2016-04-29', date'2016-05-02')) AS date, 1 AS v")
    df.write.parquet(path + "/t")
    got = DateCutoff("date", "2016-05-01")(spark.read.parquet(path + "/t"))
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(date,2016-05-01)" in plan


def test_checkpoint_keeps_rows_and_cuts_the_plan(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice")
    got = Checkpointer(eager=True)(df)
    assert rows(got) == rows(df)
    assert "ExistingRDD" in got._jdf.queryExecution().executedPlan().toString()


def test_chain_applies_in_order(text):
    chain = Chain(ColumnType(input_cols=["a"], value="int"), ColumnSelect(["a"]))
    assert rows(text.transform(chain)) == rows(chain.transform(text)) == [(1,), (None,), (None,), (None,)]


def test_unknown_column_is_an_error(text):
    with pytest.raises(AnalysisException):
        ColumnSelect(["nope"])(text)
