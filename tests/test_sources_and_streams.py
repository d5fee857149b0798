import pytest
from pyspark.errors import AnalysisException

from plain_rows import rows
from tidecast.operators import ColumnSelect, ColumnType, ConvertToDate, JoinDataFrame, MeltDataFrame, TargetEncoder
from tidecast.sources import read_csv_strings, read_csv_typed, read_parquet, write_csv, write_parquet
from tidecast.storage import scratch_path, shared_folder
from tidecast.streaming import stream_chain


@pytest.fixture
def table(spark):
    return spark.sql("SELECT 1 AS a, date'2020-01-02' AS d, 1.5D AS x UNION ALL SELECT 2, NULL, NULL")


def test_csv_as_text_and_typed(spark, table, path):
    write_csv(table, path + "/t")
    text = read_csv_strings(spark, path + "/t")
    assert {t for _, t in text.dtypes} == {"string"}
    assert rows(text) == [("1", "2020-01-02", "1.5"), ("2", None, None)]
    assert rows(read_csv_typed(spark, path + "/t", table.schema)) == rows(table)


def test_empty_text_reads_back_as_null(spark, path):
    df = spark.createDataFrame([("",), (None,), ("a",)], "s string").selectExpr("1 AS k", "s")
    write_csv(df, path + "/t")
    assert sorted(str(r["s"]) for r in read_csv_typed(spark, path + "/t", "k int, s string").collect()) == ["None", "None", "a"]


def test_parquet_does_not_overwrite_unasked(spark, table, path):
    write_parquet(table, path + "/a")
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_parquet(table, path + "/a")
    write_parquet(table, path + "/a", mode="overwrite")
    write_parquet(table, path + "/b", partition_by=["a"])
    assert read_parquet(spark, [path + "/a", path + "/a"]).count() == 4
    assert rows(read_parquet(spark, path + "/b").select("a", "d", "x")) == rows(table)


def test_scratch_lies_in_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_row_local_operators_run_on_a_stream(spark, path):
    wide = spark.createDataFrame([("a", "1", "x"), ("b", "2", "3")], "id string, d_1 string, d_2 string")
    write_csv(wide, path + "/in")
    days = spark.createDataFrame([("d_1", "2020-01-01"), ("d_2", "2020-01-02")], "d string, date string")
    steps = [
        MeltDataFrame(id_vars=["id"], value_vars=["d_1", "d_2"], var_name="d", value_name="sales"),
        ColumnType(input_cols=["sales"], value="int"),
        JoinDataFrame(df=days, on="d", how="left"),
        ConvertToDate(input_cols=["date"], date_format="yyyy-MM-dd"),
        ColumnSelect(["id", "date", "sales"]),
    ]
    stream = stream_chain(spark.readStream.option("header", True).schema(wide.schema).csv(path + "/in"), *steps)
    query = stream.writeStream.format("parquet").option("checkpointLocation", path + "/state").trigger(availableNow=True).start(path + "/out")
    query.awaitTermination(60)
    expected = wide
    for step in steps:
        expected = step(expected)
    assert rows(spark.read.parquet(path + "/out")) == rows(expected)


def test_history_operators_refuse_a_stream(spark):
    encoder = TargetEncoder(value_col="v", date_col="d", rolling_windows=[1], lags=[1], functions=["mean"], date_frequency="day", output_col_prefix="p")
    with pytest.raises(ValueError, match="TargetEncoder"):
        stream_chain(spark.range(1), encoder)
