import os

import pytest
from pyspark.sql import functions as F

from tidecast import storage
from tidecast.catalog import panels


class Context:
    master, made = "yarn", None

    def getCheckpointDir(self):
        return self.made


class Session:
    sparkContext = Context()

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_broadcast_is_bound_in_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.lit("x").alias("text"))
    assert hinted(storage.broadcast_within(df, 100)) and not hinted(storage.broadcast_within(df, 99))
    assert not hinted(storage.broadcast_within(df, 100, max_bytes=100 * 16))


def test_scratch_tables_can_be_dropped(spark):
    storage.drop_scratch(spark)
    path = storage.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert storage.drop_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    assert storage.drop_scratch(spark) == 0


def test_lines_are_shuffled_once_summed_up(spark):
    """With dimensions within a broadcast, no exchange stands between the scan of the lines and the first sums."""
    plan = panels.brand_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("l_partkey")]
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in above
