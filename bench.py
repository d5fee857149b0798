"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[BENCH_CPUS]``.
Each query runs three times to a sink that drops the rows, after a first run that
does not count; the median is reported. Queries over the wide table build it as a
part of their work. ``part_features`` runs over one series for each part, so its
series grow with the scale factor. The fits run once: ``twelve_fits``
boosts 100 rounds in each of 12 fits, as the recorded baseline does.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import panels
from tidecast.catalog.queries import QUERIES, blocks
from tidecast.models import TweedieBoostedTrees
from tidecast.operators import Chain, DateFeatures, Densify
from tidecast.plans import calendar_pipeline, cross_validate, evaluate, feature_pipeline
from tidecast.plans.features import DATE_PARTS, LAGS, WINDOWS
from tidecast.sources import RunLog, read_parquet, write_parquet
from tidecast.storage import scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

CATALOGUE = (
    "minimum_slice",
    "encode_day",
    "encode_week",
    "encode_month",
    "encode_coarse",
    "encode_no_partition",
    "event_proximity_ties",
    "future_day",
    "melt_rest",
    "cv_split_expanding",
    "cv_direct_multi_horizon",
    "fold_summary",
    "dash_series_by_date",
    "join_full",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def dense_panel(spark: SparkSession) -> DataFrame:
    """A row for each brand, region and day, as a melted wide table has."""
    panel = panels.brand_panel(spark, SF_DIR)
    return Densify(date_col="date", value_col="sales", group_cols=["id", "item_id", "store_id"])(panel)


def features(spark: SparkSession, panel: str) -> DataFrame:
    """All 40 rolling features and the date parts of the dense panel."""
    rolled = panels.lagged(read_parquet(spark, panel), windows=WINDOWS, lags=LAGS, functions=("mean", "std"))
    return Chain(DateFeatures(input_col="date", features=DATE_PARTS))(rolled)


def part_features(spark: SparkSession) -> None:
    """Rolling features of each part by day: as many series as the scale factor has parts."""
    panel = (
        panels.shipped(spark, SF_DIR)
        .groupBy(F.col("l_partkey").alias("item_id"), F.lit("all").alias("store_id"), "date")
        .agg(F.sum("l_quantity").alias("sales"))
    )
    drain(panels.lagged(panel, windows=(7, 30), lags=(7, 28), functions=("mean", "std")))


def wide_to_features(spark: SparkSession) -> None:
    """The whole feature build, from the wide CSV table of brands and regions on."""
    wide = panels.wide(spark, SF_DIR, panels.brand_panel(spark, SF_DIR))
    days = [c for c in wide.columns if c.startswith("d_")]
    drain(feature_pipeline(wide, calendar_pipeline(panels.calendar(spark, SF_DIR)), day_columns=days))


def twelve_fits(spark: SparkSession, table: str) -> None:
    """Four horizon blocks of 15 features, two folds and a final fit each, boosted trees with Tweedie loss."""
    parts = ("week_of_year", "month", "day_of_week", "day_of_month", "year")
    config = blocks(windows=WINDOWS, functions=("mean", "std"), parts=parts)
    log = RunLog(spark, scratch_path(spark, "bench-runs"))
    cross_validate(read_parquet(spark, table), config, log, model=TweedieBoostedTrees(), store_input=False)
    print("tweedie rmse", evaluate(log).collect()[0]["value"], file=sys.stderr)


def main() -> None:
    spark = session()
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}

    def timed(name, job, runs: int = 1) -> None:
        took = []
        for _ in range(runs + (runs > 1)):
            start = time.perf_counter()
            job()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[-runs:]), 3)
        print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr, flush=True)

    for name in CATALOGUE:
        timed(name, lambda: drain(QUERIES[name](spark, SF_DIR)), runs=3)
    timed("part_features", lambda: part_features(spark), runs=3)
    timed("wide_to_features", lambda: wide_to_features(spark))
    panel, table = scratch_path(spark, "bench-panel"), scratch_path(spark, "bench-features")
    timed("dense_panel", lambda: write_parquet(dense_panel(spark), panel))
    timed("forty_features", lambda: write_parquet(features(spark, panel), table))
    timed("twelve_fits", lambda: twelve_fits(spark, table))

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
