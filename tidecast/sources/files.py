"""CSV and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv_strings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header row, every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv_typed(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """CSV with a header row and a given schema, so that no pass infers one."""
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("dateFormat", date_format)
        .schema(schema)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header row and no index column. Empty text reads back as NULL."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One Parquet table, or several stacked by column name."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> str:
    """A Parquet table; by default an existing one is an error."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
