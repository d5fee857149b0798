"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.storage import scratch_path

#: Rows of two or three numbers that a broadcast may hold; about 100 MB on each executor at most.
BROADCAST_ROWS = 500_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidecast_shipped", False):
        return
    top = Path(__file__).parent.parent
    path = Path(tempfile.mkdtemp(prefix="tidecast-")) / "tidecast_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    context._tidecast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table of few narrow columns, with a broadcast hint if its counted rows are within the bound.

    A larger one comes back as it is: the join then shuffles both sides.
    """
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def text_key(text: Column | str) -> list[Column]:
    """96 bits that name a text; nulls share a key of their own."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def salt(parts: int) -> Column:
    """An even deal of rows over ``parts``, the same when a task is run again."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``function`` applied to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (made := function(batch)) is not None:
                yield made

    return map_arrow(df, run, schema)


def schema_of(df: DataFrame, **added: T.DataType) -> T.StructType:
    """The schema of ``df`` and fields after it."""
    return T.StructType([*df.schema, *(T.StructField(n, t) for n, t in added.items())])


def own_name(stem: str) -> str:
    """A column name that no table has."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"
