"""Where lineage cuts and scratch tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast may take, by the counted rows and the widths of their columns.
BROADCAST_BYTES = 256 << 20
#: Bytes of a value of a type without a size of its own, and of a text or a nested value.
NUMBER_BYTES, TEXT_BYTES = 16, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only on a single machine (a ``local`` master, such as in a test) a new local
    folder is made where the session names none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidecast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below :func:`shared_folder`, known to :func:`drop_scratch`."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = spark.sparkContext.__dict__.setdefault("_tidecast_scratch", [])
    made.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables that this application has made; returns how many there were.

    Tables that still read them are of no use afterwards.
    """
    made = spark.sparkContext.__dict__.setdefault("_tidecast_scratch", [])
    dropped = 0
    while made:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def row_bytes(df: DataFrame) -> int:
    """A guess at the size of a row in memory."""
    wide = ("string", "binary", "array", "map", "struct", "variant")
    return sum(TEXT_BYTES if f.dataType.simpleString().startswith(wide) else NUMBER_BYTES for f in df.schema)


def broadcast_within(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows and ``max_bytes``.

    The rows are counted, up to the bound; bytes follow from the types of the
    columns. A larger table comes back as it is, so that the join shuffles both sides.
    """
    most = min(max_rows, max_bytes // max(1, row_bytes(df)))
    if df.select(F.lit(1)).limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df
