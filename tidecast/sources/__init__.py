from tidecast.sources.config import BacktestConfig, Block
from tidecast.sources.files import (
    read_csv_strings,
    read_csv_typed,
    read_parquet,
    table,
    write_csv,
    write_parquet,
)
from tidecast.sources.runlog import RunLog

__all__ = [
    "BacktestConfig",
    "Block",
    "RunLog",
    "read_csv_strings",
    "read_csv_typed",
    "read_parquet",
    "table",
    "write_csv",
    "write_parquet",
]
