"""Operators on streaming DataFrames.

Operators that look at one row at a time run on a stream as they are. Those
that need the whole history of a series (rolling features, event proximity,
future periods, folds) run on tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidecast.operators.base import Chain, Operator


def stream_chain(stream: DataFrame, *steps: Operator) -> DataFrame:
    """Apply row-local operators to a stream; refuses any other operator."""
    stuck = [type(step).__name__ for step in steps if not step.row_local]
    if stuck:
        raise ValueError(f"{', '.join(stuck)} need whole tables and cannot run on a stream")
    return Chain(*steps)(stream)


__all__ = ["stream_chain"]
