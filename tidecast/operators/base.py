"""What all operators share: the call protocol, chaining and name rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Operator:
    """A DataFrame-to-DataFrame step: ``df.transform(op)`` or ``op.transform(df)``."""

    #: True if each output row depends on one input row only, so that the
    #: operator also runs on a streaming DataFrame.
    row_local = False

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


class Chain(Operator):
    """Operators applied one after the other."""

    def __init__(self, *steps: Operator) -> None:
        self.steps = steps

    @property
    def row_local(self) -> bool:  # type: ignore[override]
        return all(step.row_local for step in self.steps)

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.transform, self.steps, df)


def ticked(name: str) -> str:
    """A name as SQL text, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col(ticked(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    """The type of a column, found as Spark finds it, in any spelling."""
    return df.select(quoted(name)).schema[0].dataType


def text_literal(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def paired(inputs: Sequence[str], outputs: Sequence[str] | None) -> list[tuple[str, str]]:
    """Inputs with their output names; without names the inputs are overwritten."""
    outputs = inputs if outputs is None else outputs
    if len(inputs) != len(outputs):
        raise ValueError(f"{len(inputs)} input columns but {len(outputs)} output names")
    return list(zip(inputs, outputs))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the stems and clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def replace_columns(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    """Select list that keeps the order of ``df``, overwrites same-named columns and appends the rest."""
    by_key = {name.lower(): (name, col) for name, col in new.items()}
    kept = []
    for c in df.columns:
        name, col = by_key.pop(c.lower(), (c, quoted(c)))
        kept.append(col.alias(name))
    return kept + [col.alias(name) for name, col in by_key.values()]
