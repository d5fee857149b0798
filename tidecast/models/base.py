"""What a forecaster is: something that fits to a fitted Spark ML pipeline.

``fit`` returns a :class:`pyspark.ml.PipelineModel` whose ``transform`` adds the
forecast column and nothing else, so that all forecasters are applied, stored
and loaded in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.base import quoted, ticked

TEMP = "tc_"


@dataclass(frozen=True)
class TrainingRange:
    """What one of several fits reads: its features, and rows with ``after < date <= until`` (None: no bound)."""

    feature_cols: tuple[str, ...]
    date_col: str = ""
    date_type: str = "date"
    after: str | None = None
    until: str | None = None


class Forecaster:
    """Base of all forecasters."""

    def fit_ranges(
        self, df: DataFrame, ranges: Sequence[TrainingRange], *, target_col: str, output_col: str = "forecast"
    ) -> list[PipelineModel] | None:
        """A fitted model for each range, all from the same passes over ``df``; None where each has to be fitted by itself."""
        return None

    def fit(
        self, df: DataFrame, *, feature_cols: Sequence[str], target_col: str, output_col: str = "forecast"
    ) -> PipelineModel:
        raise NotImplementedError


def added(expression: str, output_col: str) -> SQLTransformer:
    """A stage that adds one column."""
    return SQLTransformer(statement=f"SELECT *, CAST({expression} AS DOUBLE) AS {ticked(output_col)} FROM __THIS__")


def dropped(columns: Sequence[str]) -> SQLTransformer:
    """A stage that drops columns."""
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(map(ticked, columns))}) FROM __THIS__")


@dataclass(frozen=True)
class Preparation:
    """Stages from raw feature columns to one vector, with the temporary columns they add."""

    stages: list[Any]
    temporary: list[str]
    vector: str
    lowest_label: float
    mean_label: float


def prepare(rows: DataFrame, feature_cols: Sequence[str]) -> Preparation:
    """Fill gaps by the training mean, mark them by a 0/1 column, and assemble a vector.

    ``rows`` come from :func:`labelled`; one pass over them finds all it takes.
    Features without any value in the training rows cannot be filled and are
    left out. Only features with gaps get a mark.
    """
    label = F.col(TEMP + "label")
    values = [number(f) for f in feature_cols]
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(label).alias("lowest"),
        F.avg(label).alias("mean"),
        *[F.expr(f"count({v})").alias(f"n{i}") for i, v in enumerate(values)],
        *[F.expr(f"avg({v})").alias(f"mean{i}") for i, v in enumerate(values)],
    ).first()
    usable = [i for i in range(len(values)) if facts[f"n{i}"] > 0]
    if not usable:
        raise ValueError(f"no feature of {list(feature_cols)} holds a value in the {facts['rows']} training rows")
    gaps = [i for i in usable if facts[f"n{i}"] < facts["rows"]]
    columns = {f"{TEMP}x{i}": f"coalesce({values[i]}, {facts[f'mean{i}']!r}D)" for i in usable}
    columns |= {f"{TEMP}gap{i}": f"CAST({values[i]} IS NULL AS DOUBLE)" for i in gaps}
    vector = TEMP + "features"
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM __THIS__"),
        VectorAssembler(inputCols=list(columns), outputCol=vector),
    ]
    return Preparation(stages, [*columns, vector], vector, facts["lowest"], facts["mean"])


def number(feature: str) -> str:
    """A feature as a double, with NULL for NaN."""
    return f"nanvl(CAST({ticked(feature)} AS DOUBLE), NULL)"


def labelled(df: DataFrame, feature_cols: Sequence[str], target_col: str) -> DataFrame:
    """Training rows that have a target, pruned to what a fit reads."""
    label = quoted(target_col).cast("double")
    return df.where(label.isNotNull() & ~F.isnan(label)).select(
        *[quoted(f) for f in dict.fromkeys(feature_cols)], label.alias(TEMP + "label")
    )


def fitted(stages: Sequence[Any]) -> PipelineModel:
    """A pipeline model from stages that need no further fitting."""
    return PipelineModel(list(stages))
