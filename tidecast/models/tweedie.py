"""Boosted trees under Tweedie loss."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidecast.models.base import TEMP, Forecaster, added, dropped, fitted, labelled, prepare
from tidecast.models.histograms import Histograms, Node, bin_edges, leaf_of, numbers, searched
from tidecast.storage import shared_folder

#: Trees in one expression of the fitted model.
TREES_TOGETHER = 10


@dataclass(frozen=True)
class TweedieBoostedTrees(Forecaster):
    """Newton boosting of regression trees for a non-negative target, log link.

    Spark's own boosted trees know no Tweedie loss. Features are put into quantile bins once for each fit. A round grows
    one tree from histograms: sums of the first and second derivative of the loss by node, feature and bin, one aggregate for
    each level, from which the driver takes the splits. The best step of a leaf is minus the one sum by the other. The
    forecast is ``exp(start + rate * sum of trees)``; the trees are SQL in the fitted pipeline.
    """

    rounds: int = 100
    rate: float = 0.1
    power: float = 1.5
    depth: int = 5
    bins: int = 64
    min_rows: int = 20
    checkpoint_every: int = 10
    seed: int = 0

    def __post_init__(self) -> None:
        if not 1 < self.power < 2:
            raise ValueError(f"power must lie between 1 and 2, not {self.power}")
        if not 2 <= self.bins <= 32_767:
            raise ValueError(f"bins must be 2 to 32767, not {self.bins}")
        if not 1 <= self.depth <= 12:
            raise ValueError(f"depth must be 1 to 12, not {self.depth}")

    def fit(
        self, df: DataFrame, *, feature_cols: Sequence[str], target_col: str, output_col: str = "forecast"
    ) -> PipelineModel:
        shared_folder(df.sparkSession)
        rows = labelled(df, feature_cols, target_col)
        prep = prepare(rows, feature_cols)
        if prep.lowest_label < 0 or prep.mean_label <= 0:
            raise ValueError(f"Tweedie loss needs a non-negative {target_col} that is not all zero")
        start, columns = math.log(prep.mean_label), [c for c in prep.temporary if c != prep.vector]
        filled = prep.stages[0].transform(rows)
        edges = bin_edges(filled, columns, self.bins)
        score, label = TEMP + "score", TEMP + "label"
        bins = ", ".join(f"CAST({searched(c, e)} AS SMALLINT)" for c, e in zip(columns, edges))
        scored = filled.selectExpr(
            f"array({bins}) AS bins",
            label,
            f"{start!r}D AS {score}",
        ).persist(StorageLevel.MEMORY_AND_DISK)
        # First and second derivative of the loss in the log of the forecast.
        long, short = f"exp({2 - self.power!r}D * {score})", f"{label} * exp({1 - self.power!r}D * {score})"
        histograms = Histograms(
            [len(e) + 1 for e in edges],
            f"{long} - {short}",
            f"{2 - self.power!r}D * {long} + {self.power - 1!r}D * {short}",
            self.min_rows,
        )
        trees: list[Node] = []
        stale = None
        try:
            for i in range(self.rounds):
                tree = histograms.grow(scored, self.depth)
                trees.append(tree)
                if not tree.children or i + 1 == self.rounds:
                    break  # without a split no later round has one
                flat = tree.flat(self.depth)
                steps = numbers((self.rate * n.step if n else 0.0 for n in flat), "DOUBLE")
                moved = scored.withColumn(score, F.expr(f"{score} + get({steps}, {leaf_of(flat, self.depth)})"))
                # Filled by the next level's aggregate; the round before is done with by then.
                if stale is not None:
                    stale.unpersist()
                stale = scored
                if (i + 1) % self.checkpoint_every == 0:
                    # Keeps the plan, and what a lost executor costs, short.
                    moved = moved.checkpoint()
                scored = moved.persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            for kept in (stale, scored):
                if kept is not None:
                    kept.unpersist()

        def told(tree: Node) -> str:
            return tree.sql(lambda f, b: f"{columns[f]} <= {edges[f][b]!r}D", lambda n: f"{n.step!r}D")

        parts = [trees[i : i + TREES_TOGETHER] for i in range(0, len(trees), TREES_TOGETHER)]
        outputs = [f"{TEMP}trees{i}" for i in range(len(parts))]
        return fitted(
            [
                prep.stages[0],
                *[added(" + ".join(map(told, part)), name) for part, name in zip(parts, outputs)],
                added(f"exp({start!r}D + {self.rate!r}D * ({' + '.join(outputs)}))", output_col),
                dropped([*columns, *outputs]),
            ]
        )
