"""Least squares over many ranges of dates and sets of features from one aggregate."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.models.base import TEMP, TrainingRange, labelled, number
from tidecast.operators.base import quoted, ticked

#: A variance so much smaller than the mean square counts as none, an axis of features so much shorter than the longest as well.
NO_VARIANCE, NO_AXIS = 1e-12, 1e-10


def segment(ranges: Sequence[TrainingRange]) -> tuple[str, list[str]]:
    """SQL that numbers a row by the bounds of the ranges below its date, and these bounds; -1 for a row without a date."""
    cuts = sorted({c for r in ranges for c in (r.after, r.until) if c is not None})
    if not cuts:
        return "0", []
    bounded = next(r for r in ranges if r.after is not None or r.until is not None)
    date, kind = ticked(bounded.date_col), bounded.date_type

    def search(at: list[str], first: int) -> str:
        if not at:
            return str(first)
        middle = len(at) // 2
        return f"CASE WHEN {date} > CAST('{at[middle]}' AS {kind}) THEN {search(at[middle + 1 :], first + middle + 1)} ELSE {search(at[:middle], first)} END"

    return f"CASE WHEN {date} IS NULL THEN -1 ELSE {search(cuts, 0)} END", cuts


class Moments:
    """Sums of products of the target and the features, by segment of dates.

    The columns are 1, the target, each feature (0 where it has a gap) and, for features with gaps, a mark of the gap. Target
    and features are taken from their mean over all rows, so that sums of squares lose no digits. Two passes over the
    rows: one for the means and gaps, one for all products that some set of features needs.
    """

    def __init__(self, df: DataFrame, ranges: Sequence[TrainingRange], target_col: str) -> None:
        self.features = list(dict.fromkeys(f for r in ranges for f in r.feature_cols))
        number_of, self.cuts = segment(ranges)
        extra = [ranges[0].date_col] if self.cuts else []
        rows = labelled(df, [*self.features, *extra], target_col)
        self.values = {f: number(f) for f in self.features}
        facts = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(TEMP + "label").alias("label"),
            *[F.expr(f"count({self.values[f]})").alias(f"n{i}") for i, f in enumerate(self.features)],
            *[F.expr(f"avg({self.values[f]})").alias(f"mean{i}") for i, f in enumerate(self.features)],
        ).first()
        self.label = facts["label"] or 0.0
        self.centre = {f: facts[f"mean{i}"] or 0.0 for i, f in enumerate(self.features)}
        self.gaps = [f for i, f in enumerate(self.features) if facts[f"n{i}"] < facts["n"]]
        columns = {"1": "1D", "y": f"({TEMP}label - {self.label!r}D)"}
        columns |= {("x", f): f"coalesce({self.values[f]} - {self.centre[f]!r}D, 0D)" for f in self.features}
        columns |= {("gap", f): f"CAST({self.values[f]} IS NULL AS DOUBLE)" for f in self.gaps}
        self.place = {c: i for i, c in enumerate(columns)}
        names = [f"v{i}" for i in range(len(columns))]
        pairs = sorted(
            {
                pair
                for r in ranges
                for pair in combinations_with_replacement(sorted(self.place[c] for c in columns if isinstance(c, str) or c[1] in r.feature_cols), 2)
            }
        )
        flat = rows.selectExpr(f"{number_of} AS segment", *[f"{e} AS {n}" for e, n in zip(columns.values(), names)])
        made = flat.groupBy("segment").agg(*[F.expr(f"sum(v{i} * v{j})").alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).collect()
        self.sums = {}
        for row in made:
            full = np.zeros((len(columns), len(columns)))
            for (i, j), v in zip(pairs, row[1:]):
                full[i, j] = full[j, i] = v
            self.sums[row["segment"]] = full

    def over(self, wanted: TrainingRange) -> np.ndarray:
        """The sums over the rows of one range: those of its segments together."""
        first = 0 if wanted.after is None else bisect_left(self.cuts, wanted.after) + 1
        last = len(self.cuts) if wanted.until is None else bisect_left(self.cuts, wanted.until)
        undated = wanted.after is None and wanted.until is None
        own = [m for s, m in self.sums.items() if first <= s <= last or (s < 0 and undated)]
        return sum(own, np.zeros((len(self.place), len(self.place))))

    def line(self, wanted: TrainingRange, m: np.ndarray) -> str:
        """One feature: rows without it do not count, and get no forecast."""
        feature = wanted.feature_cols[0]
        one, y, x = self.place["1"], self.place["y"], self.place["x", feature]
        gap = self.place.get(("gap", feature))
        n, sum_y = m[one, one], m[one, y]
        if gap is not None:
            n, sum_y = n - m[one, gap], sum_y - m[gap, y]
        spread = m[x, x] - m[one, x] ** 2 / n if n else 0.0
        if spread <= NO_VARIANCE * m[x, x]:
            raise ValueError(f"{feature} takes fewer than two values in the training rows")
        slope = float((m[x, y] - m[one, x] * sum_y / n) / spread)
        intercept = float(self.label + sum_y / n - slope * (self.centre[feature] + m[one, x] / n))
        return f"{slope!r}D * {ticked(feature)} + {intercept!r}D"

    def plane(self, wanted: TrainingRange, m: np.ndarray) -> str:
        """Several features: gaps are filled with the mean over the range and marked; features without any value are left out."""
        one, y = self.place["1"], self.place["y"]
        n = m[one, one]
        missing = {f: m[one, self.place["gap", f]] if f in self.gaps else 0.0 for f in wanted.feature_cols}
        usable = [f for f in dict.fromkeys(wanted.feature_cols) if missing[f] < n]
        if not usable:
            raise ValueError(f"no feature of {list(wanted.feature_cols)} holds a value in the {int(n)} training rows")
        mean = {f: m[one, self.place["x", f]] / (n - missing[f]) for f in usable}
        marked = [f for f in usable if missing[f] > 0]
        take = np.zeros((len(self.place), len(usable) + len(marked)))
        for k, f in enumerate(usable):
            take[self.place["x", f], k] = 1.0
            if f in self.gaps:
                take[self.place["gap", f], k] = mean[f]
        for k, f in enumerate(marked, len(usable)):
            take[self.place["gap", f], k] = 1.0
        sums, with_y = m[one] @ take, take.T @ m[:, y]
        spread = take.T @ m @ take - np.outer(sums, sums) / n
        scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
        scale[scale**2 <= NO_VARIANCE * np.maximum(np.diag(take.T @ m @ take), 1e-300)] = 0.0
        inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
        slopes = inverse * (np.linalg.pinv(spread * np.outer(inverse, inverse), rcond=NO_AXIS, hermitian=True) @ (inverse * (with_y - sums * m[one, y] / n)))
        rest = float(self.label + m[one, y] / n - slopes @ (sums / n))
        terms = [f"{rest!r}D"]
        for k, f in enumerate(usable):
            terms.append(f"{float(slopes[k])!r}D * (coalesce({self.values[f]}, {float(self.centre[f] + mean[f])!r}D) - {self.centre[f]!r}D)")
        for k, f in enumerate(marked, len(usable)):
            terms.append(f"{float(slopes[k])!r}D * CAST({self.values[f]} IS NULL AS DOUBLE)")
        return " + ".join(terms)


def least_squares(df: DataFrame, ranges: Sequence[TrainingRange], target_col: str) -> list[str]:
    """For each range, the forecast as SQL over the feature columns."""
    moments = Moments(df, ranges, target_col)
    return [(moments.line if len(r.feature_cols) == 1 else moments.plane)(r, moments.over(r)) for r in ranges]
