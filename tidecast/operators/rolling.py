"""Lagged rolling aggregates of a value over each series' past."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.periods import PANEL_FREQUENCIES, Frequency
from tidecast.operators.base import Operator, fresh, quoted, ticked, type_of

# Aggregate names callers may use, and the name each one stands for.
FUNCTIONS = {
    "mean": "mean",
    "avg": "mean",
    "std": "std",
    "stddev": "std",
    "stddev_samp": "std",
    "var": "var",
    "variance": "var",
    "var_samp": "var",
    "stddev_pop": "stddev_pop",
    "var_pop": "var_pop",
    "sum": "sum",
    "count": "count",
    "min": "min",
    "max": "max",
}

# Whole numbers up to this size are exact in a double.
EXACT = float(2**52)


@dataclass(frozen=True, kw_only=True)
class TargetEncoder(Operator):
    """Rolling aggregates that look back from a lag.

    For each window ``w``, lag ``l`` and function ``f`` the column
    ``{prefix}_window_{w}_lag_{l}_{f}`` aggregates the value over the rows of the
    same partition whose period lies ``l`` to ``l + w - 1`` periods before the
    row's own. The frame goes by time and not by row count: gaps shrink it and
    rows of one period share their result. Works at day resolution; rows
    without a date get NULL.

    How the work is spread:

    * The rows are summed up per partition and period first, so that a window
      task holds one row per period of a partition however many rows the
      partition has, and the result is joined back. A panel with at most one row
      per partition and period has nothing to sum up: ``one_row_per_period``
      skips the step and the join, leaving one shuffle.
    * Sums over a frame are the difference of two running totals, which costs
      the same for a window of 7 as for one of 180. This is exact for whole
      numbers (unit sales); partitions with other values, or too large ones, go
      through sliding frames. ``running_totals`` set to False sends all
      partitions that way.
    """

    value_col: str
    date_col: str
    rolling_windows: Sequence[int]
    lags: Sequence[int]
    functions: Sequence[str]
    date_frequency: str
    output_col_prefix: str
    partition_cols: Sequence[str] | None = None
    one_row_per_period: bool = False
    running_totals: bool = True
    allow_leak: bool = False

    def __post_init__(self) -> None:
        Frequency.parse(self.date_frequency, PANEL_FREQUENCIES)
        unknown = [f for f in self.functions if f not in FUNCTIONS]
        if unknown:
            raise ValueError(f"unknown functions {unknown}; known are {', '.join(FUNCTIONS)}")
        if any(w < 1 for w in self.rolling_windows):
            raise ValueError("rolling windows must be at least 1")
        if not self.allow_leak and any(lag < 1 for lag in self.lags):
            raise ValueError("a lag below 1 shows a row its own target; set allow_leak to accept that")

    # -- names ---------------------------------------------------------------

    def specs(self) -> list[tuple[int, int, str, str]]:
        """Window, lag, function and output name, in output order."""
        return [
            (w, lag, FUNCTIONS[f], f"{self.output_col_prefix}_window_{w}_lag_{lag}_{f}")
            for w, lag, f in product(self.rolling_windows, self.lags, self.functions)
        ]

    @property
    def output_cols(self) -> list[str]:
        return [name for *_, name in self.specs()]

    # -- the plan ------------------------------------------------------------

    def transform(self, df: DataFrame) -> DataFrame:
        parts = list(self.partition_cols or [])
        outputs = {name.lower() for name in self.output_cols}
        df = df.select(*[quoted(c) for c in df.columns if c.lower() not in outputs])
        period, *names = fresh(df, "period", "n", "total", "squares", "m2", "whole", "value", "low", "high")
        rows = df.select("*", self._period(df).alias(period))
        native = any(f in ("min", "max", "sum") for *_, f, _ in self.specs())
        integral = isinstance(type_of(df, self.value_col), T.IntegralType)
        sums = _Sums(ticked(period), *names, native=native, integral=integral)
        if self.one_row_per_period and parts:
            moments, sums = sums.of_rows(rows, self.value_col)
            encoded = self._encode(moments, parts, sums)
            return encoded.select(*map(quoted, df.columns), *map(quoted, self.output_cols))

        moments, sums = sums.of_groups(rows, [*parts, period], self.value_col)
        encoded = self._encode(moments, parts, sums)
        keys = fresh(df, *[f"key_{c}" for c in parts], "key_period")
        encoded = encoded.select(
            *[quoted(c).alias(k) for c, k in zip([*parts, period], keys)], *map(quoted, self.output_cols)
        )
        same = F.col(period) == F.col(keys[-1])
        for c, k in zip(parts, keys):
            same = same & quoted(c).eqNullSafe(F.col(k))
        joined = rows.join(encoded, same, "left")
        return joined.select(*map(quoted, df.columns), *map(quoted, self.output_cols))

    def _period(self, df: DataFrame) -> Column:
        day = quoted(self.date_col).cast("date")
        if self._monthly:
            return F.months_between(day, df.agg(F.min(day)).scalar())
        return F.unix_date(day)

    @property
    def _monthly(self) -> bool:
        return Frequency.parse(self.date_frequency) is Frequency.MONTH

    def _offsets(self, window: int, lag: int) -> tuple[int, int]:
        """Distance of the far and the near end of a frame, in units of the period column."""
        unit = 7 if Frequency.parse(self.date_frequency) is Frequency.WEEK else 1
        return unit * (lag + window - 1), unit * lag

    def _encode(self, moments: DataFrame, parts: list[str], sums: "_Sums") -> DataFrame:
        """All columns of ``moments`` and the outputs. The frames are written as SQL text: there
        are dozens, and Column objects are slow to build from Python."""
        by = f"PARTITION BY {', '.join(map(ticked, parts))} " if parts else ""
        series = f"{by}ORDER BY {sums.period} RANGE BETWEEN"
        everything = f"({series} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        if self._monthly or not self.running_totals:
            return self._slide(moments, series, sums)
        exact, = fresh(moments, "exact")
        # Products of two frame sums stay exact if the product over the whole series does.
        flagged = moments.selectExpr(
            "*",
            f"coalesce(min({sums.whole}) OVER {everything} AND {sums.intact(everything)} AND "
            f"{sums.n()} OVER {everything} * sum({sums.squares}) OVER {everything} < {EXACT!r}D, true) AS {exact}",
        )
        totals = self._total(flagged.where(F.col(exact)), series, sums)
        slides = self._slide(flagged.where(~F.col(exact)), series, sums)
        return totals.unionByName(slides)

    def _total(self, moments: DataFrame, series: str, sums: "_Sums") -> DataFrame:
        """Frame sums as differences of running totals."""
        columns = {"n": sums.n(), "total": f"sum({sums.total})", "squares": f"sum({sums.squares})"}
        if any(f == "sum" for *_, f, _ in self.specs()):
            columns["plain"] = f"sum({sums.plain})"
        ends = sorted(
            {e for w, lag, *_ in self.specs() for far, near in [self._offsets(w, lag)] for e in (near, far + 1)}
        )
        running = [
            f"coalesce({aggregate} OVER ({series} UNBOUNDED PRECEDING AND {_bound(end)}), 0) AS {sums.named(c, end)}"
            for end in ends
            for c, aggregate in columns.items()
        ]

        def framed(w: int, lag: int) -> dict[str, str]:
            far, near = self._offsets(w, lag)
            found = {c: f"({sums.named(c, near)} - {sums.named(c, far + 1)})" for c in columns}
            n, total = found["n"], found["total"]
            return {
                "n": n,
                "mean": f"{total} / {n}",
                "deviations": f"greatest({n} * {found['squares']} - {total} * {total}, 0D) / {n}",
                "plain": found.get("plain", ""),
            }

        return self._finish(moments, series, sums, running, framed)

    def _slide(self, moments: DataFrame, series: str, sums: "_Sums") -> DataFrame:
        """Aggregates of sliding frames."""
        columns = sums.sliding()
        if any(f == "sum" for *_, f, _ in self.specs()):
            columns["plain"] = f"sum({sums.plain})"
        sliding = [
            f"{aggregate} OVER ({series} {_bound(far)} AND {_bound(near)}) AS {sums.named(c, far, near)}"
            for far, near in sorted({self._offsets(w, lag) for w, lag, *_ in self.specs()})
            for c, aggregate in columns.items()
        ]

        def framed(w: int, lag: int) -> dict[str, str]:
            far, near = self._offsets(w, lag)
            return sums.slid({c: sums.named(c, far, near) for c in columns})

        return self._finish(moments, series, sums, sliding, framed)

    def _finish(self, moments: DataFrame, series: str, sums: "_Sums", frames: list[str], framed) -> DataFrame:
        """Outputs from the sums of each frame; minima and maxima have frames of their own."""
        extremes = {
            (f, *self._offsets(w, lag)): f"{f}({sums.low if f == 'min' else sums.high})"
            for w, lag, f, _ in self.specs()
            if f in ("min", "max")
        }
        frames = frames + [
            f"{aggregate} OVER ({series} {_bound(far)} AND {_bound(near)}) AS {sums.named(f, far, near)}"
            for (f, far, near), aggregate in extremes.items()
        ]
        out = []
        for w, lag, f, name in self.specs():
            if f in ("min", "max"):
                value = sums.named(f, *self._offsets(w, lag))
            else:
                value = _from_sums(f, **framed(w, lag))
            # A row without a date has no past.
            out.append(f"CASE WHEN {sums.period} IS NOT NULL THEN {value} END AS {ticked(name)}")
        return moments.selectExpr("*", *frames).selectExpr(*map(ticked, moments.columns), *out)


@dataclass(frozen=True)
class _Sums:
    """SQL text for the columns that sum up the values of one row or one period."""

    period: str
    count: str
    total: str
    squares: str
    m2: str
    whole: str
    value: str
    low: str
    high: str
    native: bool
    integral: bool
    grouped: bool = False

    def of_rows(self, rows: DataFrame, value_col: str) -> tuple[DataFrame, "_Sums"]:
        # Rows without a date must not enter the running totals of dated rows.
        value = f"CASE WHEN {self.period} IS NOT NULL THEN {ticked(value_col)} END"
        total = f"CAST({value} AS DOUBLE)"
        columns = [
            f"{total} AS {self.total}",
            f"{total} * {total} AS {self.squares}",
            f"{total} = rint({total}) AS {self.whole}",
        ]
        if self.native:
            columns.append(f"{value} AS {self.value}")
        return rows.selectExpr("*", *columns), replace(self, low=self.value, high=self.value)

    def of_groups(self, rows: DataFrame, keys: list[str], value_col: str) -> tuple[DataFrame, "_Sums"]:
        value = ticked(value_col)
        x = f"CAST({value} AS DOUBLE)"
        columns = {
            self.count: f"count({value})",
            self.total: f"sum({x})",
            self.squares: f"sum({x} * {x})",
            self.m2: f"var_pop({x}) * count({value})",
            self.whole: f"min({x} = rint({x}))",
        }
        if self.native:
            kind = "BIGINT" if self.integral else "DOUBLE"
            columns |= {
                self.value: f"sum(CAST({value} AS {kind}))",
                self.low: f"min({value})",
                self.high: f"max({value})",
            }
        dated = rows.where(F.expr(f"{self.period} IS NOT NULL"))
        grouped = dated.groupBy(*map(quoted, keys)).agg(*[F.expr(e).alias(c) for c, e in columns.items()])
        return grouped, replace(self, grouped=True)

    @property
    def plain(self) -> str:
        """The value in the type its sum is to have."""
        return f"CAST({self.value} AS {'BIGINT' if self.integral else 'DOUBLE'})"

    def n(self) -> str:
        return f"sum({self.count})" if self.grouped else f"count({self.total})"

    def intact(self, frame: str) -> str:
        """Test that no value is NaN. It also makes both ways read all columns, and so share one shuffle."""
        return f"NOT isnan(coalesce(sum({self.m2 if self.grouped else self.total}) OVER {frame}, 0D))"

    def sliding(self) -> dict[str, str]:
        """Aggregates of a frame. None of them takes the difference of large sums of squares."""
        if not self.grouped:
            return {"n": self.n(), "mean": f"avg({self.total})", "spread": f"var_pop({self.total})"}
        mean = f"({self.total} / nullif({self.count}, 0))"
        return {
            "n": self.n(),
            "total": f"sum({self.total})",
            "m2": f"sum({self.m2})",
            "periods": f"count({mean})",
            "with_total": f"covar_pop({self.total}, {mean})",
            "with_count": f"covar_pop({self.count}, {mean})",
        }

    def slid(self, frame: dict[str, str]) -> dict[str, str]:
        """Count, mean and squared deviations of a frame from its :meth:`sliding` aggregates."""
        n = f"coalesce({frame['n']}, 0)"
        if not self.grouped:
            mean, deviations = frame["mean"], f"{frame['spread']} * {n}"
        else:
            # Within the periods, and between their means weighted by their counts.
            mean = f"{frame['total']} / {n}"
            between = f"{frame['with_total']} - {mean} * {frame['with_count']}"
            deviations = f"greatest({frame['m2']} + {frame['periods']} * ({between}), 0D)"
        return {"n": n, "mean": mean, "deviations": deviations, "plain": frame.get("plain", "")}

    def named(self, column: str, *ends: int) -> str:
        return "_".join(["__frame", column, *(str(e).replace("-", "minus") for e in ends)])


def _bound(back: int) -> str:
    """A frame bound so many units back; a lag below zero (a leak asked for) lies ahead."""
    return f"{back} PRECEDING" if back >= 0 else f"{-back} FOLLOWING"


def _from_sums(function: str, n: str, mean: str, deviations: str, plain: str) -> str:
    """An aggregate from the count, the mean and the sum of squared deviations from it."""
    if function == "count":
        return f"CAST({n} AS BIGINT)"
    if function == "sum":
        return f"CASE WHEN {n} > 0 THEN {plain} END"
    if function == "mean":
        return f"CASE WHEN {n} > 0 THEN {mean} END"
    if function in ("std", "var"):
        var = f"CASE WHEN {n} > 1 THEN {deviations} / ({n} - 1) END"
    else:
        var = f"CASE WHEN {n} > 0 THEN {deviations} / {n} END"
    return f"sqrt({var})" if function in ("std", "stddev_pop") else var
