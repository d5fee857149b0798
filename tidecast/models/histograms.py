"""Regression trees grown from histograms of first and second derivatives over bins that are found once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.base import ticked

#: Gains that differ by less count as equal, so that the order in which sums were made does not pick the split.
SAME_GAIN = 1e-9


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Ascending borders of at most ``bins`` bins for each column: a value lies in bin ``i`` if ``i`` borders are below it.

    A column of few values has a border between each two of them; another has its quantiles. Two passes, whose results are
    bounded by ``bins``.
    """
    steps = ", ".join(repr(i / bins) + "D" for i in range(1, bins))
    facts = df.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.expr(f"percentile_approx({ticked(c)}, array({steps}), 10000)").alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    few = [i for i in range(len(columns)) if facts[f"n{i}"] <= 1.1 * bins]
    values = df.agg(*[F.sort_array(F.collect_set(columns[i])).alias(f"v{i}") for i in few]).first() if few else {}
    edges = []
    for i in range(len(columns)):
        if i in few and len(values[f"v{i}"]) <= bins:
            edges.append([(a + b) / 2 for a, b in zip(values[f"v{i}"], values[f"v{i}"][1:])])
        else:
            edges.append(sorted(set(facts[f"q{i}"])))
    return edges


def searched(value: str, edges: Sequence[float], first: int = 0) -> str:
    """How many of the ascending ``edges`` are below ``value``, as SQL; a search by halves."""
    if not edges:
        return str(first)
    middle = len(edges) // 2
    below, above = searched(value, edges[:middle], first), searched(value, edges[middle + 1 :], first + middle + 1)
    return f"CASE WHEN {value} > {edges[middle]!r}D THEN {above} ELSE {below} END"


@dataclass
class Node:
    """A split of one feature at one bin's end, or a leaf with a step."""

    step: float = 0.0
    feature: int = -1
    bin: int = -1
    children: list[Node] = field(default_factory=list)
    slot: int = -1

    def flat(self, depth: int) -> list[Node | None]:
        """The nodes by their number: the root is 1, the children of ``n`` are ``2 n`` and ``2 n + 1``."""
        out: list[Node | None] = [None] * 2 ** (depth + 1)

        def put(node: Node, n: int) -> None:
            out[n] = node
            for side, child in enumerate(node.children):
                put(child, 2 * n + side)

        put(self, 1)
        return out

    def sql(self, test, leaf) -> str:
        """The tree as nested ``CASE``: ``test(feature, bin)`` is true on the left, ``leaf(node)`` ends a branch."""
        if not self.children:
            return leaf(self)
        left, right = (c.sql(test, leaf) for c in self.children)
        return left if left == right else f"CASE WHEN {test(self.feature, self.bin)} THEN {left} ELSE {right} END"


def numbers(values: Iterable[float], kind: str = "INT") -> str:
    """An array constant, written as one text: hundreds of literals would be slow to analyse."""
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS ARRAY<{kind}>)"


def leaf_of(flat: Sequence[Node | None], depth: int) -> str:
    """The number of the leaf that a row with ``bins`` falls into, as SQL."""
    feature = numbers(n.feature if n and n.children else -1 for n in flat)
    border = numbers(n.bin if n and n.children else -1 for n in flat)
    down = f"2 * n + CAST(get(bins, get({feature}, n)) > get({border}, n) AS INT)"
    return f"aggregate(sequence(1, {depth}), 1, (n, i) -> CASE WHEN get({feature}, n) < 0 THEN n ELSE {down} END)"


@dataclass(frozen=True)
class Histograms:
    """Sums of derivatives by node, feature and bin: one aggregate for each level of a tree.

    ``rows`` holds the bins of all features as an array ``bins`` and is read with ``slope`` and ``bend``, SQL for the first and
    second derivative. The sums that come back are as many as nodes times bins, whatever the number of rows.
    """

    sizes: list[int]
    slope: str
    bend: str
    min_rows: int

    @property
    def offsets(self) -> list[int]:
        return [sum(self.sizes[:i]) for i in range(len(self.sizes))]

    def sums(self, rows: DataFrame, tree: Node, slots: int, depth: int) -> np.ndarray:
        """``slots`` x bins of all features x (slope, bend, rows) for the nodes of ``tree`` that have a slot.

        Tree and slots go in as array literals, so that the code Spark generates is the same for each level and round.
        """
        width = sum(self.sizes)
        flat = tree.flat(depth)
        found = (
            rows.selectExpr("*", f"get({numbers(n.slot if n else -1 for n in flat)}, {leaf_of(flat, depth)}) AS slot")
            .where("slot >= 0")
            .selectExpr("slot", f"{self.slope} AS slope", f"{self.bend} AS bend", "posexplode(bins) AS (f, b)")
            .groupBy(F.expr(f"slot * {width} + get({numbers(self.offsets)}, f) + b").alias("code"))
            .agg(F.sum("slope"), F.sum("bend"), F.count(F.lit(1)).cast("double"))
            .toArrow()
        )
        out = np.zeros((slots * width, 3))
        out[found.column(0).to_numpy()] = np.column_stack([found.column(i).to_numpy() for i in (1, 2, 3)])
        return out.reshape(slots, width, 3)

    def best_split(self, sums: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """Feature and bin with the largest gain, and the sums on both sides; None if no split is allowed or gains anything."""
        total = sums[: self.sizes[0]].sum(0)
        value = total[0] ** 2 / total[1] if total[1] > 0 else 0.0
        found: tuple[float, int, int, np.ndarray] | None = None
        for f, (at, size) in enumerate(zip(self.offsets, self.sizes)):
            left = np.cumsum(sums[at : at + size], 0)[:-1]
            right = total - left
            fit = (left[:, 2] >= self.min_rows) & (right[:, 2] >= self.min_rows) & (left[:, 1] > 0) & (right[:, 1] > 0)
            if not fit.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fit, left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - value, -np.inf)
            b = int(np.flatnonzero(gain >= gain.max() - SAME_GAIN * abs(gain.max()))[0])
            if found is None or gain[b] > found[0] * (1 + SAME_GAIN):
                found = float(gain[b]), f, b, left[b]
        if found is None or found[0] <= 1e-12 * max(1.0, abs(value)):
            return None
        return found[1], found[2], found[3], total - found[3]

    def grow(self, rows: DataFrame, depth: int) -> Node:
        """A tree of at most ``depth`` levels whose leaves step by minus slope by bend.

        A level sums up one child of each split, the one with fewer rows; the other is the parent without it.
        """
        tree = Node(slot=0)
        level = [(tree, self.sums(rows, tree, 1, depth)[0])] if depth else []
        for d in range(depth):
            pairs = []
            for node, sums in level:
                node.slot = -1
                if (split := self.best_split(sums)) is None:
                    continue
                node.feature, node.bin, *sides = split
                node.children = [Node(step=float(-s[0] / s[1])) for s in sides]
                pairs.append((node, sums, int(sides[1][2] < sides[0][2])))
            if not pairs or d + 1 == depth:
                break
            for i, (node, _, fewer) in enumerate(pairs):
                node.children[fewer].slot = i
            made = self.sums(rows, tree, len(pairs), depth)
            level = []
            for (node, sums, fewer), own in zip(pairs, made):
                node.children[fewer].slot = -1
                level += [(node.children[fewer], own), (node.children[1 - fewer], sums - own)]
        return tree
