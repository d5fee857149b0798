"""What each filter removes in each order of a chain of filters, from decision diagrams of the rows' failures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import BROADCAST_ROWS, map_arrow, own_name, small, stored, table, text_key

#: Filters that are worked out in all their orders: 5040 of seven.
MOST_FILTERS = 7
#: A text group is hot if it holds more than this part of all rows, so that there are at most 1000 of them.
HOT = 1000
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

Weight = tuple[int, ...]


def plus(a: Weight, b: Weight) -> Weight:
    return tuple(x + y for x, y in zip(a, b, strict=True))


class Diagram:
    """A decision diagram over failure masks whose nodes weigh as much as the rows below them.

    Level ``i`` asks whether a row fails filter ``order[i]``: the low edge is a pass, the high edge a failure. Equal
    nodes of a level are one. A leaf is the weight of the rows with one mask.
    """

    def __init__(self, masks: dict[int, Weight], filters: int, width: int) -> None:
        self.order = list(range(filters))
        self.levels: list[list[tuple[int, int]]] = []
        self.weights: list[list[Weight]] = []
        zero = (0,) * width
        row = [masks.get(self._mask(path, filters), zero) for path in range(2**filters)]
        leaves: dict[Weight, int] = {}
        below = [leaves.setdefault(w, len(leaves)) for w in row]
        weights = list(leaves)
        while len(below) > 1:
            self.weights.insert(0, weights)
            nodes: dict[tuple[int, int], int] = {}
            below = [nodes.setdefault((below[i], below[i + 1]), len(nodes)) for i in range(0, len(below), 2)]
            self.levels.insert(0, list(nodes))
            weights = [plus(weights[a], weights[b]) for a, b in nodes]
        self.weights.insert(0, weights)

    @staticmethod
    def _mask(path: int, filters: int) -> int:
        """The mask, bit ``f`` for filter ``f``, of a path whose first edge is its highest bit."""
        return sum(1 << f for f in range(filters) if path >> (filters - 1 - f) & 1)

    def swap(self, i: int) -> None:
        """Exchange levels ``i`` and ``i + 1``. Nodes of level ``i`` keep their places, so nothing above changes."""
        lower, nodes = self.levels[i + 1], {}

        def node(low: int, high: int) -> int:
            return nodes.setdefault((low, high), len(nodes))

        crossed = []
        for low, high in self.levels[i]:
            (ll, lh), (hl, hh) = lower[low], lower[high]
            crossed.append((node(ll, hl), node(lh, hh)))
        self.levels[i], self.levels[i + 1] = crossed, list(nodes)
        under = self.weights[i + 2]
        self.weights[i + 1] = [plus(under[a], under[b]) for a, b in nodes]
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """Filter, weight kept and weight removed of each step, along the path on which all filters are passed."""
        at = 0
        for i, f in enumerate(self.order):
            low, high = self.levels[i][at]
            yield f, self.weights[i + 1][low], self.weights[i + 1][high]
            at = low


def swaps(n: int) -> Iterator[int]:
    """Adjacent exchanges that lead through all orders of ``n`` things, each once: every thing in turn is led to and fro."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # the largest thing stands in front after going down, behind after going up
        yield step + 1 if down else step
        down = not down


def audit_rows(masks: dict[int, Weight], filters: Sequence[str]) -> list[tuple]:
    """``filter_order, step, *MEASURES`` for all orders of ``filters``; a weight is rows, good rows, toxic rows."""
    n = len(filters)
    diagram = Diagram(masks, n, 3)
    found: list[tuple[str, list[tuple[int, Weight, Weight]]]] = []

    def read() -> None:
        found.append(("".join(filters[f] for f in diagram.order), list(diagram.steps())))

    read()
    for i in swaps(n):
        diagram.swap(i)
        read()
    failing, unique, shapley = [0] * n, [0] * n, [0] * n
    for _, steps in found:
        f, _, removed = steps[0]
        failing[f] = removed[0]
        f, _, removed = steps[-1]
        unique[f] = removed[0]
        for f, _, removed in steps:
            shapley[f] += removed[0]
    return [
        (name, k, kept[0], removed[0], failing[f] - removed[0], unique[f], removed[1], removed[2], shapley[f])
        for name, steps in found
        for k, (f, kept, removed) in enumerate(steps, 1)
    ]


def filter_interactions(
    df: DataFrame, filters: dict[str, Column], *, part: Column | str, good: Column | None = None, toxic: Column | None = None
) -> DataFrame:
    """``part, filter_order, step`` and the measures for each part of the rows, each order of the filters and each step.

    ``filters`` are one-letter names and conditions under which a row fails; a null condition is a pass. Measures: rows
    ``kept`` after the step and ``removed`` by it; ``redundant``, those failing its filter that an earlier step has
    removed; ``unique_fails``, those failing its filter only; ``good_lost`` and ``toxic_lost``, rows removed here for which
    ``good`` or ``toxic`` holds; ``shapley``, the filter's removed rows summed over all orders.

    Rows are counted by part and failure mask before they are shuffled, so a part is 2 ** n counts at most however many
    rows it has. A diagram of these counts is led through all orders by exchanges of adjacent levels. A null part is the
    empty string. Repeated rows count each. No rows give no rows.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with names of one letter are needed")
    names = list(filters)
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(condition, 1 << i).otherwise(0)
    weights = [F.lit(1)] + [F.lit(0) if c is None else F.when(c, 1).otherwise(0) for c in (good, toxic)]
    part = F.col(part) if isinstance(part, str) else part
    keyed = df.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *[w.alias(f"w{i}") for i, w in enumerate(weights)])
    counted = keyed.groupBy("part", "mask").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(3)])
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "w0", "w1", "w2")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, masks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = audit_rows({m["mask"]: (m["w0"], m["w1"], m["w2"]) for m in masks}, names)
                columns = [list(c) for c in zip(*rows, strict=True)]
                types = [pa.string(), pa.int32(), *[pa.int64()] * len(MEASURES)]
                arrays = [pa.array([name] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *MEASURES])

    return map_arrow(whole, run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def repeats(rows: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``repeats``: whether a row with the same ``keys`` and a smaller id exists.

    The least id of each group comes from an aggregate with partial sums. Groups that hold over a thousandth of all
    rows, of which there cannot be more than 1000, are broadcast; the others are joined by their keys. A row without id
    repeats none and is repeated by none.
    """
    total = rows.count()
    least, seen = own_name("least"), own_name("seen")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(seen), F.min(id_col).alias(least)).where(F.col(seen) > 1)
    groups = stored(groups, "copies")
    hot = groups.where(F.col(seen) * HOT > total).select(*keys, F.col(least).alias(own_hot := own_name("hot")))
    rest = small(groups.where(F.col(seen) * HOT <= total).select(*keys, least))
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    repeated = F.coalesce(F.col(id_col) > F.coalesce(F.col(own_hot), F.col(least)), F.lit(False)).alias("repeats")
    in_hot = marked.where(F.col(own_hot).isNotNull()).withColumn(least, F.lit(None).cast(rows.schema[id_col].dataType))
    others = marked.where(F.col(own_hot).isNull()).join(rest, list(keys), "left")
    return in_hot.select(*rows.columns, repeated).union(others.select(*rows.columns, repeated))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part`` and the failures ``A`` to ``E`` of each document.

    A: under 200 words. B: fewer than half of the words are distinct. C: more than 2 % capital letters. D: a symbol of
    ``#$%&*|``. E: the same text has a smaller ``doc_id`` somewhere. Words are runs without space, tab or line ends. Whole
    texts; a null text is empty and fails A only, and E if another is empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    marked = rows.select(
        "doc_id",
        "part",
        *text_key("text"),
        F.length("text").alias("n_chars"),
        (F.size("words") < 200).alias("A"),
        (F.size(F.array_distinct("words")) * 100 < F.size("words") * 50).alias("B"),
        (capitals.cast("long") * 100 > F.length("text").cast("long") * 2).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    return repeats(stored(marked, "failures"), "doc_id", ["k1", "k2", "n_chars"]).withColumnRenamed("repeats", "E")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by source."""
    rows = failures(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    rows = rows.join(small(labels, BROADCAST_ROWS), "doc_id", "left")
    return filter_interactions(rows, {f: F.col(f) for f in "ABCDE"}, part="part", good=F.col("good"), toxic=F.col("toxic"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
),
failing AS (
    SELECT doc_id, part,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM words
),
marked AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM failing LEFT JOIN marked USING (doc_id) GROUP BY part, mask
),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM f a, f b, f c, f d, f e
    WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (
    SELECT filter_order, step::INT AS step, f.f, f.bit,
        (SELECT sum(g.bit) FROM f g WHERE strpos(filter_order, g.f) < step) AS earlier
    FROM orders, range(1, 6) s(step), f WHERE f.f = substr(filter_order, step, 1)
),
parts AS (SELECT DISTINCT part FROM masks),
told AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER ((mask & (coalesce(earlier, 0) + bit)::INT) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER ((mask & coalesce(earlier, 0)::INT) = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER ((mask & coalesce(earlier, 0)::INT) > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER ((mask & coalesce(earlier, 0)::INT) = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER ((mask & coalesce(earlier, 0)::INT) = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM parts JOIN masks USING (part), steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
