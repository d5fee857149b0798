"""Trees from histograms against trees grown by trying every split."""

import math

import numpy as np
import pytest

from tidecast.models import TweedieBoostedTrees
from tidecast.models.histograms import bin_edges, searched

POWER, RATE = 1.5, 0.3


def brute(x, y, *, rounds, depth, min_rows, edges):
    """Forecasts of Newton boosting that tries each border of each feature, over plain arrays."""
    score = np.full(len(y), math.log(y.mean()))

    def grow(at, left):
        g, h = slope[at].sum(), bend[at].sum()
        best, place = 1e-9, None
        if left:
            for f in range(x.shape[1]):
                for e in edges[f]:
                    low = at[x[at, f] <= e]
                    high = at[x[at, f] > e]
                    if min(len(low), len(high)) < min_rows:
                        continue
                    gain = slope[low].sum() ** 2 / bend[low].sum() + slope[high].sum() ** 2 / bend[high].sum() - g**2 / h
                    if gain > best * (1 + 1e-9):
                        best, place = gain, (low, high)
        if place is None:
            step[at] = -g / h if left < depth else 0.0
            return
        for side in place:
            grow(side, left - 1)

    for _ in range(rounds):
        slope = np.exp((2 - POWER) * score) - y * np.exp((1 - POWER) * score)
        bend = (2 - POWER) * np.exp((2 - POWER) * score) + (POWER - 1) * y * np.exp((1 - POWER) * score)
        step = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        score = score + RATE * step
    return np.exp(score)


@pytest.fixture(scope="module")
def table(spark):
    """Continuous features of unlike scale, one of few values, and a target that depends on all."""
    return spark.sql("""
        SELECT id, sin(id * 12.9898) * 50 AS a, exp(cos(id * 78.233)) AS b, id % 7 AS c,
               CAST(greatest(0, round(3 + 2 * sin(sin(id * 12.9898) * 5) + (id % 7) * exp(cos(id * 78.233)) / 3 + cos(id * 3.7))) AS DOUBLE) AS y
        FROM range(0, 800, 1, 4)""").cache()


def test_forecasts_equal_trees_that_try_every_split(table):
    model = TweedieBoostedTrees(rounds=6, rate=RATE, power=POWER, depth=4, bins=32, min_rows=15, checkpoint_every=4)
    rows = model.fit(table, feature_cols=["a", "b", "c"], target_col="y").transform(table).orderBy("id").collect()
    x, y = np.array([[r.a, r.b, r.c] for r in rows], float), np.array([r.y for r in rows])
    edges = bin_edges(table.selectExpr("a", "b", "CAST(c AS DOUBLE) AS c"), ["a", "b", "c"], 32)
    assert [len(e) for e in edges] == [31, 31, 6]
    assert np.allclose([r.forecast for r in rows], brute(x, y, rounds=6, depth=4, min_rows=15, edges=edges), rtol=1e-9)


def test_borders(spark):
    df = spark.range(1000).selectExpr("double(id) AS many", "double(id % 3) AS few", "1.0D AS one")
    many, few, one = bin_edges(df, ["many", "few", "one"], 10)
    assert few == [0.5, 1.5] and one == [] and many == [99.0 + 100 * i for i in range(9)]
    found = df.selectExpr(f"{searched('many', many)} AS b").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in found} == {i: 100 for i in range(10)}


def test_rows_that_cannot_be_split(spark):
    df = spark.range(30).selectExpr("double(id) AS x", "CAST(id % 4 AS DOUBLE) AS y")
    got = TweedieBoostedTrees(rounds=3, min_rows=20).fit(df, feature_cols=["x"], target_col="y").transform(df)
    assert got.columns == ["x", "y", "forecast"] and all(math.isclose(r.forecast, 1.4333333333333333) for r in got.collect())


def test_fitted_trees_are_stored(table, path):
    from pyspark.ml import PipelineModel

    model = TweedieBoostedTrees(rounds=12, depth=2).fit(table, feature_cols=["a", "c"], target_col="y")
    model.write().save(path + "/m")
    again = PipelineModel.load(path + "/m").transform(table)
    assert again.exceptAll(model.transform(table)).count() == 0 and again.columns == [*table.columns, "forecast"]


def test_bins_are_limited():
    with pytest.raises(ValueError, match="bins"):
        TweedieBoostedTrees(bins=1)
