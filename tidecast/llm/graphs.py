"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the label is the least node of its component.

    Labels spread along links and then jump to their label's label until none changes; each step is stored, and a
    node with very many links is summed up before it is shuffled.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(
            labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "near").alias("next")), "labels"
        )
        target = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels = stored(step.join(target, "next").select("node", F.col("label").alias("last"), F.least("next", "far").alias("label")), "labels")
        if labels.where("label != last").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
