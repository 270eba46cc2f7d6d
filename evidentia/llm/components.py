"""Connected components over a table of edges, without the driver seeing a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (columns a and b) with the smallest node it can reach.

    Each round a node takes the least label among its neighbours' and its own, then that label's label, so chains
    shorten by half. Labels are written to the shared folder each round; a hot node's messages are combined in parts.
    Raises if ``most_rounds`` don't suffice rather than return parts of components.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        sent = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        heard = sent.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        to = heard.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        jumped = heard.join(to, F.col("label") == F.col("_node"), "left").select("node", F.least("label", F.coalesce("_label", "label")).alias("label"))
        before = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        new = stored(jumped.join(before, F.col("node") == F.col("_node")).select("node", "label", (F.col("label") < F.col("_label")).alias("moved")))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
