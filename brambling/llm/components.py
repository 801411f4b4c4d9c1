"""Connected components of a graph of links, as joins and aggregates over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """id, label (the least id of its component) for every id in the edges a, b.

    Each round takes the least label among neighbours and then the label of that label; it ends when
    a round changes nothing. Every round is a written table, so a lost executor costs one round.
    """
    edges = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = written(moved.join(up, "label", "left").select("id", "old", F.least("label", "up").alias("label")), "labels")
        if not labels.filter("label <> old").limit(1).count():
            return labels.select("id", "label")
        labels = labels.select("id", "label")
