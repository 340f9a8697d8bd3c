"""Connected components of a table of links by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches) of every node in ``edges`` (a, b: two longs, any direction; repeated links and loops do no harm).

    Each round gives a node the smallest label next to it and then the label of that label, so chains shorten at least by half.
    Labels are written to the shared folder in each round; a node with very many links takes part in partial minima only.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "comp", F.least("comp", "near").alias("low"))
        step = written(step, "labels-near")
        at = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = step.join(at, "low", "left").select("node", F.least("low", "lower").alias("comp"), (F.least("low", "lower") < F.col("comp")).alias("changed"))
        new = written(new, "labels")
        labels = new.select("node", "comp")
        if new.where("changed").limit(1).count() == 0:
            return labels
