"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import passing, saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, label): every vertex with the smallest vertex it can reach.

    Each round takes the smallest label among the neighbours (a partial aggregate, so hubs are no burden) and then the
    label's own label; long chains halve. Every round is written down, and the last one changed nothing.
    """
    with passing(edges.sparkSession):
        both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
        while True:
            near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("m"))
            new = labels.join(near, labels.v == near.a).select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
            parent = labels.select(F.col("v").alias("pv"), F.col("label").alias("pl"))
            stepped = saved(new.join(parent, new.label == parent.pv).select("v", F.least("label", "pl").alias("label"), "old"))
            if stepped.where("label <> old").isEmpty():
                return saved(stepped.select("v", "label"), lasting=True)
            labels = stepped.select("v", "label")
