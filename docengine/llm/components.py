"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``id, label``: the smallest id of each node's component.

    Every round takes the least label among the neighbours and then the label
    of that label, so chains shorten by half.  Only counts reach the driver;
    neighbours are reduced by a minimum, never gathered.
    """
    links = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    links = scratch.save(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "links")
    labels = scratch.save(links.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "id"), "labels")
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("src")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        moved = scratch.save(hooked.join(up, F.col("label") == F.col("up_id"), "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = moved.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = moved
        if not changed:
            return labels.select("id", "label")
