"""Connected components of an undirected graph, as joins and aggregations.

Every vertex starts with its own id as label. A round takes the least label among a vertex
and its neighbours, then the label's own label (pointer jumping), and is written to the
shared folder; rounds end when no label changes. Labels shrink at least as fast as on a
path being halved, so the number of rounds is logarithmic in the longest shortest path in
practice. Nothing but the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) for every vertex of an edge; label is the least vertex id of its component.

    Repeated edges, loops and either direction are fine; an edge with a null end is ignored;
    no edges give an empty result.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = checkpointed(
        known.select(F.col(a).alias("v"), F.col(b).alias("u")).union(known.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct()
    )
    labels = checkpointed(both.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("near")), "u").groupBy("v").agg(
            F.min("near").alias("near")
        )
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        stepped = checkpointed(
            lower.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        )
        labels = stepped.select("v", "label")
        if stepped.filter("label < old").isEmpty():
            return labels
