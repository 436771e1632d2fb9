"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``edges`` (``a``, ``b``; long).

    Each round every node points to its smallest neighbour, or itself, and takes over where that one points. Edges
    are rewritten in these labels, and the ones inside a label go; a round leaves half the labels of a component at
    most. The smallest node always keeps itself, so it names the component. Edges and labels are written after each
    round; only the count of remaining edges comes to the driver. Hubs are minima, which combine before the shuffle.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        parents = both.groupBy("node").agg(F.min("other").alias("least")).select(
            "node", F.least("node", "least").alias("parent")
        )
        parents = stage(parents, "parents")
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("label"))
        jump = parents.join(up, "parent").select("node", "label")
        if labels is None:
            labels = stage(jump.select("node", F.col("label").alias("component")), "labels")
            jump = labels.withColumnRenamed("component", "label")
        else:
            jump = stage(jump, "jump")
            new = jump.select(F.col("node").alias("component"), "label")
            labels = stage(
                labels.join(new, "component", "left").select(
                    "node", F.coalesce("label", "component").alias("component")
                ),
                "labels",
            )
        ends = [jump.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")]
        edges = stage(
            edges.join(ends[0], "a").join(ends[1], "b")
            .select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
            .where("a < b").distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
