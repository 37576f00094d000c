"""Connected components by minimum labels with shortcuts, as Spark joins.

Each round gives a vertex the smallest label around it and then the label of
its label, so long chains halve.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.plans.storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for each vertex of the undirected ``links`` (columns a, b).

    ``component`` is the smallest id reachable.  Vertices without links are not listed.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        new = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        roots = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        new = materialize(
            new.join(roots, "new", "left").select("id", F.least("new", "up").alias("component"), F.col("component").alias("old")),
            "labels",
        )
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        if not changed:
            discard(both)
            return labels
