"""Connected components over hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.session import cut_lineage


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(surface, root): the smallest surface each one is connected to.

    Each round a hub takes the smallest label of its members and members take the smallest of
    their hubs, then every label is replaced by its own label, which doubles the reach. Both
    steps are minimums combined before the shuffle. Every round is written to the checkpoint
    folder; the loop ends when no label changes.
    """
    links = cut_lineage(links.select("surface", "hub"))
    labels = cut_lineage(nodes.select("surface", F.col("surface").alias("root")).distinct())
    for _ in range(max_rounds):
        hubs = links.join(labels, "surface").groupBy("hub").agg(F.min("root").alias("h"))
        heard = links.join(hubs, "hub").groupBy("surface").agg(F.min("h").alias("h"))
        moved = labels.join(heard, "surface", "left").select("surface", F.col("root").alias("old"), F.least("root", "h").alias("root"))
        jump = moved.select(F.col("surface").alias("root"), F.col("root").alias("far"))
        nxt = cut_lineage(moved.join(jump, "root", "left").select("surface", "old", F.least("root", "far").alias("root")))
        changed = nxt.filter("old <> root").limit(1).count()
        labels = nxt.select("surface", "root")
        if changed == 0:
            return labels
    raise RuntimeError("labels still change; raise max_rounds")
