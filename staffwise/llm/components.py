"""Connected components of an undirected edge table, as a few joins and aggregations per round.

Every node carries a label, at first its own id. A round sends the smaller label of a neighbour's
parent along each edge, both to the node and to the node's parent (hooking), and then replaces each
label by its label's label (shortcutting), so long chains shrink by a factor each round instead of
by one step. All sums are ``min`` with partial aggregation, so a node with very many edges is
combined before the shuffle; labels are stored in the shared folder after each round. Only a count
of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest reachable id.

    Null ends, loops and repeated edges are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    pairs, pairs_path = stored(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a < b").distinct(), "edges")
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels, path = stored(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        parent = labels.select(F.col("node").alias("p"), F.col("label").alias("grand"))
        seen = labels.join(parent, F.col("label") == F.col("p"), "left").select(
            "node", "label", F.coalesce("grand", "label").alias("grand"))
        sent = (both.join(seen.select(F.col("node").alias("v"), F.col("grand").alias("offer")), "v")
                .groupBy("u").agg(F.min("offer").alias("offer")))
        offers = seen.join(sent, seen.node == sent.u, "left").select("node", "label", "grand", "offer")
        best = F.least("label", "grand", "offer")
        moved = (offers.select("node", best.alias("label"))
                 .unionAll(offers.select(F.col("label").alias("node"), best.alias("label")))
                 .groupBy("node").agg(F.min("label").alias("label")))
        new, new_path = stored(
            moved.join(labels.select("node", F.col("label").alias("was")), "node"), "labels")
        changed = new.where("label < was").limit(1).count()
        forget(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not changed:
            forget(spark, pairs_path)
            return labels.select("node", F.col("label").alias("component"))
