"""Connected components by repeated minimum labels and edge contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import forget, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes that have an edge.

    Each round gives every node its smallest neighbour, follows these pointers
    once, and contracts the edges to the nodes pointed at; a round at least
    halves the nodes that are left in each component. Null ends are dropped;
    loops, repeated and reversed edges change nothing. State goes through the
    shared folder each round. Raises if ``rounds`` are not enough.
    """
    kept = edges.select("a", "b").where("a is not null and b is not null")
    nodes = kept.select(F.col("a").alias("node")).union(kept.select(F.col("b").alias("node"))).distinct()
    labels = saved(nodes.select("node", F.col("node").alias("component")), "labels")
    left = saved(kept.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if left.isEmpty():
            return labels
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        once = saved(near, "near")
        further = once.select(F.col("a").alias("via"), F.col("to").alias("next"))
        step = once.join(further, once["to"] == further["via"], "left").select("a", F.coalesce("next", "to").alias("to"))
        step = saved(step, "step")
        moved = step.select(F.col("a").alias("component"), F.col("to").alias("new"))
        were, labels = labels, saved(labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        rest = (
            left.join(step.select("a", F.col("to").alias("na")), "a", "left")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("nb")), "b", "left")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .where("a <> b")
            .distinct()
        )
        done, left = left, saved(rest, "edges")
        forget(were, once, step, done)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
