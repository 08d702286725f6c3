"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, rounds: int = 60, broadcast_nodes: int | None = None) -> DataFrame:
    """links: a, b (long). Per node of a link: node, component (the smallest node it reaches).

    Each round gives a node the least label among its neighbours and then the label of that label, so paths shorten by
    more than half. Each node is its own neighbour too, so a round has one shuffle of links beside the joins to labels,
    and none for these while the nodes, whose number is the same in every round, are few enough to be broadcast. Labels
    are a written table between rounds. A node with very many links costs no task of its own: its minimum is combined
    before the shuffle and joins split skewed keys. Empty links give an empty result; loops, repeated links and nulls
    are let go.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    ways = F.explode(F.expr("transform(array(array(a, b), array(b, a), array(a, a), array(b, b)), p -> struct(p[0] AS a, p[1] AS b))")).alias("x")
    both = common.cut(links.select(ways).select("x.a", "x.b").distinct())
    labels = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    few = labels.count() <= (common.BROADCAST_IDS if broadcast_nodes is None else broadcast_nodes)
    for _ in range(rounds):
        hint = F.broadcast if few else (lambda x: x)
        near = both.join(hint(labels.select(F.col("node").alias("b"), F.col("component").alias("c"))), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("c").alias("component"), F.max(F.when(F.col("a") == F.col("b"), F.col("c"))).alias("old"))
        jump = hint(labels.select(F.col("node").alias("component"), F.col("component").alias("next")))
        new = common.cut(near.join(jump, "component").select("node", "old", F.least("component", "next").alias("component")))
        moved = new.filter("old <> component").limit(1).count()
        common.forget(links.sparkSession, labels)
        labels = new.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components are still open after {rounds} rounds")
