"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Renamings of nodes that are broadcast (two numbers each), else joined by a shuffle.
BROADCAST_NODES = 300_000


def components(edges: DataFrame, src: str = "a", dst: str = "b", rounds: list[int] | None = None) -> DataFrame:
    """The smallest node of each node's component: ``node, component``.

    Every round ranks the nodes by a hash of its own, joins each node to the
    first of itself and its neighbours, and to that one's first, and contracts
    the graph: edges are renamed, edges inside a merged group and repeated edges
    go. As ranks are drawn anew, a fixed share of the nodes is merged in each
    round whatever the ids are, so the rounds grow with the logarithm of the
    nodes, also on chains. Nodes without an edge do not appear; edges may repeat
    and need not be ordered. Only counts reach the driver, and every round's
    tables are written to the shared folder, so lost executors cost one round at
    most, and the planner's size estimates do not multiply from round to round.
    ``rounds`` takes the number of edges left after each.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = stored(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*ordered(F.col(src), F.col(dst))).distinct())
    labels, number = None, 0
    while True:
        rank = lambda node: F.struct(F.xxhash64(F.lit(number), node).alias("rank"), node.alias("node"))  # noqa: E731, B023
        both = left.select(F.col("a").alias("node"), "b").unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
        near = both.groupBy("node").agg(F.min(rank(F.col("b"))).alias("first"))
        near = stored(near.select("node", F.least(rank(F.col("node")), F.col("first"))["node"].alias("parent")))
        few = near.count() <= BROADCAST_NODES
        small = F.broadcast if few else (lambda df: df)
        jump = near.select(F.col("node").alias("via"), F.col("parent").alias("further"))
        merged = stored(near.join(small(jump), near["parent"] == jump["via"]).select("node", F.col("further").alias("parent")))
        if labels is None:
            labels = merged.select("node", F.col("parent").alias("component"))
        else:
            step = merged.select(F.col("node").alias("component"), "parent")
            labels = stored(labels.join(small(step), "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        renamed = left.join(small(merged.select(F.col("node").alias("a"), F.col("parent").alias("x"))), "a").join(small(merged.select(F.col("node").alias("b"), F.col("parent").alias("y"))), "b")
        left = stored(renamed.where(F.col("x") != F.col("y")).select(*ordered(F.col("x"), F.col("y"))).distinct())
        number += 1
        more = left.count()
        if rounds is not None:
            rounds.append(more)
        if not more:
            break
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
