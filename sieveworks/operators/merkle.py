"""Merkle trees over named hashes, level by level.

A leaf is a name (a file's, a row's key) and its hash. Its place is the SHA-256 of the
name, so the tree is the same whatever the order of leaves, and a node has
at most 16 children however names are chosen. A node at level L stands for the leaves whose place
begins with its L hex digits; the deepest level is chosen by the number of leaves. A node's digest is that of its
children's, each with its length before it. One changed leaf changes the digests on one path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

#: Leaves that a node of the deepest level stands for, on average.
LEAVES = 16


def _digest(items: Column) -> Column:
    """SHA-256 of texts in order, each with its length in bytes before it."""
    return keys.sha(F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), ""))


def depth_of(leaves: int) -> int:
    """Levels below the root for a number of leaves."""
    return max(1, math.ceil(math.log(max(leaves, 1) / LEAVES, 16))) if leaves > LEAVES else 1


def leaves_of(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """``place, name, digest``; null names count as empty, equal leaves as often as they are."""
    own = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return rows.select(keys.sha(own).alias("place"), own.alias("name"), F.coalesce(F.col(digest).cast("string"), F.lit("")).alias("digest"))


def _above(nodes: DataFrame) -> DataFrame:
    up = F.substring(F.col("node"), F.lit(1), F.length("node") - 1)
    children = F.collect_list(F.concat("node", F.lit("="), "digest"))  # at most 16
    return nodes.groupBy(up.alias("up")).agg(F.sum("leaves").alias("leaves"), _digest(children).alias("digest")).withColumnRenamed("up", "node")


def _deepest(leaves: DataFrame, depth: int) -> DataFrame:
    items = F.collect_list(F.concat("name", F.lit("="), "digest"))
    return leaves.groupBy(F.substring("place", 1, depth).alias("node")).agg(F.count("*").alias("leaves"), _digest(items).alias("digest"))


def tree(leaves: DataFrame, depth: int) -> DataFrame:
    """All nodes: ``level, node, leaves, digest``; the root is level 0 and node "". No leaves give no nodes."""
    nodes = _deepest(leaves, depth)
    out = nodes.withColumn("level", F.lit(depth))
    for level in range(depth - 1, -1, -1):
        nodes = _above(nodes)
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select("level", "node", "leaves", "digest")


def updated(before: DataFrame, leaves: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """The tree after the leaves with the names of ``changed`` have changed, come or gone: only their paths are hashed again.

    ``leaves`` are all leaves as they are now; of these only those that share a deepest node with a change are read on.
    """
    touched = changed.select(F.substring(keys.sha(F.coalesce(F.col("name").cast("string"), F.lit(""))), 1, depth).alias("node")).distinct()
    near = leaves.join(touched.withColumnRenamed("node", "_own"), F.substring("place", 1, depth) == F.col("_own"), "left_semi")
    new = _deepest(near, depth).withColumn("level", F.lit(depth))
    for level in range(depth, -1, -1):
        old = before.where(F.col("level") == level)
        own = touched.select(F.substring(F.col("node"), F.lit(1), F.lit(level)).alias("node")).distinct()
        if level < depth:
            # children of a touched node: those hashed again, and the others as they were
            below = out.where(F.col("level") == level + 1)
            up = F.substring(F.col("node"), F.lit(1), F.lit(level))
            new = _above(below.join(own.withColumnRenamed("node", "_own"), up == F.col("_own"), "left_semi").select("node", "leaves", "digest")).withColumn("level", F.lit(level))
        kept = old.join(own, "node", "left_anti")
        layer = kept.select("level", "node", "leaves", "digest").unionByName(new.select("level", "node", "leaves", "digest"))
        out = layer if level == depth else out.unionByName(layer)
    return out


def differing(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Nodes whose digests differ or that one tree lacks, found from the root down: ``level, node``.

    A level is compared below nodes that differ only, so equal parts of the trees are not read.
    """
    out, above = None, None
    for level in range(depth + 1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("digest").alias(c)) for t, c in ((a, "x"), (b, "y")))
        if above is not None:
            up = F.substring(F.col("node"), F.lit(1), F.lit(level - 1))
            x, y = (t.join(above.withColumnRenamed("node", "up"), up == F.col("up"), "left_semi") for t in (x, y))
        above = x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        out = above.withColumn("level", F.lit(level)) if out is None else out.unionByName(above.withColumn("level", F.lit(level)))
    return out.select("level", "node")
