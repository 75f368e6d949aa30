"""Deterministic training schedules: interleaving, rounds, batches and proportional passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from .selection import bucket_place, global_place, smallest


def _numbered(rows: DataFrame, by: str, order: Sequence) -> DataFrame:
    return bucket_place(rows, by, order, "_pos")


def interleave(rows: DataFrame, mode: str, modes: Sequence[str], order: Sequence, strict: bool = False) -> DataFrame:
    """Modes by turns, the longer tail after; ``turn`` and ``turn_mode`` give the order. ``strict`` raises on unequal modes."""
    if strict:
        sizes = {r[mode]: r["count"] for r in rows.where(F.col(mode).isin(*modes)).groupBy(mode).count().collect()}
        if len({sizes.get(m, 0) for m in modes}) != 1:
            raise ValueError(f"modes of unequal size: {sizes}")
    rank = F.array_position(F.array(*map(F.lit, modes)), F.col(mode)) - 1
    out = _numbered(rows.where(F.col(mode).isin(*modes)), mode, order)
    return out.withColumnRenamed("_pos", "turn").withColumn("turn_mode", rank.cast("int"))


def shuffled(rows: DataFrame, identity: str, seed: int, name: str = "shuffle_key") -> DataFrame:
    """A reproducible shuffle: order by the hash of seed and identity."""
    return rows.withColumn(name, keys.stable_key(seed, F.col(identity)))


def rounds(rows: DataFrame, bucket: str, identity: str, n_rounds: int, seed: int) -> DataFrame:
    """One row of each bucket in each round, buckets shuffled anew every round: adds ``round, slot``."""
    out = smallest(rows, [bucket], [keys.stable_key(seed, F.col(identity)), identity], n_rounds, "_pos").withColumn("_pos", F.col("_pos") - 1)
    slot_key = keys.sha(F.concat((F.lit(seed) + F.col("_pos")).cast("string"), F.lit(":"), F.col(bucket)))
    out = out.withColumn("_k", slot_key).withColumn("slot", F.row_number().over(W.partitionBy("_pos").orderBy("_k", bucket)) - 1)
    return out.withColumnRenamed("_pos", "round").drop("_k")


def batches(rows: DataFrame, bucket: str, order: Sequence, batch: int) -> DataFrame:
    """Batches of one bucket each, buckets by turns, equally many of each; remainders go: adds ``batch_round, pos``."""
    least = rows.groupBy(bucket).count().agg(F.min("count").alias("_least"))
    out = _numbered(rows, bucket, order).join(F.broadcast(least))  # one row
    return out.where(F.col("_pos") < F.floor(F.col("_least") / batch) * batch).withColumn("batch_round", F.floor(F.col("_pos") / batch).cast("long")).withColumnRenamed("_pos", "pos").drop("_least")


def proportional(rows: DataFrame, bucket: str, order: Sequence) -> DataFrame:
    """One pass in which every bucket advances in proportion: adds ``pos, merge_key``; order by merge_key, bucket, pos."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n"))  # one row a bucket
    out = _numbered(rows, bucket, order).join(sizes, bucket)
    return out.withColumn("merge_key", (F.col("_pos") + 0.5) / F.col("_n")).withColumnRenamed("_pos", "pos").drop("_n")


def zipped(left: DataFrame, right: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of equally ranked rows; ``pair, left_*, right_*``."""
    side = lambda df, name: global_place(df, [order], "pair").select(*(F.col(c).alias(f"{name}_{c}") for c in columns), "pair")
    return side(left, "left").join(side(right, "right"), "pair")


def balanced_pairs(rows: DataFrame, mode: str, bucket: str, identity: str, buckets: dict[str, Sequence[str]], pairs: int, seed: int) -> DataFrame:
    """Equally many rows of each bucket in both modes, shuffled and zipped to pairs: ``pair, left_*, right_*``."""
    if pairs <= 0 or any(pairs % len(b) for b in buckets.values()):
        raise ValueError("pairs must be a positive multiple of both numbers of buckets")
    sides = []
    for offset, (m, names) in enumerate(buckets.items()):
        own = rows.where((F.col(mode) == m) & F.col(bucket).isin(*names))
        chosen = smallest(own, [bucket], [keys.stable_key(seed + offset, F.col(identity)), identity], pairs // len(names))
        short = chosen.groupBy(bucket).count().where(F.col("count") < pairs // len(names)).count()
        if short or chosen.select(bucket).distinct().count() < len(names):
            raise ValueError(f"too few rows in a bucket of {m}")
        sides.append(shuffled(chosen, identity, seed + 10 + offset, "_shuffle"))
    return zipped(sides[0], sides[1], "_shuffle", [identity, bucket])
