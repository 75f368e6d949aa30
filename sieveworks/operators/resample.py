"""Paired bootstrap with array-valued sums: replicates are elements of vectors, not rows.

The pairs of a bucket are numbered and cut into blocks of at most ``BLOCK``. A task
holds one block and returns one vector of sums for each metric, one element a replicate; vectors are
added element by element. Nothing is multiplied by the number of
replicates on its way through the network but one vector for each block.

A replicate draws as many pairs of a bucket as it has, with replacement. How
many of them fall into each block is drawn by splitting the blocks in halves
(binomially, from the seed, bucket and half, so all tasks agree); inside a block, draw ``s`` of replicate ``r`` is pair
``mix(mix(mix(seed ^ r) ^ block hash) ^ s) mod n``. Together that is a draw from all pairs of the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import bucket_place

BLOCK = 1 << 16
#: Vectors that meet in one task at a first step of adding up.
FAN_IN = 64
MASK = np.uint64(0xFFFFFFFF)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 32-bit numbers held in 64 bits (fixed constants)."""
    x = x.astype(np.uint64)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & MASK
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & MASK
    return x ^ (x >> np.uint64(16))


def draws_of_block(total: int, block: int, replicates: int, seed: int, bucket_hash: int) -> np.ndarray:
    """How many of each replicate's ``total`` draws fall into a block."""
    left, right, node = 0, -(-total // BLOCK), 1
    drawn = np.full(replicates, total, np.int64)
    while right - left > 1:
        middle = (left + right) // 2
        size, first = min(right * BLOCK, total) - left * BLOCK, (middle - left) * BLOCK
        rng = np.random.Generator(np.random.Philox(key=np.array([(seed << 32) ^ bucket_hash, node], np.uint64)))
        lower = rng.binomial(drawn, first / size)
        if block < middle:
            drawn, right, node = lower, middle, 2 * node
        else:
            drawn, left, node = drawn - lower, middle, 2 * node + 1
    return drawn


def block_sums(values: np.ndarray, drawn: np.ndarray, seed: int, block_hash: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the values that each replicate draws, the plain ones last; values are (metric, pair), NaN counts as none."""
    there = ~np.isnan(values)
    filled, n = np.where(there, values, 0.0), values.shape[1]
    sums, counts = np.zeros((len(values), len(drawn) + 1)), np.zeros((len(values), len(drawn) + 1))
    slots = np.arange(drawn.max(initial=0), dtype=np.uint64)
    starts = mix32(mix32(np.uint64(seed) ^ np.arange(len(drawn), dtype=np.uint64)) ^ np.uint64(block_hash))
    whole = bool(there.all())
    for r, start in enumerate(starts):
        # how often each pair is drawn, then all metrics at once
        times = np.bincount((mix32(slots[:drawn[r]] ^ start) % np.uint64(n)).astype(np.int64), minlength=n)
        sums[:, r] = filled @ times
        counts[:, r] = drawn[r] if whole else there @ times
    sums[:, -1], counts[:, -1] = filled.sum(axis=1), there.sum(axis=1)
    return sums, counts


def _added(rows: DataFrame, by: Sequence[str], vectors: Sequence[str], size: int, spread: Column) -> DataFrame:
    """Vectors added element by element, in two steps."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = lambda c: F.aggregate(F.collect_list(c), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias(c)
    part = rows.withColumn("_spread", spread).groupBy(*by, "_spread").agg(*map(total, vectors))
    return part.groupBy(*by).agg(*map(total, vectors))


def quantile(values: Column, share: float) -> Column:
    """Linear interpolation between the sorted values that are not null; null where there are none."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    place = (F.size(ordered) - 1) * F.lit(share)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return F.when(F.size(ordered) > 0, a + (b - a) * (place - low))


def bootstrap(pairs: DataFrame, bucket: str, order: Sequence[str], deltas: Sequence[str], replicates: int = 2000, seed: int = 37101, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Paired bootstrap stratified by bucket: ``metric, delta, ci_low, ci_high``.

    ``deltas`` are columns of differences, which share their draws. A replicate's
    value is the mean over buckets of the drawn means. Null differences are left out of the
    means; no pairs give no rows.
    """
    names = list(dict.fromkeys(deltas))
    placed = bucket_place(pairs.select(bucket, *dict.fromkeys([*order, *names])), bucket, order, "_nth").withColumnRenamed("_nth", "_place")
    sizes = pairs.groupBy(F.col(bucket).alias("_of")).agg(F.count("*").alias("_n"))  # one row per bucket
    rows = placed.join(sizes, F.col(bucket).eqNullSafe(F.col("_of")))
    rows = rows.withColumn("_block", F.floor(F.col("_place") / BLOCK).cast("long"))
    hash_of = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    name = F.coalesce(F.col(bucket).cast("string"), F.lit(""))
    rows = rows.withColumns({"_bucket_hash": hash_of(name), "_block_hash": hash_of(F.concat(name, F.lit(":"), F.col("_block").cast("string")))})
    values = rows.select(name.alias("_bucket"), F.col(bucket).isNull().alias("_null"), "_block", "_place", "_n", "_bucket_hash", "_block_hash", *(F.col(d).cast("double").alias(f"_d{k}") for k, d in enumerate(names)))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        first = group.iloc[0]
        drawn = draws_of_block(int(first["_n"]), int(first["_block"]), replicates, seed, int(first["_bucket_hash"]))
        found, counts = block_sums(group[[f"_d{k}" for k in range(len(names))]].to_numpy(np.float64).T, drawn, seed, int(first["_block_hash"]))
        return pd.DataFrame({"bucket": first["_bucket"], "no_bucket": first["_null"], "block": first["_block"], "metric": names, "sums": list(found), "counts": list(counts)})

    blocks = values.groupBy("_bucket", "_null", "_block").applyInPandas(sums, "bucket string, no_bucket boolean, block long, metric string, sums array<double>, counts array<double>")
    size = replicates + 1
    by_bucket = _added(blocks, ["bucket", "no_bucket", "metric"], ["sums", "counts"], size, F.floor(F.col("block") / FAN_IN))
    means = F.zip_with("sums", "counts", lambda s, n: F.try_divide(s, n))
    by_bucket = by_bucket.select("bucket", "metric", means.alias("m")).select(
        "bucket", "metric", F.transform("m", lambda x: F.coalesce(x, F.lit(0.0))).alias("sums"), F.transform("m", lambda x: x.isNotNull().cast("double")).alias("counts"))
    macro = _added(by_bucket, ["metric"], ["sums", "counts"], size, F.pmod(F.xxhash64("bucket"), F.lit(FAN_IN))).select("metric", means.alias("m"))
    drawn = F.slice("m", 1, replicates)
    return macro.select("metric", F.element_at("m", -1).alias("delta"), quantile(drawn, low).alias("ci_low"), quantile(drawn, high).alias("ci_high"))
