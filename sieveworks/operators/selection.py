"""Leakage checks, first-seen dedup, quotas, splits, caps and bucket assignment.

"First" always refers to an explicit order column: rows of a DataFrame have no
order of their own. Ranks are windows over hash keys; with a rank limit Spark
prunes them before the shuffle (WindowGroupLimit), so a hot bucket costs its
quota, not its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, programs

#: Keys of passages that are broadcast (two numbers each, 800 kB in all), else joined by a shuffle.
BROADCAST_RUNS = 50_000
#: Characters by which passages of one or two words are looked up.
TINY = 16


def drop_leaks(rows: DataFrame, held_out: DataFrame, columns: Sequence[str], key: str = "key") -> DataFrame:
    """Rows none of whose key columns is in the held-out keys; Spark picks the join by size."""
    held_out = held_out.select(key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    for c in columns:
        rows = rows.join(held_out.withColumnRenamed(key, c), c, "left_anti")
    return rows


def containing(docs: DataFrame, passages: DataFrame, id_col: str, text_col: str, passage_col: str, width: int = 5) -> DataFrame:
    """Ids of texts that contain a passage, by an equi-join on hashed runs, not all pairs.

    The words of a passage other than its first and last stand in the text
    exactly, so the run of up to ``width`` words from the second on does. A
    passage of one or two words has no inner word, but its first ``TINY``
    characters stand in the text. Runs are looked up by 64-bit hashes, of which each text sends a
    distinct one once, and hits are confirmed on the text. Each length of a run costs a pass over the
    text, and there are at most ``width + TINY`` of them.
    """
    own = passages.select(F.col(passage_col).alias("passage")).where(F.length("passage") > 0).distinct().withColumn("w", F.split("passage", r"\s+"))
    inner, chars = F.least(F.size("w") - 2, F.lit(width)), F.least(F.length("passage"), F.lit(TINY))
    own = own.withColumn("size", F.when(inner >= 1, inner).otherwise(-chars))  # below 0: characters
    text_of = F.when(F.col("size") >= 1, F.array_join(F.slice("w", 2, F.greatest(F.col("size"), F.lit(1))), " ")).otherwise(F.substring(F.col("passage"), F.lit(1), -F.col("size")))
    runs = own.select("passage", F.xxhash64("passage").alias("pid"), "size", F.xxhash64("size", text_of).alias("run"))
    sizes = [r[0] for r in runs.select("size").distinct().collect()]  # at most width + TINY numbers

    def grams_of(size: int) -> Column:
        units, glue, n = ("w", " ", size) if size > 0 else ("c", "", -size)
        starts = F.sequence(F.lit(1), F.size(units) - n + 1)
        grams = F.transform(starts, lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(units, i, F.lit(n)), glue)))
        return F.when(F.size(units) >= n, grams).otherwise(F.array().cast("array<bigint>"))

    # a hash set of longs; of structs it would compare all with all
    grams = F.array_distinct(F.concat(*(grams_of(size) for size in sizes))) if sizes else F.array().cast("array<bigint>")
    cut = docs.select(id_col, F.split(text_col, r"\s+").alias("w"), (F.split(text_col, "") if any(size < 0 for size in sizes) else F.array()).alias("c"))
    keys_ = runs.select("run", "pid")
    near = cut.select(id_col, F.explode(grams).alias("run")).join(F.broadcast(keys_) if keys_.count() <= BROADCAST_RUNS else keys_, "run").select(id_col, "pid").distinct()
    hit = near.join(runs.select("pid", "passage"), "pid").join(docs.select(id_col, text_col), id_col)
    return hit.where(F.contains(text_col, "passage")).select(id_col).distinct()


def first_seen(rows: DataFrame, key: Column, order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def smallest(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], quota: int | Column, rank_col: str | None = None) -> DataFrame:
    """The first ``quota`` rows of each bucket."""
    name = rank_col or "_rank"
    out = rows.withColumn(name, F.row_number().over(W.partitionBy(*bucket).orderBy(*order))).where(F.col(name) <= quota)
    return out if rank_col else out.drop(name)


def quota_table(spark, buckets: Sequence[str], total: int) -> DataFrame:
    """``bucket, quota``: an even split, the remainder to the first buckets."""
    if not buckets or total < len(buckets):
        raise ValueError("at least one row for each bucket is needed")
    base, more = divmod(total, len(buckets))
    return spark.createDataFrame([(b, base + (k < more)) for k, b in enumerate(buckets)], "bucket string, quota int")


def quota_split(rows: DataFrame, bucket: str, total: Column | int) -> DataFrame:
    """The same for the buckets of a table, in their order: ``bucket, quota``; ``total`` may use their number ``n``."""
    numbered = global_place(rows.select(F.col(bucket).alias("bucket")).distinct(), ["bucket"], "_i")
    numbered = numbered.join(F.broadcast(numbered.agg(F.count("*").alias("n"))))  # one row
    total = F.lit(total) if isinstance(total, int) else total
    return numbered.select("bucket", (F.floor(total / F.col("n")) + (F.col("_i") < total % F.col("n")).cast("int")).cast("int").alias("quota"))


def by_quota(rows: DataFrame, quotas: DataFrame, order: Sequence[Column | str], bucket: str = "bucket", exact: bool = False) -> DataFrame:
    """The first rows of each bucket up to its own quota; with ``exact``, raises where rows lack."""
    quotas = quotas.withColumnRenamed("bucket", bucket)
    most = quotas.agg(F.max("quota")).first()[0] or 0
    # the fixed bound lets Spark cut each task's rows before the shuffle
    ranked = smallest(rows, [bucket], order, most, "_rank").join(quotas, bucket)
    if exact:
        have = rows.groupBy(bucket).count()
        short = quotas.join(have, bucket, "left").where(F.coalesce("count", F.lit(0)) < F.col("quota")).limit(1).collect()
        if short:
            raise ValueError(f"too few rows for {short[0][bucket]}")
    return ranked.where("_rank <= quota").drop("_rank", "quota")


def cutoffs(rows: DataFrame, bucket: str, key: str, quota: int) -> DataFrame:
    """Each bucket's key at the quota: ``bucket, kept, cutoff``."""
    kept = smallest(rows.select(bucket, key), [bucket], [key], quota)
    return kept.groupBy(bucket).agg(F.count("*").alias("kept"), F.max(key).alias("cutoff"))


def split_two(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], per_split: int, names: tuple[str, str] = ("dev", "final")) -> DataFrame:
    """Two disjoint splits of each bucket: ranks 1..k and k+1..2k."""
    out = smallest(rows, bucket, order, 2 * per_split, "_rank")
    return out.withColumn("split", F.when(F.col("_rank") <= per_split, names[0]).otherwise(names[1])).drop("_rank")


def balanced_gate(rows: DataFrame, identity: Column, bucket: Sequence[str], order: Sequence[Column | str], per_bucket: int) -> DataFrame:
    """First-seen rows by identity, then the first of each bucket."""
    return smallest(first_seen(rows, identity, order), bucket, order, per_bucket)


def hash_bucket(digest: Column, least: int, buckets: int) -> Column:
    """A bucket from a hash, independent of other rows."""
    return keys.rank_mod(digest, buckets, least)


def hashed_subset(items: Column, material: Column, size: int | Column) -> Column:
    """The ``size`` items with the smallest hash of ``material:item``, in program order."""
    # structs are never null, so this is the order of array_sort, without its interpreted comparisons
    keyed = F.sort_array(programs.once(material, lambda m: F.transform(items, lambda x: F.struct(keys.sha(F.concat(m, F.lit(":"), x)).alias("h"), x.alias("x")))))
    chosen = F.transform(F.slice(keyed, 1, size), lambda s: F.struct(programs.place_of(s["x"]).alias("p"), s["x"].alias("x")))
    return F.transform(F.sort_array(chosen), lambda s: s["x"])


def greedy_buckets(rows: DataFrame, order: str, feasible: str, material: str, buckets: Sequence[int], group: str | None = None) -> DataFrame:
    """Each row, in order, to its least-populated feasible bucket (ties by hash): adds ``bucket``.

    Every choice depends on all earlier ones, so the rows of a group form one
    sequence. ``group`` splits the rows into independent sequences that run in
    parallel; ``hash_bucket`` is the alternative without any order. The rows
    stream through the task: it holds one counter per bucket.
    """
    import hashlib

    import pandas as pd

    group_col = F.col(group) if group else F.lit(0)
    columns = rows.columns
    dealt = rows.withColumn("_group", group_col)
    parts = dealt.repartition("_group") if group else dealt.repartition(1)
    names = list(buckets)

    def assign(batches):
        own, counts = None, {}
        for batch in batches:
            chosen = []
            for g, options, text in zip(batch["_group"], batch[feasible], batch[material]):
                if g != own:
                    own, counts = g, dict.fromkeys(names, 0)
                pick = min(options, key=lambda b: (counts[b], hashlib.sha256(f"{text}:bucket:{b}".encode()).hexdigest()), default=None)
                if pick is not None:
                    counts[pick] += 1
                chosen.append(pick)
            yield batch[columns].assign(bucket=pd.array(chosen, dtype="Int32"))

    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
    return parts.sortWithinPartitions("_group", order).mapInPandas(assign, schema)


def round_robin_shards(rows: DataFrame, order: Sequence[str], shards: int, total: int | None = None) -> DataFrame:
    """Adds ``shard`` = place in order modulo the number of shards."""
    place = global_place(rows, order)
    if total is not None:
        place = place.where(F.col("place") < total)
    return place.withColumn("shard", (F.col("place") % shards).cast("int"))


def global_place(rows: DataFrame, order: Sequence[Column | str], place_col: str = "place") -> DataFrame:
    """Adds the row's place (from 0) in a total order, without bringing all rows to one task.

    Rows are sorted by range and numbered inside their partition; the counts of
    the partitions before give the rest. Only those counts meet in one task.
    """
    from ..sources.tables import checkpointed

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", "_first", before.alias("_before")))  # one row per partition
    place = F.col("_before") + F.col("_id") - F.col("_first")
    return ranged.join(starts, "_part").withColumn(place_col, place).drop("_part", "_id", "_first", "_before")


def bucket_place(rows: DataFrame, bucket: str, order: Sequence[Column | str], place_col: str = "place") -> DataFrame:
    """Adds the row's place (from 0) inside its bucket, however many rows a bucket has."""
    placed = global_place(rows, [F.col(bucket), *order], "_place")
    starts = placed.groupBy(F.col(bucket).alias("_of")).agg(F.min("_place").alias("_start"))  # one row per bucket
    out = placed.join(starts, F.col(bucket).eqNullSafe(F.col("_of")))
    return out.withColumn(place_col, F.col("_place") - F.col("_start")).drop("_place", "_start", "_of")


def outcome_counts(rows: DataFrame, outcome: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each audit outcome."""
    return rows.groupBy(*by, outcome.alias("outcome")).agg(F.count("*").alias("n"))


def eligible_pair(source: Column, target: Column, similarity: Column, flags: Sequence[Column], active: Column, least: float = 0.15) -> Column:
    """Whether an edit pair may be used: flags say yes, both texts differ and stand, near enough, with an active property."""
    ok = (source != "") & (target != "") & (source != target) & F.coalesce(similarity.try_cast("double") >= least, F.lit(False)) & (F.size(active) > 0)
    for f in flags:
        ok = ok & (f.isNull() | (F.trim(f) == "") | programs.truthy(f))
    return F.coalesce(ok, F.lit(False))
