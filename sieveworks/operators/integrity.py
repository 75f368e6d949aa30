"""Set audits, disjointness, coverage, message contracts, manifests and gates of frozen inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("target_smiles", "target_canonical_smiles", "policy_target_smiles", "assistant_response", "target")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: ``key, side`` (missing_right or missing_left)."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(key, F.when(F.col("_b").isNull(), "missing_right").otherwise("missing_left").alias("side"))


def overlaps(named: DataFrame, name: str, key: str) -> DataFrame:
    """How many keys each pair of named sets has in common: ``left, right, n``; empty if all are disjoint.

    Sets meet through their keys, so only names of one key are paired.
    """
    sets = named.select(key, name).distinct().groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)
    n = F.size("names")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(F.get("names", i).alias("left"), F.get("names", j).alias("right")))))
    return sets.select(F.explode(pairs).alias("p")).select("p.*").groupBy("left", "right").agg(F.count("*").alias("n"))


def coverage(found: DataFrame, required: DataFrame, least: int, key: str = "item", count: str = "n") -> DataFrame:
    """Required keys with their counts (0 if absent) and whether they reach the minimum."""
    out = F.broadcast(required.select(key).distinct()).join(found.select(key, count), key, "left")
    n = F.coalesce(F.col(count), F.lit(0))
    return out.select(key, n.alias(count), (n >= least).alias("enough"))


def is_balanced(counts: DataFrame, count: str, total: int | None = None) -> DataFrame:
    """One row: buckets, rows, and whether all buckets are of one size (and add up to ``total``)."""
    out = counts.agg(F.count("*").alias("buckets"), F.coalesce(F.sum(count), F.lit(0)).alias("rows"), F.min(count).alias("least"), F.max(count).alias("most"))
    even = F.col("least").eqNullSafe(F.col("most"))
    return out.withColumn("balanced", even if total is None else even & (F.col("rows") == total))


def candidate_integrity(rows: DataFrame, expected: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """One row: rows, distinct keys, rows by mode, keys missing and extra, and whether all agree."""
    keys = list(keys)
    mine = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    want = expected.select(*keys).distinct().withColumn("_w", F.lit(True))
    joined = mine.join(want, keys, "full_outer")
    out = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("_n").alias("keys"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra"),
        F.coalesce(F.sum(F.when(F.col(mode) == "de_novo", F.col("_n"))), F.lit(0)).alias("de_novo_rows"), F.coalesce(F.sum(F.when(F.col(mode) == "edit", F.col("_n"))), F.lit(0)).alias("edit_rows"),
    )
    return out.withColumn("intact", (F.col("rows") == F.col("keys")) & (F.col("missing") == 0) & (F.col("extra") == 0))


def roles_are(messages: Column, roles: Sequence[str]) -> Column:
    """Whether the turns have exactly these roles, with text in each."""
    return F.coalesce((F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, roles))) & F.forall(messages, lambda m: F.length(F.trim(m["content"])) > 0), F.lit(False))


def is_target_blind(messages: Column, payload: Column, columns: Sequence[str] = ()) -> Column:
    """No assistant turn, no forbidden key in the payload, and no forbidden column."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    clear = ~F.arrays_overlap(keys, F.array(*map(F.lit, FORBIDDEN))) & ~F.exists(messages, lambda m: m["role"] == "assistant")
    return F.lit(not set(columns) & set(FORBIDDEN)) & F.coalesce(clear, F.lit(False))


def nonfinite_counts(values: DataFrame, by: str, value: str) -> DataFrame:
    """How many values of each tensor are null, NaN or infinite."""
    v = F.col(value)
    return values.groupBy(by).agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("nonfinite"))


def missing_oracles(programs: DataFrame, program: str, available: Sequence[str]) -> DataFrame:
    """Properties that programs ask for and no oracle gives."""
    # a plain explode would have the program computed again at the scan, to see whether it is empty
    asked = programs.select(F.posexplode_outer(program).alias("place", "c")).where("place IS NOT NULL")
    return asked.select(F.col("c.property").alias("property")).distinct().where(~F.col("property").isin(*available))


def content_manifest(rows: DataFrame, part: Sequence[str], key: str, content: str) -> DataFrame:
    """Rows and one digest of each part, whatever the order of its rows.

    Row hashes are added as numbers, so parts of any size need no sort.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(content)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*part).agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))


def parameter_ratio(joint: Column, separate: Sequence[Column]) -> Column:
    """Joint parameters over those of the separate models together."""
    total = separate[0]
    for s in separate[1:]:
        total = total + s
    return F.try_divide(joint.cast("double"), total.cast("double"))


def external_result_ok(rows: DataFrame, task: str, tasks: Sequence[str], groups: str, candidates: str, evaluable: str) -> DataFrame:
    """One row: whether the result holds every task and "all" once, one candidate for each input, all evaluable."""
    want = sorted([*tasks, "all"])
    return rows.agg(F.array_sort(F.collect_list(task)).alias("t"), F.bool_and(F.col(groups) == F.col(candidates)).alias("one_each"), F.bool_and(F.col(evaluable) == 1.0).alias("evaluable")).select(
        (F.col("t") == F.array(*map(F.lit, want))).alias("tasks_ok"), "one_each", "evaluable", (F.col("one_each") & F.col("evaluable") & (F.col("t") == F.array(*map(F.lit, want)))).alias("ok"))


def external_results_ok(rows: DataFrame, result: str, task: str, tasks: Sequence[str], groups: str, candidates: str, evaluable: str) -> DataFrame:
    """The same for many results at once: ``result, tasks_ok, one_each, evaluable, ok``."""
    want = [*tasks, "all"]
    # counts, not lists: a result that repeats a task has more rows than tasks
    by = rows.groupBy(result).agg(
        F.count("*").alias("_n"), F.count_distinct(F.when(F.col(task).isin(*want), F.col(task))).alias("_known"),
        F.coalesce(F.bool_and(F.col(groups) == F.col(candidates)), F.lit(False)).alias("one_each"), F.coalesce(F.bool_and(F.col(evaluable) == 1.0), F.lit(False)).alias("evaluable"))
    ok = (F.col("_n") == len(want)) & (F.col("_known") == len(want))
    return by.select(result, ok.alias("tasks_ok"), "one_each", "evaluable", (ok & F.col("one_each") & F.col("evaluable")).alias("ok"))


def freeze(rows: DataFrame, bucket: str, sizes: dict[str, int], key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Exactly sized buckets in key order and their manifest; raises where a bucket differs from its size."""
    from .selection import by_quota

    spark = rows.sparkSession
    quotas = spark.createDataFrame(list(sizes.items()), "bucket string, quota int")
    frozen = by_quota(rows, quotas, [key], bucket, exact=True)
    return frozen, content_manifest(frozen, [bucket], key, content)
