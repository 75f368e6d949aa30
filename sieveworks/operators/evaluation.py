"""Rates by bucket, pooled and macro means, group-relative statistics and support."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUPPORT_THRESHOLDS = {"strict_any": 0.05, "mixed": 0.20, "informative": 0.20, "top_strict": 0.70, "task_fraction": 0.70, "tasks": 10}
CLOSE = 1e-12


def rate(flag: str) -> Column:
    """Share of rows with the flag; null counts as no."""
    return F.avg(F.coalesce(F.col(flag).cast("double"), F.lit(0.0)))


def bucket_metrics(rows: DataFrame, by: Sequence[str], flags: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Rows, rates of flags and null-skipping means of each bucket."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(rate(f).alias(f"{f}_rate") for f in flags), *(F.avg(m).alias(f"mean_{m}") for m in means))


def bucket_and_total(rows: DataFrame, mode: str, bucket: str, flags: Sequence[str]) -> DataFrame:
    """Bucket rates and each mode's pooled rates in one pass; the total's bucket is null."""
    sets = rows.groupingSets([[F.col(mode), F.col(bucket)], [F.col(mode)]], F.col(mode), F.col(bucket))
    return sets.agg(F.count("*").alias("rows"), *(rate(f).alias(f"{f}_rate") for f in flags))


def mean_of(value: Column | str, on_empty: str = "null") -> Column:
    """Null-skipping mean; what no values give is said: ``zero``, ``null`` or ``error``."""
    mean = F.avg(value)
    if on_empty == "zero":
        return F.coalesce(mean, F.lit(0.0))
    if on_empty == "error":
        return F.when(mean.isNull(), F.raise_error(F.lit("no values")).cast("double")).otherwise(mean)
    return mean


def macro(bucket_rows: DataFrame, buckets: DataFrame, metrics: Sequence[str], bucket: str = "bucket", on_empty: str = "error") -> DataFrame:
    """Unweighted mean of bucket means over a fixed list of buckets.

    A missing bucket counts as 0 (``zero``), is left out (``null``) or raises (``error``).
    """
    joined = F.broadcast(buckets.select(bucket).distinct()).join(bucket_rows, bucket, "left")
    aggs = []
    for m in metrics:
        value = F.col(m)
        if on_empty == "zero":
            value = F.coalesce(value, F.lit(0.0))
        elif on_empty == "error":
            value = F.when(value.isNull(), F.raise_error(F.concat(F.lit("no rows for "), F.col(bucket))).cast("double")).otherwise(value)
        aggs.append(F.avg(value).alias(f"{m}_macro"))
    return joined.agg(*aggs)


def group_macro(bucket_rows: DataFrame, groups: DataFrame, metrics: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Macro means of named groups of buckets; a bucket may be in several. ``groups``: (group, bucket)."""
    return F.broadcast(groups).join(bucket_rows, bucket).groupBy("group").agg(F.count("*").alias("buckets"), *(F.avg(m).alias(f"{m}_macro") for m in metrics))


def group_statistics(rows: DataFrame, group: Sequence[str], reward: str, flags: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each group's rewards, and shares of flags."""
    return rows.groupBy(*group).agg(F.count("*").alias("size"), F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("reward_std"), *(rate(f).alias(f"{f}_fraction") for f in flags))


def group_support(candidates: DataFrame, group: Sequence[str], strict: str = "strict", hard: str = "hard_reward", soft: str = "soft_reward") -> DataFrame:
    """One row per group: size, any or mixed strict, informative rewards, and whether a strict one is among the best."""
    flag = F.coalesce(F.col(strict), F.lit(False))
    n = F.sum(flag.cast("int"))
    top = lambda r: F.when(n > 0, F.coalesce(F.max(F.when(flag, F.col(r))) >= F.max(r) - CLOSE, F.lit(False)))
    return candidates.groupBy(*group).agg(
        F.count("*").alias("size"), (n > 0).alias("strict_any"), ((n > 0) & (n < F.count("*"))).alias("mixed"),
        (F.max(hard) - F.min(hard) > CLOSE).alias("hard_informative"), (F.max(soft) - F.min(soft) > CLOSE).alias("soft_informative"),
        top(hard).alias("hard_top_strict"), top(soft).alias("soft_top_strict"),
    )


def support_summary(groups: DataFrame, task: str = "task_key") -> DataFrame:
    """Support of every task and, with null as task, of all groups together."""
    given = lambda c: F.avg(F.col(c).cast("double"))  # noqa: E731  null without support: left out
    return groups.rollup(task).agg(
        F.count("*").alias("groups"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), rate("strict_any").alias("strict_any_at_k"), rate("mixed").alias("mixed_rate"),
        rate("hard_informative").alias("hard_informative_rate"), rate("soft_informative").alias("soft_informative_rate"),
        given("hard_top_strict").alias("hard_top_given_support"), given("soft_top_strict").alias("soft_top_given_support"),
    )


def support_gate(summary: DataFrame, task: str = "task_key", thresholds: dict | None = None) -> DataFrame:
    """One row: the checks and the decision over a support summary."""
    t = SUPPORT_THRESHOLDS | (thresholds or {})
    own = F.col(task).isNotNull()
    total = lambda c: F.max(F.when(~own, F.col(c)))
    rows = summary.agg(
        total("strict_any_at_k").alias("strict_any_at_k"), total("mixed_rate").alias("mixed_rate"), total("hard_informative_rate").alias("hard_informative_rate"),
        total("hard_top_given_support").alias("hard_top_given_support"), F.sum(own.cast("int")).alias("task_count"),
        F.sum((own & (F.col("strict_any_at_k") >= t["strict_any"])).cast("int")).alias("supported_tasks"),
    )
    rows = rows.withColumns({
        "ok_any": F.col("strict_any_at_k") >= t["strict_any"], "ok_mixed": F.col("mixed_rate") >= t["mixed"], "ok_informative": F.col("hard_informative_rate") >= t["informative"],
        "ok_ranking": F.coalesce(F.col("hard_top_given_support") >= t["top_strict"], F.lit(False)),
        "ok_coverage": F.col("supported_tasks") / F.greatest(F.col("task_count"), F.lit(1)) >= t["task_fraction"], "ok_tasks": F.col("task_count") >= t["tasks"],
    })
    all_ok = F.col("ok_mixed") & F.col("ok_coverage") & F.col("ok_tasks")
    decision = (
        F.when(~F.col("ok_any") | ~F.col("ok_informative"), "DO_NOT_RUN_ONLINE_RL_SUPPORT_TOO_LOW").when(~F.col("ok_ranking"), "REPAIR_REWARD_BEFORE_ONLINE_RL")
        .when(~all_ok, "BUILD_SUPPORT_BEFORE_ONLINE_RL").otherwise("PROCEED_TO_SMALL_ONLINE_RL_PILOT")
    )
    return rows.withColumn("decision", decision)


def is_authorised(report: dict, thresholds: dict | None = None) -> bool:
    """Whether a stored gate report lets training go on: right decision, no failed check, the same thresholds."""
    t = SUPPORT_THRESHOLDS | (thresholds or {})
    return report.get("decision") == "PROCEED_TO_SMALL_ONLINE_RL_PILOT" and not report.get("failed_checks") and dict(report.get("thresholds", {})) == t


def with_zscore(rows: DataFrame, value: str, group: Sequence[str], name: str, clip: float = 3.0) -> DataFrame:
    """Adds the population z-score within a group, clipped; 0 where the variance is under 1e-12.

    One small row per group is joined back, so no group meets in one task.
    """
    stats = rows.groupBy(*group).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_variance"))
    keyed = stats.withColumnsRenamed({g: f"_by_{g}" for g in group})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_by_{g}")) for g in group])
    z = F.try_divide(F.col(value) - F.col("_mean"), F.sqrt("_variance"))
    out = rows.join(keyed, same, "left").withColumn(name, F.when(F.col("_variance") < 1e-12, 0.0).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))
    return out.drop("_mean", "_variance", *(f"_by_{g}" for g in group))


def advantages(rows: DataFrame, group: str, candidate: str, weights: dict[str, float], channel: str = "channel", value: str = "value") -> DataFrame:
    """Channels normalised within their group, weighted, added and normalised again.

    Rows are long: one for each candidate and channel. Returns ``group,
    candidate, advantage, active_channels, zero_signal``.
    """
    entries = [F.lit(x) for item in weights.items() for x in item]
    rows = with_zscore(rows, value, [group, channel], "_z").withColumn("_w", F.try_element_at(F.create_map(*entries), F.col(channel))).where("_w IS NOT NULL")
    summed = rows.groupBy(group, candidate).agg(F.sum(F.col("_w") * F.col("_z")).alias("_s"))
    active = rows.groupBy(group, channel).agg(F.max((F.abs("_z") > 0).cast("int")).alias("_a")).groupBy(group).agg(F.sum("_a").alias("active_channels"))
    out = with_zscore(summed, "_s", [group], "advantage").drop("_s").join(active, group)
    most = out.groupBy(group).agg((F.max(F.abs("advantage")) == 0).alias("zero_signal"))
    return out.join(most, group)


def running_totals(history: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds running sums of a step log."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return history.withColumns({f"{v}_total": F.sum(v).over(w) for v in values})


def item_histogram(rows: DataFrame, items: str) -> DataFrame:
    """How many rows name each item; a row counts once for each of its items."""
    # a plain explode would have the items computed again at the scan, to see whether there are any
    named = rows.select(F.posexplode_outer(F.array_distinct(items)).alias("place", "item")).where("place IS NOT NULL")
    return named.groupBy("item").agg(F.count("*").alias("n"))


def metric_deltas(left: DataFrame, right: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Right minus left of long metric tables; null where either is."""
    return left.select(metric, F.col(value).alias("left_value")).join(right.select(metric, F.col(value).alias("right_value")), metric).withColumn("delta", F.col("right_value") - F.col("left_value"))


def scale_table(rows: DataFrame, scale: str, arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """One row for each scale, a column for each arm."""
    return rows.groupBy(scale).pivot(arm, list(arms)).agg(F.avg(value))
