"""Paired comparison of arms, stratified bootstrap, and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SLACK = 1e-12


def paired(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both arms by identity; raises unless both have the same, each once."""
    a = left.groupBy(*on).agg(F.count("*").alias("_na"), *(F.first(v).alias(f"left_{v}") for v in values))
    b = right.groupBy(*on).agg(F.count("*").alias("_nb"), *(F.first(v).alias(f"right_{v}") for v in values))
    both = a.join(b, list(on), "full_outer")
    ok = F.coalesce((F.col("_na") == 1) & (F.col("_nb") == 1), F.lit(False))
    first = F.when(ok, F.col(on[0])).otherwise(F.raise_error(F.lit("conditions do not match")).cast("string"))
    return both.withColumn(on[0], first.cast(dict(left.dtypes)[on[0]])).drop("_na", "_nb")


def identity_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes, distinct keys, keys missing on either side, and whether both sets are equal and unique."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    out = a.join(b, key, "full_outer").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"), F.count("a").alias("left_keys"), F.count("b").alias("right_keys"),
        F.count_if(F.col("a").isNull()).alias("missing_left"), F.count_if(F.col("b").isNull()).alias("missing_right"),
    )
    whole = (F.col("missing_left") == 0) & (F.col("missing_right") == 0) & (F.col("left_rows") == F.col("left_keys")) & (F.col("right_rows") == F.col("right_keys"))
    return out.withColumn("matches", whole)


def mismatches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows whose value the right one lacks or has otherwise: ``key, left_value, right_value``."""
    a = left.select(key, F.col(value).alias("left_value"))
    b = right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_there"))
    out = a.join(b, key, "left").where(F.col("_there").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value")))
    return out.drop("_there")


def macro_delta(pairs: DataFrame, bucket: str, left: str, right: str) -> DataFrame:
    """Mean over buckets of the mean of right minus left: ``buckets, rows, delta``."""
    by = pairs.groupBy(bucket).agg(F.avg(F.col(right).cast("double") - F.col(left).cast("double")).alias("d"), F.count("*").alias("n"))
    return by.agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"), F.avg("d").alias("delta"))


def all_of(checks: Sequence[Column]) -> Column:
    """Whether every check holds; null counts as no."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])


def at_least(value: Column, bound: float, slack: float = SLACK) -> Column:
    """A threshold with its slack; gates without slack pass 0."""
    return value >= bound - slack


def transfer_decision(primary: Sequence[Column], safety: Sequence[Column] = (), margin: float = 0.02, labels: tuple[str, str, str, str] = ("positive_transfer", "parameter_efficiency", "asymmetric_interference", "inconclusive")) -> Column:
    """The decision over mode deltas: non-inferior all round with a gain, non-inferior only, one mode lost, none of these."""
    safe = all_of([at_least(d, -margin) for d in (*primary, *safety)])
    gain = reduce(lambda a, b: a | b, [at_least(d, margin) for d in primary])
    lost = reduce(lambda a, b: a | b, [d < -margin for d in primary])
    return F.when(safe & gain, labels[0]).when(safe, labels[1]).when(lost, labels[2]).otherwise(labels[3])


def gate(rules: dict[str, tuple[Column, float, float]], extra: dict[str, Column] | None = None, labels: tuple[str, str] = ("supported", "not_supported")) -> Column:
    """``struct<checks..., decision>`` of named (value, bound, slack) rules and further conditions."""
    checks = {name: F.coalesce(at_least(v, bound, slack), F.lit(False)) for name, (v, bound, slack) in rules.items()}
    checks |= {name: F.coalesce(c, F.lit(False)) for name, c in (extra or {}).items()}
    decision = F.when(all_of(list(checks.values())), labels[0]).otherwise(labels[1])
    return F.struct(*(c.alias(name) for name, c in checks.items()), decision.alias("decision"))


def routing_gate(d: dict[str, Column], parity: Column) -> Column:
    """Routed adapter against its joint control: a gain on edit-only tasks, the rest within the margin, equal parameters."""
    return gate({
        "edit_only_gain": (d["edit_only"], 0.02, SLACK), "shared_kept": (d["shared"], -0.02, SLACK), "de_novo_kept": (d["de_novo"], -0.02, SLACK),
        "edit_valid_kept": (d["edit_valid"], -0.02, SLACK), "de_novo_valid_kept": (d["de_novo_valid"], -0.02, SLACK),
    }, {"parity": parity})


def transfer_aware_gate(d: dict[str, Column], parity: Column) -> Column:
    """Soft routing against a matched dense arm; this gate has no slack."""
    return gate({
        "edit_only_gain": (d["edit_only"], 0.02, 0), "edit_all_kept": (d["edit_all"], 0.0, 0), "shared_kept": (d["shared"], -0.02, 0), "de_novo_kept": (d["de_novo"], -0.02, 0),
        "edit_valid_kept": (d["edit_valid"], -0.02, 0), "de_novo_valid_kept": (d["de_novo_valid"], -0.02, 0),
    }, {"parity": parity})


def residual_gate(d: dict[str, Column], inactive_same: Column, inactive: Column, active_same: Column, active: Column, frozen_drift: Column, expected: tuple[Column | int, Column | int] = (370, 250)) -> Column:
    """Conditional residual: a gain on edit-only tasks, identical raw outputs of the ``expected`` numbers of requests, frozen weights untouched."""
    return gate({"edit_only_gain": (d["edit_only"], 0.02, SLACK), "edit_all_kept": (d["edit_all"], 0.0, SLACK), "edit_valid_kept": (d["edit_valid"], -0.02, SLACK)}, {
        "inactive_identical": inactive_same, "inactive_complete": inactive == expected[0], "active_identical": active_same, "active_complete": active == expected[1], "frozen": frozen_drift == 0.0,
    })


def shared_transfer_gate(strict: Column, valid: Column) -> Column:
    """Shared tasks: a strict gain over the specialist with validity kept."""
    return gate({"strict_gain": (strict, 0.02, SLACK), "valid_kept": (valid, -0.02, SLACK)}, labels=("positive_transfer", "not_supported"))


def dense_diagnostic(hard: dict[str, Column], vanilla: dict[str, Column]) -> Column:
    """Dense against hard routing and the plain arm: what is recovered; no slack, never confirmatory."""
    return F.struct(
        (hard["de_novo"] >= 0.02).alias("de_novo_recovers"), (hard["edit_only"] >= 0.02).alias("edit_only_recovers"), (vanilla["de_novo"] >= -0.02).alias("de_novo_near"),
        (vanilla["edit_only"] >= -0.02).alias("edit_only_near"), (vanilla["shared"] >= 0.02).alias("shared_gain"), F.lit(False).alias("confirmatory"),
    )


def safe_promotion(baseline: dict[str, Column], control: dict[str, Column]) -> Column:
    """Gain over baseline (2 points) and control (1 point) with every other metric within 1 point."""
    kept = ("edit_strict", "edit_relaxed", "de_novo_valid", "edit_valid")
    against = lambda d, gain: all_of([d["de_novo_strict"] >= gain, *(d[k] >= -0.01 for k in kept)])
    a, b = against(baseline, 0.02), against(control, 0.01)
    return F.struct(a.alias("beats_baseline"), b.alias("beats_control"), (a & b).alias("promote"))


def headline_promotion(strict: Column, edit: Column, is_full: Column, integrity: Sequence[Column], floors: tuple[float, float] = (0.5345, 0.5694)) -> Column:
    """Only a full checkpoint over both floors with every integrity check."""
    return all_of([is_full, strict >= floors[0], edit >= floors[1], *integrity])


def pick_checkpoint(rows: DataFrame, step: str, strict: str, edit: str, safe: Sequence[str]) -> DataFrame:
    """The safe checkpoint with the largest gain, then the larger weaker gain, then the earlier step."""
    key = F.struct(all_of([F.col(s) for s in safe]).cast("int").alias("safe"), F.col(strict).alias("gain"), F.least(strict, edit).alias("weaker"), (-F.col(step)).alias("early"))
    return rows.agg(F.max_by(step, key).alias(step), F.max(key).alias("_k")).select(step, (F.col("_k.safe") == 1).alias("safe"), F.col("_k.gain").alias("gain"))


def arm_contrasts(rows: DataFrame, arm: str, metric: str, value: str, contrasts: Sequence[tuple[str, str]]) -> DataFrame:
    """Named differences of arms for every metric: ``metric, contrast, delta``."""
    wide = rows.groupBy(metric).pivot(arm, sorted({x for c in contrasts for x in c})).agg(F.first(value))
    items = F.array(*(F.struct(F.lit(f"{a}_minus_{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("delta")) for a, b in contrasts))
    return wide.select(metric, F.explode(items).alias("c")).select(metric, "c.*")


def subset_identity(left: DataFrame, right: DataFrame, key: str, raw: str, active: Column, first: int = 10) -> DataFrame:
    """Whether both arms answered alike where a residual is active and where it is not.

    ``subset, checked, mismatches, identical, first_mismatches``: left rows of each
    subset, those that the right arm lacks or answered otherwise (null is empty),
    and the first keys of those. Subsets without rows do not appear.
    """
    own = left.select(key, F.when(active, "active").otherwise("inactive").alias("subset"), F.coalesce(raw, F.lit("")).alias("_left"))
    other = right.select(key, F.coalesce(raw, F.lit("")).alias("_right"))
    rows = own.join(other, key, "left").withColumn("_bad", ~F.col("_left").eqNullSafe(F.col("_right")))
    counts = rows.groupBy("subset").agg(F.count("*").alias("checked"), F.count(F.when(F.col("_bad"), 1)).alias("mismatches"))
    ranked = first_rows(rows.where("_bad").select("subset", key), ["subset"], [key], first)
    firsts = ranked.groupBy("subset").agg(F.array_sort(F.collect_list(key)).alias("first_mismatches"))  # at most ``first``
    none = F.array().cast(firsts.schema["first_mismatches"].dataType)
    return counts.join(firsts, "subset", "left").select("subset", "checked", "mismatches", (F.col("mismatches") == 0).alias("identical"), F.coalesce("first_mismatches", none).alias("first_mismatches"))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first rows of each group, as diagnostics show them; each task sends k rows of a group at most."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def wanted(gate: Sequence[DataFrame], candidates: DataFrame, key: str) -> DataFrame:
    """Rows of all gates (copies stay) whose id some candidate has."""
    rows = reduce(lambda a, b: a.unionByName(b), gate)
    return rows.join(candidates.select(key), key, "left_semi")


def united_ids(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """The distinct ids of several tables; null is no id."""
    return reduce(lambda a, b: a.union(b), [f.select(key) for f in frames]).where(F.col(key).isNotNull()).distinct()


def checkpoint_deltas(rows: DataFrame, baseline: DataFrame, step: str, metrics: Sequence[str], kept: Sequence[str], slack: float = 0.01) -> DataFrame:
    """Each checkpoint's metrics less the baseline's (one row), and whether each of ``kept`` lost at most ``slack``.

    Columns ``step, <metric>_delta, <metric>_safe, safe``.
    """
    base = F.broadcast(baseline.select(*(F.col(m).alias(f"_{m}") for m in metrics)))
    out = rows.join(base).select(step, *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics))
    out = out.select("*", *(F.coalesce(F.col(f"{m}_delta") >= -slack, F.lit(False)).alias(f"{m}_safe") for m in kept))
    return out.withColumn("safe", all_of([F.col(f"{m}_safe") for m in kept]))
