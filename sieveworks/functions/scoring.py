"""Margins, satisfaction, rewards, channels and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of a direction's margin, and tolerance of "around", by property.
SCALES = {"MW": 500.0, "LogP": 6.0, "QED": 1.0, "TPSA": 160.0, "HBD": 8.0, "HBA": 12.0, "RB": 12.0, "SA": 8.0, "GSK3B": 0.5, "DRD2": 0.5, "JNK3": 0.5}
TOLERANCES = {"MW": 35.0, "LogP": 1.0, "QED": 0.10, "TPSA": 20.0, "HBD": 1.0, "HBA": 1.0, "RB": 1.0}
# Weights of reward channels by mode.
DE_NOVO_WEIGHTS = {"validity": 0.5, "canonical": 0.1, "property_mean": 0.75, "property_bottleneck": 1.0, "property_strict": 1.0}
EDIT_WEIGHTS = DE_NOVO_WEIGHTS | {"source_aligned": 0.5, "source_relaxed": 0.25, "source_strict": 0.5, "relaxed_success": 0.5, "strict_success": 1.0, "noncopy": 0.25}
RELAXED, STRICT, TEMPERATURE, FLOOR = 0.15, 0.65, 0.25, -4.0


def by_property(values: dict[str, float], prop: Column, default: float = 1.0) -> Column:
    """A constant for each property."""
    entries = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*entries), prop), F.lit(default))


def finite(value: Column) -> Column:
    """The number, or null if it is not finite."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def margin(value: Column, source: Column, direction: Column, around: Column, scale: Column, tolerance: Column) -> Column:
    """How far a condition is met; null if it cannot be evaluated."""
    change = (value - source) / scale
    return (
        F.when(around.isNotNull(), 1 - F.abs(value - around) / tolerance).when(direction == "increase", change).when(direction == "decrease", -change)
        .when(direction == "preserve", 1 - F.abs(change))
    )


def satisfied(margin_: Column, direction: Column) -> Column:
    """Strictly positive for a change, at least zero otherwise; null stays null."""
    return F.when(direction.isin("increase", "decrease"), margin_ > 0).otherwise(margin_ >= 0)


def squash(x: Column, width: float = TEMPERATURE) -> Column:
    """A smooth step from 0 to 1."""
    return 0.5 * (F.tanh(x / width) + 1)


def bottleneck(margins: Column) -> Column:
    """Squashed soft minimum of an array's evaluated margins; 0 with none."""
    known = F.filter(margins, lambda x: x.isNotNull())
    least = F.array_min(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(-(x - least) / TEMPERATURE))
    return F.when(F.size(known) > 0, squash(least - TEMPERATURE * F.ln(total))).otherwise(0.0)


def program_score(margins: Column, hits: Column) -> Column:
    """``struct<fraction, satisfaction, bottleneck, all_met>``; denominators are all declared conditions."""
    total = F.size(margins)
    met = F.aggregate(hits, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))
    soft = F.aggregate(margins, F.lit(0.0), lambda a, x: a + F.coalesce(squash(x), F.lit(0.0)))
    n = F.greatest(total, F.lit(1))
    return F.struct((met / n).alias("fraction"), (soft / n).alias("satisfaction"), bottleneck(margins).alias("bottleneck"), ((total > 0) & (met == total)).alias("all_met"))


def _one(flag: Column) -> Column:
    return F.coalesce(flag.cast("double"), F.lit(0.0))


def soft_reward(valid: Column, canonical: Column, fraction: Column, satisfaction: Column, bottleneck_: Column, all_met: Column, mode: Column, similarity: Column, copy: Column) -> Column:
    """Shaped reward; -1 for invalid answers."""
    base = 0.5 + 0.1 * _one(canonical) + 0.75 * fraction + 0.75 * satisfaction + 0.75 * bottleneck_ + _one(all_met)
    sim = F.coalesce(similarity, F.lit(0.0))
    edit = (
        0.25 * F.least(sim / STRICT, F.lit(1.0)) + 0.25 * _one(sim >= RELAXED) + 0.5 * _one(sim >= STRICT)
        + 0.5 * _one(all_met & (sim >= RELAXED)) + _one(all_met & (sim >= STRICT)) - 0.25 * _one(copy)
    )
    return F.when(~F.coalesce(valid, F.lit(False)), -1.0).otherwise(base + F.when(mode == "edit", edit).otherwise(0.0))


def hard_reward(valid: Column, canonical: Column, fraction: Column, satisfaction: Column, bottleneck_: Column, all_met: Column, strict: Column, similarity: Column, copy: Column) -> Column:
    """Reward that only answers near their source can raise above the floor."""
    eligible = F.coalesce(valid & ~copy & (similarity >= STRICT), F.lit(False))
    reward = 0.25 * _one(canonical) + 0.5 * F.coalesce(satisfaction, F.lit(0.0)) + 0.75 * F.coalesce(bottleneck_, F.lit(0.0)) + 0.5 * F.coalesce(fraction, F.lit(0.0)) + _one(all_met) + 4 * _one(strict)
    return F.when(eligible, reward).otherwise(FLOOR)


def channels(valid: Column, canonical: Column, satisfaction: Column, bottleneck_: Column, all_met: Column, mode: Column, similarity: Column, relaxed: Column, strict: Column, copy: Column) -> Column:
    """Named reward channels: all zero for invalid answers."""
    sim = F.coalesce(similarity, F.lit(0.0))
    plain = {"validity": F.lit(1.0), "canonical": _one(canonical), "property_mean": F.coalesce(satisfaction, F.lit(0.0)), "property_bottleneck": F.coalesce(bottleneck_, F.lit(0.0)), "property_strict": _one(all_met)}
    edit = {
        "source_aligned": squash(sim - STRICT, 0.15), "source_relaxed": _one(sim >= RELAXED), "source_strict": _one(sim >= STRICT), "relaxed_success": _one(relaxed),
        "strict_success": _one(strict), "noncopy": _one(~F.coalesce(copy, F.lit(False))),
    }
    ok = F.coalesce(valid, F.lit(False))
    made = lambda named: F.create_map(*(x for k, c in named.items() for x in (F.lit(k), F.when(ok, c).otherwise(0.0))))
    return F.when(mode == "edit", made(plain | edit)).otherwise(made(plain))


def weighted(channels_: Column, weights: dict[str, float]) -> Column:
    """Weighted sum of a channel map; absent channels count zero."""
    return sum((w * F.coalesce(F.try_element_at(channels_, F.lit(k)), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))


def kl_estimate(log_ratio: Column) -> Column:
    """exp(-r) + r - 1, never negative."""
    return F.exp(-log_ratio) + log_ratio - 1


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of an array where the mask is 1; over at least one."""
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))


def hinge(margin_: Column, positive: Column, negative: Column, weight: Column) -> Column:
    """Weighted positive part of margin + positive - negative."""
    return F.greatest(F.lit(0.0), margin_ + positive - negative) * weight


def negative_weight(arm: str, kind: Column, weight: Column) -> Column:
    """Weight of a contrastive negative in an arm."""
    semantic = kind.isin("source_copy", "condition_mismatch", "opposite_program_target", "partial_program_target")
    arms = {"positive_only": F.lit(0.0), "semantic_only": F.when(semantic, weight).otherwise(0.0), "semantic_plus_syntax": weight}
    if arm not in arms:
        raise ValueError(f"unsupported arm: {arm}")
    return arms[arm]


def exposure(steps: Column, batch: int, accumulation: int, buckets: int) -> Column:
    """Examples seen, and those of each bucket if they divide evenly."""
    seen = steps * batch * accumulation
    return F.struct(seen.alias("examples"), F.when(seen % buckets == 0, (seen / buckets).cast("long")).alias("per_bucket"))
