"""Arrays of token ids: prefixes, label masks, truncation and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORED = -100


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading items two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n.cast("long")).cast("int")


def with_end(ids: Column, end: int) -> Column:
    """Appends the end id unless it is last already."""
    return F.when((F.size(ids) > 0) & (F.element_at(F.concat(F.array(F.lit(None).cast("int")), ids), -1) == end), ids).otherwise(F.concat(ids, F.array(F.lit(end))))


def masked_labels(full: Column, prompt: Column, max_length: int) -> Column:
    """The ids with the prompt's part ignored, cut to the length."""
    own = F.slice(full, 1, max_length)
    hidden = F.least(common_prefix(own, prompt), F.size(own))
    return F.concat(F.array_repeat(F.lit(IGNORED), hidden), F.slice(own, hidden + 1, F.greatest(F.size(own) - hidden, F.lit(0))))


def is_supervised(labels: Column) -> Column:
    """Whether any label counts."""
    return F.exists(labels, lambda x: x != IGNORED)


def pad_batches(rows: DataFrame, column: str, batch: str, value: int, left: bool = False) -> DataFrame:
    """Pads an array to the longest of its batch."""
    longest = F.max(F.size(column)).over(W.partitionBy(batch))
    filler = F.array_repeat(F.lit(value), longest - F.size(column))
    return rows.withColumn(column, F.concat(filler, F.col(column)) if left else F.concat(F.col(column), filler))
