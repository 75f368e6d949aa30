"""Hash keys: stable order, 64-bit ranks, short ids and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column) -> Column:
    """SHA-256 of a text, 64 lower-case hex digits."""
    return F.sha2(text.cast("string"), 256)


def stable_key(seed: int, identity: Column) -> Column:
    """Order key of ``seed:identity``; its text order is the order of the 256-bit numbers."""
    return sha(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))))


def rank16(digest: Column) -> Column:
    """The leading 64 bits as 16 hex digits: text order is the unsigned order."""
    return F.substring(digest, 1, 16)


def rank_mod(digest: Column, n: int, least: int = 0) -> Column:
    """``least + leading 64 bits mod n``; decimals, as Spark has no unsigned long."""
    number = F.conv(rank16(digest), 16, 10).cast("decimal(20,0)")
    return (F.lit(least) + (number % F.lit(n).cast("decimal(20,0)"))).cast("long")


def pair_key(left: Column, right: Column) -> Column:
    """Hash of an ordered pair of texts."""
    return sha(F.concat(left, F.lit("\n"), right))


def short_id(prefix: str, digest: Column, digits: int = 24) -> Column:
    """``prefix:`` and the first hex digits."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, digits))


def text_hash(text: Column, blank: str = "<EMPTY>") -> Column:
    """Hash of a text; the empty string for null, empty and the blank mark."""
    return F.when(text.isNull() | (text == "") | (text == blank), F.lit("")).otherwise(sha(text))


def identity(columns: Sequence[str], policy: str = "presence") -> Column:
    """The first identity column that counts, as text.

    ``presence`` takes the first non-null one, even if empty; ``truthy`` skips
    empty ones too. Neither finding any gives the empty string.
    """
    if policy not in ("presence", "truthy"):
        raise ValueError(f"unknown policy: {policy}")
    found = [F.col(c).cast("string") for c in columns]
    if policy == "truthy":
        found = [F.nullif(c, F.lit("")) for c in found]
    return F.coalesce(*found, F.lit(""))


def fixed_number(value: Column, digits: int = 6) -> Column:
    """A number's own text for hashing: fixed digits, the same in every engine."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
