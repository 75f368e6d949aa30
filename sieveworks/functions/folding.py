"""Unicode compatibility folding (NFKC) by a table, inside the JVM for all texts but those that need reordering.

The table is built by a rule: every code point whose compatibility form is
another text. A text in which marks or conjoining letters could join what stands
before them needs composition across code points; only such texts go to Python.
Texts in ASCII are left alone without a look at the table.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .programs import once


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], frozenset[str]]:
    """The folds of single code points, and the code points that may join what stands before them."""
    folds, second = {}, set()
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        c = chr(point)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
            second.add(chr(int(parts[1], 16)))  # a canonical pair's second half
        if (folded := unicodedata.normalize("NFKC", c)) != c:
            folds[c] = folded
    # conjoining vowels and finals join by rule, without entries
    second |= {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    joining = {chr(p) for p in range(0x80, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF and _joins(chr(p), second)}
    return folds, frozenset(joining)


def _joins(c: str, second: set[str]) -> bool:
    first = unicodedata.normalize("NFKD", c)[:1]
    return c in second or first in second or unicodedata.combining(c) != 0 or bool(first) and unicodedata.combining(first) != 0


def _kind(text: Column, joining, long) -> Column:
    """3 where a text holds a code point that may join others, 2 where one folds to several, 1 where one is beyond ASCII, else 0.

    One look at what is left without ASCII, in which 2 and 3 then stand for the code points of those kinds.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", "")
    several = sorted(set(long) - joining)
    marked = F.translate(beyond, "".join(sorted(joining)) + "".join(several), "3" * len(joining) + "2" * len(several))
    return once(marked, lambda m: F.when(m.contains("3"), 3).when(m.contains("2"), 2).when(m != "", 1).otherwise(0))


def nfkc(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The table with a text column's compatibility composition.

    Folds to one code point are a ``translate``. Longer ones are looked up in a map, for
    the code points that have one in texts that hold any. No row is exploded. The table is read
    once and each text looked at once: what follows from its kind is taken from columns, as a filter
    would compute the text again for every branch.
    """
    name = name or column
    folds, joining = tables()
    short = {c: f for c, f in folds.items() if len(f) == 1}
    long = {c: f for c, f in folds.items() if len(f) > 1}
    gone = "".join(c for c, f in folds.items() if not f)
    pairs = rows.sparkSession.createDataFrame([(list(long.items()),)], "pairs array<struct<k:string,v:string>>").select(F.map_from_entries("pairs").alias("_nfkc_folds"))

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC") if values.notna().any() else values

    translated = lambda c: F.translate(c, "".join(short) + gone, "".join(short.values()))
    is_long = lambda c: F.translate(c, "".join(long), "") == ""
    text, kind = F.col("_nfkc_text"), F.col("_nfkc_kind")
    expanded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(is_long(c), F.try_element_at(F.col("_nfkc_folds"), c)).otherwise(c)), "")
    seen = rows.withColumn("_nfkc_text", F.col(column)).withColumn("_nfkc_kind", _kind(text, joining, long))
    # Python gets the texts that need it; for the others a null goes there
    seen = seen.withColumn("_nfkc_composed", compose(F.when(kind == 3, text))).crossJoin(F.broadcast(pairs))  # a map of one row
    out = F.when(kind == 3, F.col("_nfkc_composed")).when(kind == 2, translated(expanded)).when(kind == 1, translated(text)).otherwise(text)
    return seen.withColumn(name, out).drop("_nfkc_text", "_nfkc_kind", "_nfkc_composed", "_nfkc_folds")
