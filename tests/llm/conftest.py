"""Awkward documents that every operator must take: nulls, empties, copies, ties, long texts, clashing columns."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{k % 977} thing{k % 31}," for k in range(60_000))
LINE = "the quick brown fox jumps over the lazy dog and runs into the deep forest"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, f"{LINE}\n{LINE} again\nshort", "en", "s", 10), (2, f"{LINE}\n{LINE} again\nshort", "en", "s", 10), (2, f"{LINE}\n{LINE} again\nshort", "en", "s", 10),
        (3, None, "en", "s", None), (4, "", None, None, 0), (None, "la casa y el perro que no come nada por la noche en el campo verde", "es", "s", 5), (None, None, None, None, None),
        (5, LONG, "en", "s", 9), (6, " \t\n ", "en", "s", 4), (7, "1234 5678 !!! ...", "en", "s", 4), (8, LINE.upper(), "en", "s", 4), (9, "x", "en", "s", 1), (10, "\n\n", "en", "s", 2),
        (11, "Straße ÉTÉ ñandú 漢字 😀 der hund und die katze sind nicht im haus von der frau", "de", "s", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: df["doc_id"] for c in ("id", "key", "row", "_row", "score", "band", "h", "line", "n", "rid", "value", "word", "chunk", "bucket", "offset", "length", "_cut", "held_out", "canon", "k")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("doc_id < -1")
