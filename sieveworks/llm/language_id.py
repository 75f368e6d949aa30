"""Language identification with hyperdimensional profiles.

Every symbol has a random +1/-1 vector of ``DIMENSIONS`` entries. An n-gram's
vector binds (multiplies) its symbols' vectors after permuting (rotating) each
by its place. A text's vector bundles (adds) the vectors of all its n-grams,
and a language's prototype bundles those of all its training texts. A text is
given the language whose prototype has the largest cosine with its vector.

Bundling is linear, so the inner product of a text with a prototype is the sum
over its n-grams of <n-gram vector, prototype>. Those numbers are tabulated
once per model, one per n-gram code and language: a text is then scored from
its n-gram counts with no loss against adding the long vectors themselves.
The text's own norm divides every cosine alike and cancels in ``score``, the
best cosine's share of all positive cosines.

Whether a text is in a learned language at all does not follow from that share,
which depends on how many languages there are. It is judged by the mean inner
product of its n-grams with the best prototype: that of the language's own
training n-grams has a mean and a deviation, both known from the counts. A text
``fits`` if its mean is at least ``LEAST_FIT`` of the language's, less
``DEVIATIONS`` standard errors for its number of n-grams.

Defined results: null texts and texts without a letter are ``und`` with score
0; equal cosines go to the first language by name; without any training rows
every text is ``und``; repeated rows are scored each; further input columns are
ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

DIMENSIONS = 2048
ORDER = 3
#: Symbols: 0 for anything but letters, 1-26 for a-z, the rest shared by other letters.
SYMBOLS = 48
SEED = 20_011
UNDETERMINED = "und"
#: Texts are turned into symbols in pieces of at most so many code points.
BLOCK = 1 << 20
LEAST_FIT, DEVIATIONS = 0.5, 3
#: Languages whose counters a task holds before it passes them on.
HELD = 64

_LUT: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Code point to symbol, for lower-cased text."""
    global _LUT
    if _LUT is None:
        lut = np.zeros(0x110000, np.uint8)
        lut[ord("a"):ord("z") + 1] = np.arange(1, 27)
        others = np.array([c for c in range(128, 0x110000) if chr(c).isalpha()], np.int64)
        lut[others] = 27 + (others * 2654435761 % (1 << 32) >> 7) % (SYMBOLS - 27)
        _LUT = lut
    return _LUT


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes and counts of a text's n-grams over letters; None if it has no letter.

    Runs of other characters count as one blank, also before and after the text.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[points]
    if not symbols.any():
        return None
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    symbols = symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]
    n = len(symbols) - ORDER + 1
    codes = np.zeros(max(n, 0), np.int32)
    for k in range(ORDER):
        codes = codes * SYMBOLS + symbols[k:k + len(codes)]
    if len(codes) > 20_000:
        counts = np.bincount(codes, minlength=SYMBOLS**ORDER)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(codes, return_counts=True)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-gram codes, one row each."""
    letters = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.int8) * 2 - 1
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(ORDER):
        symbol = codes // SYMBOLS ** (ORDER - 1 - place) % SYMBOLS
        out *= np.roll(letters, ORDER - 1 - place, axis=1)[symbol]
    return out


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """N-gram counts per language over all rows: (lang, code, n).

    Each task adds up its own rows first; a task holds at most one array of
    ``SYMBOLS ** ORDER`` counters for each of ``HELD`` languages.
    """

    def counters(totals: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "code": found.astype(np.int32), "n": total[found]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch[text_col], batch[lang_col]):
                if (grams := gram_counts(text)) is not None:
                    total = totals.get(lang)
                    if total is None:
                        if len(totals) >= HELD:
                            yield from counters(totals)
                            totals.clear()
                        total = totals[lang] = np.zeros(SYMBOLS**ORDER, np.int64)
                    total[grams[0]] += grams[1]
        yield from counters(totals)

    rows = docs.select(text_col, lang_col).mapInPandas(count, "lang string, code int, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages and their cosine tables; its size depends on the alphabet and languages only."""

    def __init__(self, languages: list[str], scores: np.ndarray, usual: np.ndarray):
        self.languages, self.scores, self.usual = languages, scores, usual

    @classmethod
    def from_counts(cls, counts: pd.DataFrame) -> LanguageModel:
        """Builds prototypes from (lang, code, n) and tabulates their inner products."""
        languages = sorted(counts["lang"].unique())
        prototypes = np.zeros((len(languages), DIMENSIONS))
        codes = np.unique(counts["code"].to_numpy()) if len(counts) else np.zeros(0, np.int32)
        weights = np.zeros((len(languages), len(codes)))
        for k, lang in enumerate(languages):
            own = counts[counts["lang"] == lang]
            weights[k, np.searchsorted(codes, own["code"].to_numpy())] = own["n"]
        blocks = [slice(i, i + 4096) for i in range(0, len(codes), 4096)]
        for b in blocks:
            prototypes += weights[:, b] @ gram_vectors(codes[b]).astype(np.float32)
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        prototypes = (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)
        scores = np.zeros((SYMBOLS**ORDER, max(1, len(languages))), np.float32)
        everything = np.arange(SYMBOLS**ORDER)
        for i in range(0, len(everything) if languages else 0, 4096):
            scores[i:i + 4096] = gram_vectors(everything[i:i + 4096]).astype(np.float32) @ prototypes.T
        # mean and deviation of a language's own n-grams
        shares = weights / np.maximum(weights.sum(axis=1, keepdims=True), 1)
        own = scores[codes, :len(languages)].T.astype(np.float64)
        mean = (shares * own).sum(axis=1)
        return cls(languages, scores, np.stack((mean, np.sqrt(np.maximum(0, (shares * own * own).sum(axis=1) - mean * mean))), axis=1))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language and score of one text, and whether it fits that language."""
        grams = gram_counts(text) if self.languages else None
        if grams is None:
            return UNDETERMINED, 0.0, False
        cosines = np.maximum(grams[1].astype(np.float64) @ self.scores[grams[0]].astype(np.float64), 0)
        total = cosines.sum()
        if not total > 0:
            return self.languages[0], 0.0, False
        best = int(np.argmax(cosines))
        n, (mean, deviation) = int(grams[1].sum()), self.usual[best]
        fits = cosines[best] / n >= LEAST_FIT * mean - DEVIATIONS * deviation / n**0.5
        return self.languages[best], float(min(1.0, cosines[best] / total)), bool(fits)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from all rows with a text and a language.

    What reaches the driver is one counter per n-gram code and language, at most
    ``SYMBOLS ** ORDER`` rows a language, however many documents there are.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return LanguageModel.from_counts(count_grams(rows, text_col, lang_col).toPandas())


def judged(docs: DataFrame, model: LanguageModel, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: a struct of ``lang_pred``, ``score`` and ``fits``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.usual))

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        own = LanguageModel(*shared.value)
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "fits"])

    return docs.withColumn(name, judge(F.col(text_col)))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``; columns of these names are replaced."""
    own = free(docs, "_judged")
    out = judged(docs, model, text_col, own)
    return out.withColumns({"lang_pred": F.col(own)["lang_pred"], "score": F.col(own)["score"]}).drop(own)


def held_out(id_col: str, modulus: int):
    """Whether crc32 of the id as text leaves no remainder by ``modulus``; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    rows = docs.withColumn("held_out", held_out(id_col, modulus))
    model = fit(rows.where(~F.col("held_out")).select(text_col, lang_col), text_col, lang_col)
    return predict(rows, model, text_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
