"""Benchmark decontamination: benchmark items that occur in documents, up to edits.

Texts are lower-cased words; each letter of a script that writes no blanks is a
word. An item of W words occurs in a document if some passage is within
``floor(EDITS * W)`` word edits of it. Candidates come from the CGK random walk: a
walk over a sequence repeats or advances its symbol at each step by a random bit
of (walk, step, symbol), which turns edits into few changed coordinates of the
walk. Two random coordinates of a walk make one key of bit-sampling LSH. The
items' keys are held in ``WALKS`` hash tables for each item length; windows of the
item's size look up their own keys there, and what any table returns is a
candidate. Candidates are confirmed by exact edit distance against the best
passage around the window.

How many walks a window would need grows with its edits, so items of over ``PIECE``
words are looked for by their pieces: of p pieces of an item within t edits, one is
within t / p. Pieces are windows like others; what they find is the item's place, and
the whole item is confirmed there.

With a share h of changed coordinates a walk's key agrees with a chance of
(1 - h)^2, so 32 walks miss with (1 - (1 - h)^2)^32: 1.5 % at h = 0.65.

Windows are walked only where some item may be: by the q-gram lemma a passage
within t edits of an item of W words holds at least W - q + 1 - qt of the items'
runs of q words; q is the largest up to 3 for which that is one at least, so there
is no least length. That looks at all items together and loses nothing.

Benchmarks are small beside the corpus: they are searched for in passes of at
most ``PASS_ITEMS`` items and about ``PASS_CHARS`` characters, so a task never
holds more than those, however large the benchmark is; each pass reads the corpus.

Defined results: null or empty texts hold no item; items with null text or no
word are not searched for, items of up to three words only as they stand
(``min_words`` leaves out short ones); repeated documents are reported each, items
with one id and text once; null ids are carried; further columns are ignored. An
empty table on either side gives no rows. Texts are used whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

EDITS = 0.25
WALKS = 32
#: Words of an item that is looked for as one window; longer ones are cut into pieces of about one length.
PIECE = 40
PASS_ITEMS, PASS_CHARS = 20_000, 16_000_000
#: Windows times steps that are walked at once.
BLOCK = 1 << 16
SEED = 77_003
# Letters of scripts that write no blanks between words (Thai to Khmer, kana, CJK).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LETTER = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(r"\w+")
_EACH = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_EACH if not text.isascii() and _LETTER.search(text) else _WORD).findall(text)


def _bits(symbols: np.ndarray, step: int, walks: np.ndarray) -> np.ndarray:
    """The walks' bits for symbols at a step."""
    with np.errstate(over="ignore"):
        x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + walks + np.uint64(step) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(60)) & np.uint64(1)


def sampled_steps(width: int) -> np.ndarray:
    """The two steps of each walk that make its key for sequences of a length: shape (WALKS, 2)."""
    return np.random.default_rng([SEED, width]).integers(0, 2 * width, (WALKS, 2))


def walk(symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All walks from some places: how far they are, and at which symbol, before each of the (ascending) ``steps``.

    A walk does not depend on where its sequence ends, so one walk serves
    sequences of every length. Beyond the last symbol it stands at -1.
    """
    seeds = np.random.default_rng(SEED).integers(0, 1 << 63, WALKS, dtype=np.uint64)[None, :]
    wanted = {int(step): k for k, step in enumerate(steps)}
    far, met = np.empty((len(steps), len(starts), WALKS), np.int32), np.empty((len(steps), len(starts), WALKS), np.int64)
    padded = np.append(symbols, -1)
    at = np.broadcast_to(np.asarray(starts, np.int64)[:, None], (len(starts), WALKS)).copy()
    for step in range(int(steps[-1]) + 1 if len(steps) else 0):
        here = padded[np.minimum(at, len(symbols))]
        if (k := wanted.get(step)) is not None:
            np.subtract(at, starts[:, None], out=far[k], casting="unsafe")
            met[k] = here
        at += _bits(here, step, seeds).view(np.int64)
    return far, met


def passage_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Least word edits between the item and any passage of the region."""
    row = np.zeros(len(region) + 1, np.int64)
    steps = np.arange(len(region) + 1)
    for k, word in enumerate(item):
        cost = np.concatenate(([k + 1], np.minimum(row[1:] + 1, row[:-1] + (region != word))))
        row = np.minimum.accumulate(cost - steps) + steps
    return int(row.min())


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of symbols."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = (out ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Width:
    """The windows (items or pieces) of one length and budget: their runs of words, and their keys in the LSH tables."""

    def __init__(self, width: int, edits: int, items: np.ndarray, symbols: np.ndarray):
        self.width, self.edits, self.items = width, edits, items
        self.q = next(q for q in (3, 2, 1) if width - q + 1 - q * edits >= 1)
        self.need = width - self.q + 1 - self.q * edits
        self.sampled = sampled_steps(width)
        steps = np.unique(self.sampled)
        held = []
        for k in range(0, len(items), rows := max(1, BLOCK // len(steps))):
            own = symbols[k:k + rows]
            row, keys = self.table_keys(steps, *walk(own.reshape(-1), np.arange(len(own)) * width, steps))
            held.append((items[k + row], keys))
        found, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys, kind="stable")
        self.keys, self.found = keys[order], found[order]

    def near(self, there: np.ndarray) -> np.ndarray:
        """Starts of windows that hold enough of the runs which stand at some (ascending) places."""
        first, last = there[:len(there) - self.need + 1], there[self.need - 1:]
        span = self.width + self.edits - self.q + 1
        close = last - first < span
        if not close.any():
            return there[:0]
        low, high = np.maximum(last[close] - span + 1, 0), first[close] + 1
        n = high - low
        return np.unique(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    def table_keys(self, steps: np.ndarray, far: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and hashes of the keys in all tables; keys that lie beyond the sequence are left out."""
        walks = np.arange(WALKS)
        pair = []
        for which in (0, 1):
            at = np.searchsorted(steps, self.sampled[:, which])
            pair.append(np.where(far[at, :, walks] < self.width, met[at, :, walks], -1))  # shape (WALKS, rows)
        table, row = np.nonzero((pair[0] != -1) | (pair[1] != -1))
        return row, _hash([table, pair[0][table, row], pair[1][table, row]])

    def candidates(self, starts: np.ndarray, steps: np.ndarray, far: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and window starts that share a key in some table."""
        row, keys = self.table_keys(steps, far, met)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.found[at], np.repeat(starts[row], n)


class Items:
    """The items of one pass."""

    def __init__(self, rows: list[tuple[object, str | None]], edits: float, min_words: int = 1):
        self.numbers: dict[str, int] = {}
        self.ids, self.symbols = [], []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
            words = words_of(text)
            if len(words) >= max(1, min_words):
                self.ids.append(item_id)
                self.symbols.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64))
        self.edits = [int(edits * len(own)) for own in self.symbols]
        # windows to look for: the item, where in it they begin, and their symbols
        self.of, self.offset, windows = [], [], []
        by_width = defaultdict(list)
        for k, own in enumerate(self.symbols):
            pieces = -(-len(own) // PIECE)
            for at, piece in zip(np.cumsum([0, *(len(x) for x in np.array_split(own, pieces))]), np.array_split(own, pieces)):
                by_width[len(piece), self.edits[k] // pieces].append(len(windows))
                self.of.append(k)
                self.offset.append(int(at))
                windows.append(piece)
        self.of, self.offset = np.array(self.of, np.int64), np.array(self.offset, np.int64)
        self.widths = [Width(w, t, np.array(k), np.stack([windows[i] for i in k])) for (w, t), k in sorted(by_width.items())]
        # the runs of q words of all items of a length, with the number of that length
        self.runs = {}
        for q in {w.q for w in self.widths}:
            codes, of = [], []
            for number, w in enumerate(self.widths):
                if w.q == q:
                    own = np.unique(np.concatenate([_hash([windows[i][k:w.width - q + 1 + k] for k in range(q)]) for i in w.items]))
                    codes.append(own)
                    of.append(np.full(len(own), number))
            codes, of = np.concatenate(codes), np.concatenate(of)
            order = np.argsort(codes, kind="stable")
            self.runs[q] = codes[order], of[order]

    def search(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, edits, first word) of all items in a text."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        symbols = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        asked = []  # the lengths whose items may be here, and where
        for q, (runs, of) in self.runs.items():
            n = len(words) - q + 1
            there = np.flatnonzero(symbols >= 0)
            there = there[there < n]
            for k in range(1, q):
                there = there[symbols[there + k] >= 0]
            if not len(there):
                continue
            codes = _hash([symbols[there + k] for k in range(q)])
            low = np.searchsorted(runs, codes, "left")
            high = np.searchsorted(runs, codes, "right")
            n = high - low
            if not n.any():
                continue
            width = of[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            order = np.argsort(width, kind="stable")
            width, there = width[order], np.repeat(there, n)[order]
            cuts = np.flatnonzero(width[1:] != width[:-1]) + 1
            for first, last in zip(np.append(0, cuts).tolist(), np.append(cuts, len(width)).tolist()):
                own = self.widths[width[first]]
                if last - first >= own.need and len(starts := own.near(there[first:last])):
                    asked.append((own, starts))
        if not asked:
            return []
        unknown = np.flatnonzero(symbols < 0)
        symbols[unknown] = -2 - unknown  # words that no item has equal no other
        steps = np.unique(np.concatenate([own.sampled.reshape(-1) for own, _ in asked]))
        every = np.unique(np.concatenate([starts for _, starts in asked]))
        pairs = []
        for k in range(0, len(every), rows := max(1, BLOCK // len(steps))):
            some = every[k:k + rows]
            far, met = walk(symbols, some, steps)
            for own, starts in asked:
                mine = np.flatnonzero(np.isin(some, starts, assume_unique=True))
                if len(mine):
                    pairs.append(own.candidates(some[mine], steps, far[:, mine], met[:, mine]))
        windows, starts = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        return self.confirm(symbols, self.of[windows], starts - self.offset[windows])

    def confirm(self, symbols: np.ndarray, items: np.ndarray, starts: np.ndarray) -> list[tuple[object, int, int]]:
        """Of candidates those with a passage within the item's edits: the best of each item."""
        order = np.lexsort((starts, items))
        items, starts = items[order], starts[order]
        budget = np.array(self.edits, np.int64)[items]
        cuts = np.flatnonzero((items[1:] != items[:-1]) | (starts[1:] - starts[:-1] > 2 * budget[1:] + 1)) + 1
        best: dict[int, tuple[int, int]] = {}
        for group in np.split(np.arange(len(items)), cuts):
            if len(group):
                item, first, last = int(items[group[0]]), int(starts[group[0]]), int(starts[group[-1]])
                w, t = len(self.symbols[item]), self.edits[item]
                # what edits before a piece have moved it by
                moved = t if w > PIECE else 0
                region = symbols[max(0, first - t - moved):max(0, last + w + 2 * t + moved)]
                # each word of the item that is not there costs an edit
                edits = passage_distance(self.symbols[item], region) if np.count_nonzero(np.isin(self.symbols[item], region)) >= w - t else t + 1
                if edits <= t and (item not in best or edits < best[item][0]):
                    places = np.unique(np.maximum(starts[group], 0))
                    around = places[:, None] + np.arange(w)
                    differ = (symbols[np.minimum(around, len(symbols) - 1)] != self.symbols[item]) | (around >= len(symbols))
                    best[item] = (edits, int(places[np.argmin(differ.sum(axis=1))]))
        return [(self.ids[item], *found) for item, found in sorted(best.items())]


def _passes(items: DataFrame, key: list[str], text: str) -> list[DataFrame]:
    """The items in parts of bounded size, by a hash."""
    size = items.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    n = max(1, -(-size["n"] // PASS_ITEMS), -(-(size["chars"] or 0) // PASS_CHARS))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 1) -> DataFrame:
    """Occurrences of items in documents: ``id_col, item_col, edits, at_word``."""
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"{id_col} string, {item_col} string, edits int, at_word int"
    items = benchmark.select(F.col(item_col).cast("string"), item_text_col)
    rows = docs.select(F.col(id_col).cast("string").alias(id_col), text_col)
    found = []
    for own in _passes(items, [item_col, item_text_col], item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.distinct().collect()])

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            searched = Items(shared.value, edits, min_words)
            for batch in batches:
                hits = [(key, *hit) for key, text in zip(batch[id_col].tolist(), batch[text_col].tolist()) for hit in searched.search(text)]
                yield pd.DataFrame(hits, columns=[id_col, item_col, "edits", "at_word"])

        found.append(rows.mapInPandas(search, schema))
    out = reduce(DataFrame.unionByName, found)
    return out.withColumns({id_col: F.col(id_col).cast(id_type), item_col: F.col(item_col).cast(item_type)})


def _clean(shared, edits: float, min_words: int):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(shared.value, edits, min_words)
        for texts in batches:
            yield pd.Series([not items.search(t) for t in texts], dtype=bool)

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", min_words: int = 1) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    items = benchmark.select(F.lit("0").alias("item_id"), "text")
    for own in _passes(items, ["text"], "text"):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.distinct().collect()])
        docs = docs.where(_clean(shared, edits, min_words)(F.col(text_col)))
    return docs


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_leaks": op5_benchmark_leaks}
