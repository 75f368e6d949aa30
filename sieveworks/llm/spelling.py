"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Counting. Tasks count words (maximal runs of letters) of whole texts, so that
each sends a word once per ``HELD`` distinct words, and Spark adds up.

Near words. Let a word ``w`` of ``size`` code points arise from ``q`` by
replacing or inserting the one at position ``i``. Then ``q`` and ``w`` agree before ``i`` and
after it: in the words sorted forwards those that begin like ``q`` are an
interval, in the words sorted by their reversed spelling those that end like it
are an interval, and ``w`` is in both. A wavelet tree over the reverse ranks in
forward order reports the words in such a rectangle, level by level, without
looking at those outside. Deletions are insertions read the other way.

Partitioning. An edit at ``i >= size // 2`` leaves the first half of ``w`` alone, any
other the second. So each word goes, once for either half, to the tree of its
size, and as a query to the trees of its own size and of the next: four rows a word, dealt
by what the edit leaves alone. A key that more than ``HOT`` rows share is cut:
its range of edit positions is halved and its rows are dealt by what each half
leaves alone, and so on. A range of one position leaves all but one code point
alone, so a key has no more words than there are letters. Every task so holds
a bounded number of rows, and no row or pair is dropped; each pair is reported
once, since of the positions at which an insertion can be made only the last
counts. Tasks return one row per word, not per pair.

Roots follow the forms by doubling: a form has twice the word's count, so the
rounds grow with the logarithm of the logarithm of the largest count.

Defined results: a null text has no words; a null id is an empty string in the hash;
repeated rows count as often as they occur; among near words of one count the
first in code-point order is the form; words without near words have null
``form`` and themselves as ``root``; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: What a word is made of.
LETTERS = "A-Za-z\u00C0-\u00FF"
#: Distinct words that a task holds while it counts, and characters of a text that it reads at once.
HELD, READ = 200_000, 1 << 20
#: Rows of a task, and rows that may share a key.
PART, HOT = 40_000, 20_000
#: Rectangles that go through a tree at once.
CHUNK = 1 << 18

_RUN, _END = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``READ`` characters that cut no word."""
    at = 0
    while at < len(text):
        end = _END.search(text, at + READ)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def variant(prefix_crc: int, word: str, every: int) -> str:
    """The lower-cased word, less one code point where the hash of ``<doc_id>:<word>`` is divisible by ``every``."""
    lowered = word.encode("utf-8").lower()
    hashed = zlib.crc32(lowered, prefix_crc)
    word = lowered.decode("utf-8")
    if hashed % every == 0:
        at = hashed % len(word)
        word = word[:at] + word[at + 1:]
    return word


def counted(documents: DataFrame, least_size: int = 5, every: int = 97) -> DataFrame:
    """Words of at least ``least_size`` code points and how often they occur: ``word, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                crc = zlib.crc32(f"{key.as_py()}:".encode())
                for piece in pieces(text.as_py()):
                    for run, n in Counter(_RUN.findall(piece)).items():
                        if len(run) >= least_size:
                            word = variant(crc, run, every)
                            if len(word) >= least_size:
                                held[word] += n
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    rows = documents.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Reports the values of a permutation inside rectangles of (place, value), many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - ones))))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (rectangle, value) with the value's place in [x1, x2) and the value in [y1, y2)."""
        which = np.flatnonzero((x2 > x1) & (y2 > y1))
        low, high, value = x1[which], x2[which], np.zeros(len(which), np.int64)
        for level in range(self.bits):
            half = 1 << (self.bits - 1 - level)
            zeros, split = self.zeros[level], self.split[level]
            low0, high0 = zeros[low], zeros[high]
            left = (high0 > low0) & (value < y2[which]) & (value + half > y1[which])
            low1, high1 = split + low - low0, split + high - high0
            right = (high1 > low1) & (value + half < y2[which]) & (value + 2 * half > y1[which])
            which = np.concatenate((which[left], which[right]))
            low, high = np.concatenate((low0[left], low1[right])), np.concatenate((high0[left], high1[right]))
            value = np.concatenate((value[left], value[right] + half))
        return which, value


class _Order:
    """Words in one order: places, and the interval of words that share a prefix."""

    def __init__(self, words: list[str], width: int, in_tree: np.ndarray):
        self.order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.place = np.empty(len(words), np.int64)
        self.place[self.order] = np.arange(len(words))
        text = np.array([words[k] for k in self.order], f"<U{width}").view(np.uint32).reshape(len(words), width)
        differ = text[1:] != text[:-1]
        #: code points shared with the word before
        self.shared = np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), width)))
        self.before = np.concatenate(([0], np.cumsum(in_tree[self.order])))

    def interval(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the tree's words that share its first ``size`` code points, as an interval of their places."""
        index = np.arange(len(self.order))
        first = np.maximum.accumulate(np.where(self.shared < size, index, 0))
        starts = np.append(np.flatnonzero(self.shared < size), len(index))
        end = starts[np.searchsorted(starts, index, "right")]
        return self.before[first][self.place], self.before[end][self.place]


def near_pairs(words: list[str], size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) by an edit at a position of [first, last) of a word of ``size`` code points.

    ``words`` are distinct, of ``size`` code points or one less. Either both words have ``size`` code points and differ at one
    position, or the second arises from the first by an insertion; the other direction of insertions is not in the result.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    in_tree = sizes == size
    tree = np.flatnonzero(in_tree)
    none = np.zeros(0, np.int64)
    if not len(tree):
        return none, none
    forward, backward = _Order(words, size, in_tree), _Order([w[::-1] for w in words], size, in_tree)
    by_place, by_value = tree[np.argsort(forward.place[tree])], tree[np.argsort(backward.place[tree])]
    value = np.empty(len(words), np.int64)
    value[by_value] = np.arange(len(tree))
    wavelet = WaveletTree(value[by_place])
    letters = np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)
    out, held, n_held = [], [], 0
    for i in range(first, last):
        x1, x2 = forward.interval(i)
        y1, y2 = backward.interval(size - 1 - i)
        # a replaced code point: a word beside the word itself; an inserted one: any word
        for q in (np.flatnonzero(in_tree & (x2 - x1 > 1) & (y2 - y1 > 1)), np.flatnonzero(~in_tree & (x2 > x1) & (y2 > y1))):
            held.append((q, np.full(len(q), i), x1[q], x2[q], y1[q], y2[q]))
            n_held += len(q)
        if n_held < CHUNK and i < last - 1:
            continue
        q, place, *box = (np.concatenate(c) for c in zip(*held))
        held, n_held = [], 0
        for at in range(0, len(q), CHUNK):
            k, v = wavelet.report(*(c[at:at + CHUNK] for c in box))
            a, b, at_place = q[at:at + CHUNK][k], by_value[v], place[at:at + CHUNK][k]
            # an insertion that can be made one place further on as well is left to that place
            keep = np.where(in_tree[a], a != b, letters[a, at_place] != letters[b, at_place])
            out.append((a[keep], b[keep]))
    asked, found = zip(*out) if out else ((none,), (none,))
    return np.concatenate(asked), np.concatenate(found)


def best_near(words: list[str], counts: np.ndarray, size: int, first: int, last: int) -> pd.DataFrame:
    """Each word's number of near words in this tree and the best of them: ``word, near, best_n, best``."""
    a, b = near_pairs(words, size, first, last)
    both = np.fromiter(map(len, words), np.int64, len(words))[a] < size
    a, b = np.concatenate((a, b[both])), np.concatenate((b, a[both]))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    own, at, near = np.unique(a, return_index=True, return_counts=True)
    return pd.DataFrame({"word": [words[k] for k in own], "near": near, "best_n": counts[b[at]], "best": [words[k] for k in b[at]]})


def _dealt(words: DataFrame) -> DataFrame:
    """Words as rows of their trees: ``word, n, size, first, last, key``; no key has more than HOT rows if its range can be cut."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    ranges = F.array(*(F.struct(a.alias("first"), b.alias("last")) for a, b in ((F.lit(0), half), (half, F.col("size")))))
    rows = rows.withColumn("range", F.explode(ranges)).select("word", "n", "size", "range.first", "range.last")
    done = None
    while True:
        # what an edit in [first, last) leaves alone; a word that is one short has one code point less there
        rest = F.substring(F.col("word"), F.col("last") + 1 - (F.col("size") - F.length("word")), F.length("word"))
        keyed = rows.withColumn("key", F.xxhash64("size", "first", "last", F.substring(F.col("word"), F.lit(1), F.col("first")), rest))
        hot = keyed.where(F.col("last") - F.col("first") > 1).groupBy("key").count().where(F.col("count") > HOT).select("key")
        hot = stored(hot)
        if hot.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        # at most one key for every HOT rows
        cool = keyed.join(F.broadcast(hot), "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        cut = F.array(F.struct(F.col("first"), middle.alias("last")), F.struct(middle.alias("first"), F.col("last")))
        rows = stored(keyed.join(F.broadcast(hot), "key", "left_semi").withColumn("range", F.explode(cut)).select("word", "n", "size", "range.first", "range.last"))


def near_words(words: DataFrame) -> DataFrame:
    """Each word that has near words, how many, and the best: ``word, n_near, best_n, best``.

    ``words`` has distinct ``word`` and their ``n``.
    """
    parts = max(1, -(-4 * words.count() // PART))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (size, first, last), rows in group.groupby(["size", "first", "last"]):
            found.append(best_near(rows["word"].tolist(), rows["n"].to_numpy(np.int64), int(size), int(first), int(last)))
        return pd.concat(found, ignore_index=True)

    dealt = _dealt(words).withColumn("part", F.pmod("key", F.lit(parts)))
    found = dealt.groupBy("part").applyInPandas(search, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    out = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms: ``word, root`` from ``word, form``; chains must not be rings."""
    ends = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ends = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ends


def spelling_variants(documents: DataFrame, least_size: int = 5, least_n: int = 3, factor: int = 2, every: int = 97) -> DataFrame:
    """Words with their near words: ``word, form, root, n, n_near, form_n``.

    A form is the near word of largest count, if that is at least ``factor``
    (over 1) times the word's.
    """
    if factor <= 1:
        raise ValueError("forms lead to larger counts only if the factor is over 1")
    words = stored(counted(documents, least_size, every).where(F.col("n") >= least_n))
    out = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    out = stored(out.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    out = out.join(roots(out.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its form, root and counts."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
own AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS k, *, list_transform(string_split(d || ':' || run, ''), lambda x: unicode(x)) AS points FROM own),
bytes AS MATERIALIZED (SELECT k, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)) AS b FROM numbered),
bits AS (SELECT range AS i, range AS c, 0 AS step FROM range(256)
         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS MATERIALIZED (SELECT i, c FROM bits WHERE step = 8),
crc AS (SELECT k, b, 1 AS pos, 4294967295::BIGINT AS c FROM bytes
        UNION ALL SELECT k, b, pos + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c & 255, b[pos]) WHERE pos <= len(b)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM crc JOIN numbered USING (k) WHERE pos = len(b) + 1),
variants AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM variants WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.rest
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
                       FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms
JOIN (SELECT chain.word, root FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NULL) USING (word)"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
SQL = {"op13_spelling_variants": _SQL}
