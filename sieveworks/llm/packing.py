"""Best-fit packing of tokenised documents into fixed-size sequences.

Best-fit decreasing: pieces are taken longest first, each goes to the open
sequence with the least room that still holds it, else to a new one. The open
sequences are kept by remaining room in a segment tree over the rooms
0..capacity, whose nodes say whether any open sequence has a room in their
range, so the tightest fit is found in O(log capacity).

Pieces of one length are interchangeable. So the plan is made from the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus) and
handles a run of equal pieces, and a run of sequences with equal room, in one
step; that gives the very sequences that piece-by-piece best-fit decreasing
gives. Its steps say: pieces ``first..`` of this length, ``each`` to a sequence,
go to sequences ``sequence..`` at ``offset``. Spark then numbers the pieces of
each length and looks up their step. No step depends on how rows were dealt.

Defined results: null text counts as empty; an empty text is the end id alone;
repeated rows are packed each; further input columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Pieces that one task numbers; the number of parts follows the number of pieces.
PIECES_PER_PART = 100_000
#: A run of white space that the fast matcher may not get through.
LONG_RUN = 10_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER):
    """Text to ids.

    ``name`` is a public byte-level vocabulary without its suffix: the same one
    is published as ``.json`` for tokenizers and as ``.tiktoken`` ranks. Both
    give the same ids, also of the added tokens, which the ``.json`` lists. The
    ranks encode over four times as fast, but their pattern matcher gives up on
    very long runs of white space: texts with those go to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file).get("added_tokens", ())}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={token: rank for token, rank in ranks.items() if rank not in added.values()}, special_tokens=added)
    fast, whole = partial(encoding.encode, allowed_special="all"), []

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG_RUN.search(text):
            try:
                return fast(text)
            except ValueError:  # the matcher gave up
                pass
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenises whole texts: ``id_col, piece, start, length`` and ``ids`` or ``ids_crc32``."""
    id_type = dict(docs.dtypes)[id_col]
    last = "ids array<int>" if with_ids else "ids_crc32 long"

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col].tolist(), batch[text_col].tolist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start:start + length]
                    rows.append((key, number, start, length, own.astype(np.int32) if with_ids else zlib.crc32(own.tobytes())))
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", last.split()[0]])

    # ids travel as text: pandas would turn longs into doubles beside a null
    rows = docs.select(F.col(id_col).cast("string").alias(id_col), text_col)
    out = rows.mapInPandas(tokenise, f"{id_col} string, piece int, start long, length long, {last}")
    return out.withColumn(id_col, F.col(id_col).cast(id_type))


class RoomTree:
    """A segment tree over rooms: which rooms have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        """Marks a room; O(log capacity)."""
        node = room + self.leaves
        self.any[node] = there
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int:
        """The smallest marked room of at least ``least``, or -1; O(log capacity)."""
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns steps (length, first, each, sequence, offset), in order of length
    (falling) and first: from piece number ``first`` of that length on, ``each``
    consecutive pieces go into every sequence from ``sequence`` on.
    """
    tree, runs, steps, opened = RoomTree(capacity), {}, [], 0

    def keep(room: int, first: int, count: int) -> None:
        if count and room:
            runs.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            room = tree.tightest(length)
            if room < 0:
                room, first, count = capacity, opened, -(-(total - done) // (capacity // length))
                opened += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
            each = room // length
            full = min(count, (total - done) // each)
            if full:
                steps.append((length, done, each, first, capacity - room))
                done += full * each
                keep(room - each * length, first, full)
            if full < count and done < total:  # one sequence takes what is left
                steps.append((length, done, each, first + full, capacity - room))
                keep(room - (total - done) * length, first + full, 1)
                done, full = total, full + 1
            keep(room, first + full, count - full)
    return steps


def place(parts: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, by their ``length`` alone.

    ``parts`` must be fixed (a table or a checkpoint): it is read twice. Each
    length is split by a hash of ``order_by`` into parts of about
    ``PIECES_PER_PART`` rows, so that a very common length is no single task.
    """
    n = parts.count()
    salts = max(8, -(-n // PIECES_PER_PART))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # within a length: how many pieces the earlier parts hold
    from pyspark.sql import Window as W

    before = F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    sizes = checkpointed(sizes.withColumn("_before", F.coalesce(before, F.lit(0))))
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    by_length = {int(k): steps[steps[:, 0] == k, 1:] for k in np.unique(steps[:, 0])}
    shared = parts.sparkSession.sparkContext.broadcast(by_length)

    numbered = salted.withColumn("_k", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order_by)))
    numbered = numbered.join(sizes.select("length", "_salt", "_before"), ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sizes_, rank = length.to_numpy(), number.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(sizes_):
            at = np.flatnonzero(sizes_ == size)
            own = shared.value[int(size)]
            step = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
            nth = rank[at] - step[:, 0]
            sequence[at] = step[:, 2] + nth // step[:, 1]
            offset[at] = step[:, 3] + nth % step[:, 1] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = numbered.withColumn("_at", look_up(F.col("length"), F.col("_before") + F.col("_k") - 1))
    return out.withColumns({"sequence_id": F.col("_at.sequence_id"), "offset": F.col("_at.offset")}).drop("_salt", "_k", "_before", "_at")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenises, cuts and packs documents; one row per piece."""
    parts = checkpointed(pieces(docs, id_col, text_col, capacity, tokenizer, end_id, with_ids))
    return place(parts, capacity, (id_col, "piece"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; ids appear as their crc32."""
    out = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
