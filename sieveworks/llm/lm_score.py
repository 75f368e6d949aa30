"""Language-model scores from a log-frequency Bloom filter.

Training counts of word pairs are quantised on a logarithmic scale (level
``1 + floor(log(count) / log(BASE))``). A pair of level q enters a Bloom filter
as the q keys (pair, 1) .. (pair, q). Its level is read back by probing
(pair, 1), (pair, 2), .. until the first miss, so a count can only be read too
high, with the filter's small error rate. The pair probability is mixed with
the exact one-word probability:

    p(w | u) = MIX * low(level(u, w)) / c(u) + (1 - MIX) * base(w)

where ``low`` is the smallest count of a level, c(u) the exact training count
of u (texts begin with an empty word that counts as one per text) and base(w)
the contract's add-0.1 probability. ``low`` never exceeds the true count, so
the mixture sums to at most one but for filter errors.

How it runs, all sizes alike:

1. Every task cuts its rows into chunks and replaces words by numbers in the
   chunk's own word list (64-bit hashes of words). Chunks are checkpointed.
2. Chunks send their word and pair counts, packed by hash bucket, to bucket
   tasks, which add them up. A word costs one entry a chunk however often it
   occurs, so frequent words make no hot task.
3. Bucket tasks answer with each chunk's exact word counts, and build their
   shard of the filter. The shards are broadcast together if their size, known
   before, is within ``BROADCAST_BYTES``. Beyond that, chunks send their pairs
   to the shards and get levels back by the same exchange; the filter's bits,
   and so the scores, are the same.
4. Every chunk scores its texts.

Hashes of 64 bits stand for words: two of n distinct words share one with a
chance of about n^2 / 2^65. Pairs have 48-bit keys; a key shared by chance reads
as a too high count, far more rarely than the filter itself errs.

Defined results: null text is empty and consists of one end token; repeated
rows count and are scored each; an empty table gives no rows; with no training
rows every count is zero and base is 0.1 / 0.1 = 1 token share by the formula.
Texts are used whole, and further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, table

#: Tokens after which a task closes a chunk.
CHUNK_TOKENS = 3_000_000
#: Word and pair entries that a bucket task holds at once, about.
BUCKET_ENTRIES = 2_000_000
BASE = 2.0
MIX = 0.3
#: Bits for each key of the filter, and probes for each key.
BITS_PER_KEY = 10
PROBES = 5
#: The filter is broadcast up to this size.
BROADCAST_BYTES = 192 << 20
SHARDS_SEED = 0x9E3779B97F4A7C15
#: Fixed hashes of the end token and of the empty word before a text.
END, START = np.uint64(0x5EED0E17D), np.uint64(0x5EED57A27)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) over unsigned integers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of word pairs: the upper 48 of 64 bits."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(SHARDS_SEED) + mixed(right)) & ~np.uint64(0xFFFF)


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes, one plane for each byte of a value: sorted keys and small numbers get short."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    """The values of ``packed``."""
    import zstandard

    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where ascending keys pass from one bucket (an equal range of keys) to the next."""
    return np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets + 1))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their total counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Words(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


CHUNK = "chunk string, ids array<string>, trains binary, ends binary, tokens binary, words binary, n_words long, n_tokens long"


def chunks(docs: DataFrame, id_col: str, text_col: str, train_col: str) -> DataFrame:
    """Encoded chunks of documents."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        words, ids, trains, ends, tokens, size = _Words(), [], [], [], [], 0

        def close() -> pd.DataFrame:
            names = [None] * len(words)
            for word, k in words.items():
                names[k] = word
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
            hashes = np.concatenate((hashes, [END, START]))
            end = len(names)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.array(ends, np.int64)
            # each text: its words, then the end token
            text_of = np.repeat(np.arange(len(ends)), sizes)
            flat = np.empty(int(sizes.sum()) + len(ends), np.int32)
            flat[np.arange(int(sizes.sum())) + text_of] = np.concatenate(tokens) if tokens else []
            last = np.cumsum(sizes + 1) - 1
            flat[last] = end
            flat = place[flat]
            return pd.DataFrame([{
                "chunk": f"{task}:{number}", "ids": ids, "trains": np.array(trains, bool).tobytes(), "ends": (last + 1).tobytes(),
                "tokens": packed(flat.astype(np.int32)), "words": packed(hashes[order]), "n_words": len(hashes), "n_tokens": len(flat),
            }])

        for batch in batches:
            for key, text, train in zip(batch[id_col].tolist(), batch[text_col].tolist(), batch[train_col].tolist()):
                own = list(map(words.__getitem__, ascii_words(text)))
                ids.append(key)
                trains.append(train)
                ends.append(len(own))
                tokens.append(np.array(own, np.int32))
                size += len(own) + 1
                if size >= CHUNK_TOKENS:
                    yield close()
                    number += 1
                    words, ids, trains, ends, tokens, size = _Words(), [], [], [], [], 0
        if ids:
            yield close()

    return docs.select(F.col(id_col).cast("string").alias(id_col), text_col, train_col).mapInPandas(encode, CHUNK)


def pairs_of(ends: bytes, tokens: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair keys of a chunk's tokens, the tokens, their left neighbours and where texts end."""
    flat, ends_ = unpacked(tokens, np.int32), np.frombuffer(ends, np.int64)
    before = np.concatenate(([0], flat[:-1]))
    before[np.concatenate(([0], ends_[:-1]))] = np.searchsorted(hashes, START)
    return pair_keys(hashes[before], hashes[flat]), flat, before, ends_


SENT = "bucket int, chunk string, keys binary, counts binary"


def slices(chunk: str, keys: np.ndarray, buckets: int, counts: np.ndarray | None = None) -> pd.DataFrame:
    """A chunk's ascending keys cut by bucket, without empty slices: never more rows than keys, however many buckets there are."""
    at = np.concatenate(([0], bucket_cuts(keys, buckets), [len(keys)]))
    full = np.flatnonzero(np.diff(at))
    out = {"bucket": full, "chunk": chunk, "keys": [packed(keys[at[b]:at[b + 1]]) for b in full]}
    if counts is not None:
        out["counts"] = [packed(counts[at[b]:at[b + 1]]) for b in full]
    return pd.DataFrame(out)


def bucketed(chunked: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Training counts of every chunk's words or pairs, one row per chunk and bucket of keys that it has."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, trains, ends, tokens, words in zip(*(batch[c] for c in ("chunk", "trains", "ends", "tokens", "words"))):
                hashes = unpacked(words, np.uint64)
                keys, flat, _, ends_ = pairs_of(ends, tokens, hashes)
                trains_ = np.frombuffer(trains, bool)
                train = np.repeat(trains_, np.diff(ends_, prepend=0))
                if kind == "words":
                    keys, counts = hashes, np.bincount(flat[train], minlength=len(hashes))
                    counts[np.searchsorted(hashes, START)] += int(trains_.sum())
                else:
                    keys, counts = np.unique(keys[train], return_counts=True)
                yield slices(chunk, keys, buckets, counts.astype(np.uint32))

    return chunked.select("chunk", "trains", "ends", "tokens", "words").mapInPandas(send, SENT)


def _gathered(group: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [unpacked(k, np.uint64) for k in group["keys"]]
    counts = [unpacked(c, np.uint32).astype(np.int64) for c in group["counts"]]
    return parts, *summed(np.concatenate(parts), np.concatenate(counts))


def word_answers(sent: DataFrame) -> DataFrame:
    """Exact corpus counts for every chunk's words, and the bucket's totals."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts, keys, counts = _gathered(group)
        seen = (counts > 0) & (keys != START)
        rows = [(c, int(b), packed(counts[np.searchsorted(keys, p)])) for c, b, p in zip(group["chunk"], group["bucket"], parts)]
        out = pd.DataFrame(rows, columns=["chunk", "bucket", "counts"])
        out["n"], out["v"] = 0, 0
        if len(out):
            out.loc[0, "n"], out.loc[0, "v"] = int(counts[seen].sum()), int(seen.sum())
        return out

    return sent.groupBy("bucket").applyInPandas(answer, "chunk string, bucket int, counts binary, n long, v long")


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised levels of positive counts."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def lowest(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


class Shard:
    """One shard of the filter: an array of 64-bit words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Shard:
        """Inserts (key, 1) .. (key, level) for every key."""
        level = levels_of(counts)
        words = max(8, int(level.sum()) * BITS_PER_KEY // 64 + 1)
        shard = cls(np.zeros(words, np.uint64))
        for j in range(1, int(level.max(initial=0)) + 1):
            own = keys[level >= j]
            for word, bit in shard._at(own, j):
                np.bitwise_or.at(shard.bits, word, bit)
        return shard

    def _at(self, keys: np.ndarray, j: int):
        with np.errstate(over="ignore"):
            a = mixed(keys + np.uint64(j) * np.uint64(SHARDS_SEED))
            b = mixed(a ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
            for i in range(PROBES):
                h = a + np.uint64(i) * b
                yield ((h >> np.uint64(32)) * np.uint64(len(self.bits)) >> np.uint64(32)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of every key: probes until the first miss."""
        level = np.zeros(len(keys), np.int64)
        at, j = np.arange(len(keys)), 1
        while len(at):
            hit = np.ones(len(at), bool)
            for word, bit in self._at(keys[at], j):
                hit &= self.bits[word] & bit != 0
            at = at[hit]
            level[at] += 1
            j += 1
        return level


def read_levels(shards: dict[int, np.ndarray], buckets: int, keys: np.ndarray) -> np.ndarray:
    """Levels of ascending keys from shards by bucket."""
    parts = np.split(keys, bucket_cuts(keys, buckets))
    return np.concatenate([Shard(shards[b]).read(p) if b in shards else np.zeros(len(p), np.int64) for b, p in enumerate(parts)])


def filter_shards(sent: DataFrame) -> DataFrame:
    """The filter, one shard a bucket: (bucket, bits)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _gathered(group)
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "bits": [Shard.build(keys, counts).bits.tobytes()]})

    return sent.groupBy("bucket").applyInPandas(build, "bucket int, bits binary")


def asked_levels(chunked: DataFrame, shards: DataFrame, buckets: int) -> DataFrame:
    """For filters above the broadcast bound: each chunk's pairs go to the shards and levels come back."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, ends, tokens, words in zip(batch["chunk"], batch["ends"], batch["tokens"], batch["words"]):
                keys = np.unique(pairs_of(ends, tokens, unpacked(words, np.uint64))[0])
                yield slices(chunk, keys, buckets)

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(np.frombuffer(own["bits"].iloc[0], np.uint64)) if len(own) else None
        rows = []
        for chunk, bucket, keys in zip(asked["chunk"], asked["bucket"], asked["keys"]):
            keys = unpacked(keys, np.uint64)
            level = shard.read(keys) if shard else np.zeros(len(keys), np.int64)
            rows.append((chunk, int(bucket), packed(level.astype(np.uint8))))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "levels"])

    asked = chunked.select("chunk", "ends", "tokens", "words").mapInPandas(ask, "bucket int, chunk string, keys binary")
    return asked.groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInPandas(answer, "chunk string, bucket int, levels binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "is_training") -> DataFrame:
    """Scores all rows, learning from those whose ``train_col`` is true.

    Returns ``id_col, n_tokens, n_known, train_tokens, base_score, score``.
    """
    chunked = checkpointed(chunks(docs, id_col, text_col, train_col))
    size = chunked.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("p")).first()
    word_buckets = max(8, -(-(size["w"] or 0) // BUCKET_ENTRIES))
    pair_buckets = max(16, -(-(size["p"] or 0) // BUCKET_ENTRIES))
    answers = checkpointed(word_answers(bucketed(chunked, "words", word_buckets).repartition(word_buckets, "bucket")))
    totals = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)

    shards = checkpointed(filter_shards(bucketed(chunked, "pairs", pair_buckets).repartition(pair_buckets, "bucket")))
    bits = int(shards.agg(F.sum(F.octet_length("bits"))).first()[0] or 0)
    grouped = answers.select("chunk", F.struct("bucket", "counts").alias("a")).groupBy("chunk").agg(F.array_sort(F.collect_list("a")).alias("answers"))
    rows = chunked.select("chunk", "ids", "ends", "tokens", "words").join(grouped, "chunk")
    shared = None
    if bits <= BROADCAST_BYTES:
        collected = {r["bucket"]: bytes(r["bits"]) for r in shards.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(collected)
        del collected
        rows = rows.withColumn("levels", F.lit(None).cast("array<struct<bucket:int,levels:binary>>"))
    else:
        levels = asked_levels(chunked, shards, pair_buckets).select("chunk", F.struct("bucket", "levels").alias("l"))
        rows = rows.join(levels.groupBy("chunk").agg(F.array_sort(F.collect_list("l")).alias("levels")), "chunk")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards_ = {b: np.frombuffer(x, np.uint64) for b, x in shared.value.items()} if shared else {}
        for batch in batches:
            for ids, ends, tokens, words, answers_, levels_ in zip(*(batch[c] for c in ("ids", "ends", "tokens", "words", "answers", "levels"))):
                counts = np.concatenate([unpacked(a["counts"], np.int64) for a in answers_])
                keys, flat, before, ends_ = pairs_of(ends, tokens, unpacked(words, np.uint64))
                distinct, inverse = np.unique(keys, return_inverse=True)
                if shared:
                    level = read_levels(shards_, pair_buckets, distinct)
                else:
                    level = np.concatenate([unpacked(x["levels"], np.uint8) for x in levels_]).astype(np.int64)
                # a chunk's tokens are many: arrays go as soon as they are used
                full = lowest(level)[inverse]
                del keys, distinct, inverse, level
                context = counts[before]
                known = context > 0
                np.divide(full, context, out=full, where=known)
                full[~known] = 0
                del before, context
                np.minimum(full, 1.0, out=full)
                full *= MIX
                base = ((counts + 0.1) / (n + 0.1 * (v + 1)))[flat]
                full += np.where(known, 1 - MIX, 1.0) * base
                np.log10(full, out=full)
                np.log10(base, out=base)
                starts = np.concatenate(([0], ends_[:-1]))
                out = {
                    id_col: list(ids), "n_tokens": ends_ - starts, "n_known": np.add.reduceat((counts[flat] > 0).astype(np.int64), starts), "train_tokens": n,
                    "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(full, starts),
                }
                del flat, full, base, known
                yield pd.DataFrame(out)

    out = rows.mapInPandas(judge, f"{id_col} string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn(id_col, F.col(id_col).cast(dict(docs.dtypes)[id_col]))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) is divisible by 10 are held out."""
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("is_training", ~out_of)
    out = score(docs).withColumn("held_out", out_of)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_score": op8_lm_score}
