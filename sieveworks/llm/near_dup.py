"""Near-duplicate documents by circulant MinHash.

A text's set holds the distinct k-word shingles of its words (A-Z
lower-cased). Two permutations make all signature coordinates: the first
scrambles the elements, the second is applied after a circular shift by k for
coordinate k, and the least value is the coordinate:

    h_k(S) = min over s in S of pi((sigma(s) + k) mod 2^32)

Both are bijections of the 32-bit numbers, so the shift wraps around by itself.
Coordinates are banded; documents that share a band are candidates. With bands
of 4 rows, 24 of them, a pair at similarity 0.85 is missed with a chance of
2e-8, at 0.8 of 3e-6.

1. Rows with equal sets form one class, by a 64-bit hash of the whole set.
2. Inside each band value classes are compared by their signatures, one byte a
   coordinate: first all with the smallest, then those that are not near it
   with all. Classes are near if their signatures agree as far as five standard
   deviations below the threshold. Each task gives a spanning forest of the
   near pairs, never all of them; large band values are cut into tiles.
3. Components of these edges are blocks: small groups of likely links, not the
   closure of everything that shares a band. Full sets are brought together by
   block, and links are confirmed on them. Inside a block a pair is compared
   unless both are already connected, or sizes or signatures rule it out.
   A large block is cut into parts of at most ``TILE`` classes and ``TILE_BYTES``
   of sets, which meet the block's first class as well; only classes outside
   the block's largest component then meet all other parts.
4. Components of the confirmed links give the result.

Defined results: a null or blank text has an empty set, is linked with nothing
and is its own component; texts with fewer words than a shingle have their
whole sequence as the one shingle; equal sets are linked; rows with a null id
take part and are kept only if their component has no other id; repeated rows
belong to the component of their set; further input columns are ignored. An
empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, table
from .components import components

ROWS, BANDS = 4, 24
COORDINATES = ROWS * BANDS
#: Classes whose sets are compared with each other in one task.
TILE, TILE_BYTES = 2000, 64 << 20
#: Signatures of a band value that are compared with each other in one task.
BAND_TILE = 4096
#: Shingles that are permuted at once, and rows whose sets a worker holds.
BLOCK, ROWS_AT_ONCE = 1 << 15, 512


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most ``ROWS_AT_ONCE`` rows, so that a worker holds few sets and signatures at a time."""
    for batch in batches:
        for k in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.iloc[k:k + ROWS_AT_ONCE]


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Ascending 64-bit hashes of a text's distinct shingles."""
    own = ascii_words(text)
    if not own:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(own) - size + 1)
    out = np.full(n, min(len(own), size), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(own))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return np.unique(out)


def permuted(x: np.ndarray, out: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The second permutation, a bijection of the 32-bit numbers, in place."""
    for right, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(right), out=shift)
        np.bitwise_xor(x, shift, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=shift)
    np.bitwise_xor(x, shift, out=out)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, one row each."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        # the first permutation of the elements, kept to 32 bits
        first = (mix64(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        x, shift = np.empty_like(first), np.empty_like(first)
        for k in range(COORDINATES):
            np.add(first, np.uint32(k), out=x)
            out[at:end, k] = np.minimum.reduceat(permuted(x, x, shift), starts)
        at = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of a signature's bands."""
    rows = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return out.view(np.int64)


def row_key(id_col: str, text_col: str):
    """By which a row's text is found again: its id, or a hash of the text where that is null."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def described(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, row key, class key (null for an empty set), set size and signature."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = Words()
        for batch in parts_of(batches):
            sets = [shingle_set(t, size, words) for t in batch[text_col].tolist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, marks = [None] * len(sets), [None] * len(sets)
            for k, signature in zip(full, signatures([sets[k] for k in full])):
                keys[k] = str(np.uint64(xxhash.xxh3_64_intdigest(sets[k].tobytes())).view(np.int64))
                marks[k] = signature.tobytes()
            yield pd.DataFrame({"id": batch[id_col].tolist(), "rid": batch["rid"].tolist(), "key": keys, "n": [len(s) for s in sets], "signature": marks})

    rows = docs.select(F.col(id_col).cast("string").alias(id_col), text_col, row_key(id_col, text_col).alias("rid"))
    out = rows.mapInPandas(describe, "id string, rid long, key string, n long, signature binary")
    return out.withColumns({"id": F.col("id").cast(dict(docs.dtypes)[id_col]), "key": F.col("key").cast("long")})


def least_equal(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has but for five standard deviations."""
    share = percent / 100
    return int(np.floor(COORDINATES * (share - 5 * (share * (1 - share) / COORDINATES) ** 0.5)))


def _brief(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, COORDINATES)


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect all classes which share a band and have near signatures."""
    least_ = least_equal(percent)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts_of(batches):
            if len(batch):
                signature = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, COORDINATES)
                brief = [r.tobytes() for r in (signature & 0xFF).astype(np.uint8)]
                yield pd.DataFrame({"band": band_keys(signature).reshape(-1), "key": np.repeat(batch["key"].to_numpy(), BANDS), "brief": [x for x in brief for _ in range(BANDS)]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = (_brief(batch["brief"].tolist()) == _brief(batch["other"].tolist())).sum(axis=1) >= least_
                yield batch[["band", "key", "brief", "m", "least"]].assign(near=near)

    rows = classes.select("key", "signature").mapInPandas(bands, "band long, key long, brief binary")
    several = checkpointed(rows.select("band", "key").groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("m")).where("m > 1"))
    shared = checkpointed(rows.join(several, "band"))
    first = shared.where("key = least").select("band", F.col("brief").alias("other"))
    met = checkpointed(shared.where("key > least").join(first, "band").mapInPandas(compare, "band long, key long, brief binary, m long, least long, near boolean"))
    edges = met.where("near").select(F.col("least").alias("a"), F.col("key").alias("b"))

    # those not near the smallest meet all others of the band value
    far = met.where("NOT near AND m > 2")
    parts = far.groupBy("band").agg(F.ceil(F.count("*") / BAND_TILE).cast("int").alias("lefts"), F.ceil(F.max("m") / BAND_TILE).cast("int").alias("rights"))
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = far.join(parts, "band").select("band", "key", "brief", F.lit(True).alias("far"), part("lefts").alias("low"), each("rights").alias("high"))
    right = met.join(parts, "band").select("band", "key", "brief", F.lit(False).alias("far"), part("rights").alias("high"), each("lefts").alias("low"))

    def forest(rows_: pd.DataFrame) -> list[tuple[int, int]]:
        own, other = rows_[rows_["far"]], rows_[~rows_["far"]]
        keys, marks = other["key"].to_numpy(), _brief(other["brief"].tolist())
        label = dict(zip(keys.tolist(), range(len(keys))))
        groups, out = np.arange(len(keys)), []
        for k, (key, brief) in enumerate(zip(own["key"].tolist(), _brief(own["brief"].tolist()))):
            near = np.flatnonzero((marks == brief).sum(axis=1) >= least_)
            at = label.get(key)  # the same class may stand on both sides
            seen = np.unique(groups[near])
            mine = groups[at] if at is not None else (seen[0] if len(seen) else -1)
            if at is None and len(near):
                out.append((key, int(keys[near[groups[near] == mine][0]])))
            for g in seen:
                if g != mine:
                    out.append((key, int(keys[near[groups[near] == g][0]])))
                    groups[groups == g] = mine
        return out

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            own = batch[["band", "low", "high"]].to_numpy()
            cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            pieces = np.split(np.arange(len(batch)), cuts)
            found = []
            for n, piece in enumerate(pieces):
                rows_ = batch.iloc[piece]
                if held and (held[-1][["band", "low", "high"]].iloc[0].to_numpy() != own[piece[0]]).any():
                    found += forest(pd.concat(held))
                    held = []
                held.append(rows_)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(forest(pd.concat(held)), columns=["a", "b"], dtype="int64")

    both = left.unionByName(right)
    more = both.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInPandas(tiles, "a long, b long")
    return edges.unionByName(more).distinct()


def _spanning(sets: list[np.ndarray], marks: np.ndarray, percent: int, left: np.ndarray | None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets, but for those of one label; with ``left``, only pairs of a left and a right one."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    parent = np.arange(m) if labels is None else np.unique(labels, return_inverse=True)[1]
    enough = least_equal(percent)
    ends = np.cumsum(size)
    flat = np.concatenate(sets)
    links = []
    for i in range(1, m):
        near = np.flatnonzero((parent[:i] != parent[i]) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])))
        if left is not None:
            near = near[left[near] != left[i]]
        if len(near):
            equal = (marks[near] == marks[i]).sum(axis=1)
            near = near[np.argsort(-equal, kind="stable")][:np.count_nonzero(equal >= enough)]
        # the likeliest first: once connected, a whole component needs no more comparisons
        while len(near):
            step, near = near[:64], near[64:]
            lengths = size[step]
            rows = np.repeat(np.arange(len(step)), lengths)
            where = np.arange(int(lengths.sum())) + np.repeat(ends[step] - size[step] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            values = flat[where]
            at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
            common = np.bincount(rows[sets[i][at] == values], minlength=len(step))
            for j in step[100 * common >= percent * (lengths + size[i] - common)]:
                if parent[j] != parent[i]:
                    links.append((int(j), i))
                    low, high = sorted((parent[i], parent[j]))
                    parent[parent == high] = low
            near = near[parent[near] != parent[i]]
    return links


def confirmed(docs: DataFrame, blocks: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Spanning links ``a, b`` of the classes in ``blocks`` (key, block, rid, n, signature), confirmed on full sets."""
    counts = blocks.groupBy("block").agg(F.count("*").alias("m"), F.sum(F.col("n") * 8).alias("bytes"), F.min("key").alias("first"))
    split = F.ceil(F.greatest(F.col("m") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
    blocks = checkpointed(blocks.join(counts.select("block", "first", split.alias("parts")), "block"))
    texts = docs.select(row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = Words()
        for batch in parts_of(batches):
            rows = []
            for key, text in zip(batch["key"].tolist(), batch["text"].tolist()):
                own = shingle_set(text, size, words)
                if int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) == key:
                    rows.append((key, own.tobytes()))
            yield pd.DataFrame(rows, columns=["key", "elements"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["key", "side"])
        keys = own["key"].to_numpy()
        sides, labels = own["side"].to_numpy(), own["label"].to_numpy()
        marks = np.frombuffer(b"".join(own["signature"]), np.uint32).reshape(-1, COORDINATES)
        found = _spanning([np.frombuffer(e, np.uint64) for e in own["elements"]], marks, percent, sides if sides.any() else None, labels)
        return pd.DataFrame([(keys[i], keys[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    def compared(tiles: DataFrame) -> DataFrame:
        # texts are joined once per class, then copied to the class's tiles
        wanted = tiles.select("rid", "key").distinct()
        full = texts.join(wanted, "rid").select("key", "text").mapInPandas(sets, "key long, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))
        return tiles.join(full, "key").groupBy("block", "low", "high").applyInPandas(link, "a long, b long")

    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = ["rid", "key", "signature", "block"]
    plain = blocks.where("parts = 1 OR key != first").select(*mine, part("parts").alias("low"))
    heads = blocks.where("parts > 1 AND key = first").select(*mine, each("parts").alias("low"))
    same = plain.unionByName(heads).withColumns({"high": F.col("low"), "side": F.lit(0), "label": F.col("key")})
    links = compared(same)
    large = blocks.where("parts > 1")
    if large.isEmpty():
        return links
    links = checkpointed(links)
    known = components(links.join(large.select(F.col("key").alias("a")), "a", "left_semi"))
    large = checkpointed(large.join(known.select(F.col("node").alias("key"), F.col("component").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key")))
    # pairs of two components have a class outside the block's largest
    by_label = large.groupBy("block", "label").agg(F.count("*").alias("m"))
    most = by_label.groupBy("block").agg(F.max_by("label", F.struct("m", "label")).alias("most"))
    outside = large.join(most, "block").where("label != most")
    lefts = outside.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.col("n") * 8) / TILE_BYTES)).cast("int").alias("lefts"))
    left = outside.join(lefts, "block").select(*mine, "label", part("lefts").alias("low"), each("parts").alias("high"), F.lit(1).alias("side"))
    right = large.join(lefts, "block").select(*mine, "label", each("lefts").alias("low"), part("parts").alias("high"), F.lit(0).alias("side"))
    return links.unionByName(compared(left.unionByName(right)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets have at least ``percent`` % in common.

    Returns ``id_col, n_shingles, component_id, kept``, a row for each input row.
    """
    rows = checkpointed(described(docs, size, id_col, text_col))
    classes = checkpointed(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    blocks = components(candidate_edges(classes, percent))
    named = blocks.select(F.col("node").alias("key"), F.col("component").alias("block")).join(classes, "key")
    named = named.select("key", "block", "rid", "n", "signature")
    links = components(confirmed(docs, named, size, percent, id_col, text_col))
    # the smallest id of each component of classes
    joined = classes.select("key", "id").join(links.select(F.col("node").alias("key"), "component"), "key", "left")
    joined = joined.select("key", "id", F.coalesce("component", "key").alias("component"))
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.join(least, "component").select("key", "component_id")
    out = rows.select("id", "key", "n").join(named, "key", "left")
    whole = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 3-word shingles, similarity of at least 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
