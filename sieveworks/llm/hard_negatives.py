"""Hard-negative mining by norm-bucketed search.

Rows hold integer vectors. For every anchor the nearest rows of its label are
its positives; for every positive the nearest rows of other labels whose score
lies in a window below the positive's score are its hard negatives. A score is
the inner product with the anchor, an exact integer.

Index. Rows are sorted by norm, longest first, and cut into buckets of at most
``BUCKET`` rows; rows of one norm are cut too, by their ids. Buckets are written
packed, once.

Search. Anchors come in waves of at most ``WAVE`` (16,384 vectors: the bound of
what is broadcast and of what the driver holds, whatever the table's size).
Each task streams buckets, longest norms first. By Cauchy-Schwarz no row of a
bucket scores above the anchor's norm times the bucket's largest; a window whose
lower limit or running k-th score is above that passes the bucket by. The rest is
multiplied in blocks. Tasks emit their best k of each window, and a window
function takes the best k of those. A wave's results are written to the shared
folder; a lost executor costs the tasks that it ran. Nothing is left out: the
bounds are exact, so the result is that of brute force at every size.

Products of norms below 2^53 are computed in doubles, where they are exact, others
below 2^63 in 64-bit integers; above, the search raises.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part; a row is compared with vectors of its own size only;
rows that repeat in id, label and vector count once, rows with an id in common
that differ are different rows; ties of a score go to the smaller id. A negative
positive score has an empty window. Tables without rows or anchors give no rows;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

BUCKET, WAVE = 4096, 16384
#: Anchors that are multiplied with a bucket at once.
SLICE = 512
MOST = np.iinfo(np.int64).max
LEAST = -MOST
#: What rounding may take from a norm.
SLACK = 1 + 1e-9

PACKED = "dim int, top double, n int, ids binary, labels binary, vectors binary"
FOUND = "window int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Block:
    """Unpacked rows, ascending by id."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    top: float

    @classmethod
    def of(cls, row) -> "Block":
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"])
        order = np.argsort(ids, kind="stable")
        vectors = vectors[order]
        return cls(ids[order], labels[order], vectors, np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * SLACK, row["top"] * SLACK)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer vectors; ``bound`` is the largest product of their norms."""
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**63:
        return a @ b.T
    raise ValueError("scores of these vectors do not fit 64-bit integers")


class Windows:
    """The best ``k`` scores in ``[low, high]`` of each window; a window belongs to an anchor.

    ``passed`` and ``met`` count the windows that went by a bucket and that were compared with it.
    """

    def __init__(self, anchors: Block, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.low, self.high, self.k, self.same = anchors, low, high, k, same
        self.first = np.searchsorted(owner, np.arange(len(anchors.ids) + 1))  # owner ascends
        self.owner, self.limit = owner, low.copy()
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(owner)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(owner)
        self.passed = self.met = 0

    def take(self, bucket: Block) -> None:
        """Compares the windows that the bucket's norm can reach with its rows."""
        a = self.anchors
        open_ = a.norms[self.owner] * bucket.top >= self.limit
        self.met, self.passed = self.met + int(open_.sum()), self.passed + int((~open_).sum())
        own = np.unique(self.owner[open_])
        # the lowest limit of each anchor's open windows
        least = np.full(len(a.ids), MOST)
        np.minimum.at(least, self.owner[open_], self.limit[open_])
        for at in range(0, len(own), SLICE):
            part = own[at:at + SLICE]
            scores = products(a.vectors[part], bucket.vectors, float(a.norms[part].max(initial=0)) * bucket.top)
            fits = scores >= least[part, None]
            fits &= (a.labels[part, None] == bucket.labels[None, :]) == self.same
            for j in np.flatnonzero(fits.any(axis=1)):
                self._keep(part[j], scores[j], np.flatnonzero(fits[j]), bucket)

    def _keep(self, j: int, scores: np.ndarray, rows: np.ndarray, bucket: Block) -> None:
        if self.same:
            twin = rows[bucket.ids[rows] == self.anchors.ids[j]]
            if len(twin):  # the anchor itself is no other row
                own = twin[(bucket.vectors[twin] == self.anchors.vectors[j]).all(axis=1)]
                rows = np.setdiff1d(rows, own, assume_unique=True)
        rows = rows[np.argsort(-scores[rows], kind="stable")]  # ties stay in the order of ids
        ordered = -scores[rows]
        for w in range(self.first[j], self.first[j + 1]):
            start = np.searchsorted(ordered, -self.high[w])
            end = min(np.searchsorted(ordered, -self.limit[w], "right"), start + self.k)
            if start < end:
                s, i = np.append(self.scores[w], -ordered[start:end]), np.append(self.ids[w], bucket.ids[rows[start:end]])
                best = np.lexsort((i, -s))[:self.k]
                self.scores[w], self.ids[w] = s[best], i[best]
                if len(best) == self.k:
                    self.limit[w] = max(self.low[w], s[best][-1])

    def frame(self) -> pd.DataFrame:
        sizes = [len(x) for x in self.ids]
        flat = lambda xs: np.concatenate(xs) if len(xs) else np.zeros(0, np.int64)
        return pd.DataFrame({"window": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "id": flat(self.ids), "score": flat(self.scores)})


def usable(vectors: DataFrame, id_col: str, label: Column, vector: Column) -> DataFrame:
    """Rows that take part: ``id, label, dim, norm, vector`` with 64-bit components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector")).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(F.raise_error(F.lit("scores of these vectors do not fit 64-bit integers"))).cast("long"))
    rows = rows.withColumn("vector", whole)
    return rows.withColumns({"dim": F.size("vector"), "norm": F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))})


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows sorted by norm, longest first, in packed blocks of at most ``size`` rows of one vector size."""
    parts = max(1, -(-rows.count() // size))
    order = ["dim", F.desc("norm"), "id", "label", "vector"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dim", "norm", "id", "label", "vector")

    def block(held: list[tuple], dim: int) -> pa.RecordBatch:
        top, ids, labels, vectors = zip(*held)
        row = {"dim": dim, "top": top[0], "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "vectors": np.array(vectors, np.int64).tobytes()}
        kinds = {"dim": pa.int32(), "top": pa.float64(), "n": pa.int32(), "ids": pa.binary(), "labels": pa.binary(), "vectors": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], names=list(kinds))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, before = [], None, None
        for batch in batches:
            dims, norms, ids, labels = (c.to_pylist() for c in batch.columns[:4])
            lists = batch.column(4)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for k, row in enumerate(zip(dims, ids, labels)):
                vector = flat[at[k]:at[k + 1]]
                if before is not None and before[0] == row and np.array_equal(before[1], vector):
                    continue  # a repeated row
                before = row, vector
                if held and (len(held) >= size or of != dims[k]):
                    yield block(held, of)
                    held = []
                of = dims[k]
                held.append((norms[k], ids[k], labels[k], vector))
        if held:
            yield block(held, of)

    return dealt.mapInArrow(pack, PACKED)


def _merged(rows: Iterable) -> Iterator[Block]:
    """Blocks of at most ``WAVE`` rows from such blocks, small neighbours of one vector size as one."""
    held: list = []
    for row in rows:
        if held and (row["dim"] != held[0]["dim"] or row["n"] + sum(r["n"] for r in held) > WAVE):
            yield _joined(held)
            held = []
        held.append(row)
    if held:
        yield _joined(held)


def _joined(rows: list) -> Block:
    return Block.of({"dim": rows[0]["dim"], "top": max(r["top"] for r in rows), **{c: b"".join(r[c] for r in rows) for c in ("ids", "labels", "vectors")}})


def best_in(buckets: DataFrame, anchors: Block, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows of each window over all buckets: ``window, id, score, rank``."""
    spark = buckets.sparkSession
    sent = spark.sparkContext.broadcast((anchors, owner, low, high))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*sent.value, k, same)
        for batch in batches:
            for row in range(batch.num_rows):
                windows.take(Block.of({name: batch.column(name)[row].as_py() for name in batch.schema.names}))
        yield pa.RecordBatch.from_pandas(windows.frame(), preserve_index=False)

    found = buckets.where(F.col("dim") == anchors.vectors.shape[1]).mapInArrow(scan, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("window").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, vector: Column, id_col: str = "vec_id",
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Hard negatives of each anchor's positives.

    ``is_anchor`` is a condition on the column ``id``; ``label`` and ``vector``
    are expressions of the table, the vector's components are floored.
    ``window`` is in hundredths of the positive's score. Returns ``anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, label, vector)
    buckets = stored(packed(rows, BUCKET))
    waves = stored(packed(rows.where(is_anchor), WAVE))
    path = f"{shared_folder(spark).rstrip('/')}/mined-{uuid.uuid4().hex}"
    done = 0
    for anchors in _merged(waves.toLocalIterator()):
        every = np.arange(len(anchors.ids))
        # at most WAVE times ``positives`` rows
        near = best_in(buckets, anchors, every, np.full(len(every), LEAST), np.full(len(every), MOST), positives, same=True).toPandas()
        near = near.sort_values(["window", "rank"], ignore_index=True)
        scores = near["score"].to_numpy(np.int64).astype(object)
        near["low"], near["high"] = -((-window[0] * scores) // 100), (window[1] * scores) // 100
        near = near[near["low"] <= near["high"]].reset_index(drop=True)
        if near.empty:
            continue
        owner = near["window"].to_numpy(np.int64)
        hard = best_in(buckets, anchors, owner, near["low"].to_numpy(np.int64), near["high"].to_numpy(np.int64), negatives, same=False)
        pairs = spark.createDataFrame(
            pd.DataFrame({"window": np.arange(len(near), dtype=np.int32), "anchor_id": anchors.ids[owner], "positive_id": near["id"], "positive_score": near["score"]}),
            "window int, anchor_id long, positive_id long, positive_score long",
        )
        out = hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), "window")
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.parquet(f"{path}/wave={done}")
        done += 1
    if not done:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, wave int").parquet(path).drop("wave")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``; labels of ids divisible by 7 go on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, vector)


_SQL = """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT *, row_number() OVER (ORDER BY id, label, v) AS k FROM r),
s AS (SELECT a.k AS anchor, a.id AS anchor_id, b.k, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM k a JOIN k b ON len(a.v) = len(b.v) AND a.k <> b.k WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, k) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.id, n.k))::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.id, n.k) <= 10"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": _SQL}
