"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Index. Equal vectors are one node. Vectors of unequal length get one more
coordinate that makes all norms equal, which turns inner products into angles.
The graph starts with the best neighbours inside small random blocks. In every
round each node brings its neighbours and those that have it as a neighbour
together (joins), compares them with each other, and offers each the best it
met; nodes keep the best ``DEGREE``. Of those that have a very popular node as a
neighbour a sample of ``MEMBERS``, drawn anew in each round, is taken before
anything is moved to it; that sampling is part of NN-descent and concerns the
index only: every vector is indexed. Rounds end when few lists change. The same
rounds run at every size.

Search. Queries are rows of the same table, so a search starts at its own node
and at the best of a random sample of nodes, which lead into and along large groups
of near copies, and expands, round by round, the nearest nodes not yet expanded; a join fetches
their neighbour lists. The ``BEAM`` nearest nodes are kept. The nearest ``EXACT``
are then scored in double precision on the original vectors.

How wide the search must be depends on the data and grows with the index. So it
measures itself: ``MEASURED`` queries, chosen by hash, are also answered by brute
force over all nodes (a fixed number of products per node), and the beam is
doubled and rounds go on until they reach ``RECALL``, or nothing is left to expand.

Both hold single-precision coordinates and compute in double precision. The
added coordinate is not stored: distances take it from the norms, so that one
long vector does not round the others away. Nodes whose score is within
the rounding error of the last one asked for are kept and rescored however many. Per task the rows are bounded: nodes and queries are dealt by hash
to partitions of fixed size.

Defined results: vectors that are null, zero, of another size than most, or
hold null or non-finite components take no part; equal scores go to the smaller
id; equal vectors are found through their node, of which the smallest ids
suffice; rows with a null id take no part; repeated ids count once. An empty
table gives no rows, and with fewer candidates than asked all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, dropped, stored, table

DEGREE = 32
MEMBERS = 64
#: Nodes of a random starting block, and starting blocks of each node.
START_BLOCK, STARTS = 256, 2
ROUNDS, SETTLED = 12, 0.04
#: Nodes whose best are a search's first.
SAMPLE = 1024
#: The nearest of those that have a node as a neighbour, in the lists of the search: hubs are few, and with fewer links back a search must expand far more.
BACK = 2 * DEGREE
#: Nodes, and queries, of a partition.
NODES_PER_PART, QUERIES_PER_PART = 4096, 256
BEAM, EXPANDED, SEARCH_ROUNDS = 384, 40, 4
EXACT = 64
#: Queries that are measured by brute force, and the recall they must reach.
MEASURED, RECALL = 64, 0.95


#: Bound of the error that rounding both vectors' coordinates puts into a product, as a share of both norms.
ROUNDED = 2.0**-22


def coordinates(rows: list[bytes]) -> np.ndarray:
    """Vectors of packed rows."""
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def closeness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distances between the vectors of each group, with the coordinate that makes all norms 1."""
    x = x.astype(np.float64)
    square = (x * x).sum(axis=-1)
    rest = np.sqrt(np.maximum(0, 1 - square))
    a, b = square[..., :, None], square[..., None, :]
    # the difference of the added coordinates, without cancellation
    fill = (a - b) / np.maximum(rest[..., :, None] + rest[..., None, :], 1e-9)
    return -(np.maximum(0, a + b - 2 * (x @ np.swapaxes(x, -1, -2))) + fill * fill)


def best(owner: np.ndarray, found: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's ``k`` nearest distinct finds, nearest first."""
    order = np.lexsort((-near, found, owner))
    owner, found, near = owner[order], found[order], near[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found, near = owner[new], found[new], near[new]
    order = np.lexsort((found, -near, owner))
    owner, found, near = owner[order], found[order], near[order]
    kept = rank_in(owner) < k
    return owner[kept], found[kept], near[kept]


def rank_in(owner: np.ndarray) -> np.ndarray:
    """Position of each row among the rows of its (ascending) owner."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))


def _lists(owner: np.ndarray, found: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """One row per (ascending) owner with its finds as bytes."""
    keys, first = np.unique(owner, return_index=True)
    return pd.DataFrame({
        "node": keys,
        "ids": [x.astype(np.int64).tobytes() for x in np.split(found, first[1:])] if len(keys) else [],
        "near": [x.astype(np.float32).tobytes() for x in np.split(near, first[1:])] if len(keys) else [],
    })


def _flat(nodes: np.ndarray, ids: list[bytes], near: list[bytes]):
    sizes = [len(x) // 8 for x in ids]
    return np.repeat(nodes, sizes), np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(near), np.float32)


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A partition of bounded size as one frame."""
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors that take part: ``id, node, vector`` (doubles); equal vectors share a node."""
    as_double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), as_double.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    # minus zero equals zero
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (size["d"] if size else 0)).dropDuplicates(["id"])
    return rows.withColumn("node", F.xxhash64("vector"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct vectors, with single-precision coordinates over the largest norm: ``node, packed``, and ``asked`` for the query form."""
    distinct = rows.select("node", "vector").dropDuplicates(["node"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    largest = float(distinct.agg(F.max(norm)).first()[0] or 1.0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].tolist())
                asked = x / np.abs(x).max(axis=1, keepdims=True)
                asked /= np.linalg.norm(asked, axis=1, keepdims=True)
                packed = lambda y: [v.tobytes() for v in y.astype(np.float32)]
                yield pd.DataFrame({"node": batch["node"], "packed": packed(x / largest), "asked": packed(asked)})

    return distinct.mapInPandas(pack, "node long, packed binary, asked binary")


GRAPH = "node long, packed binary, ids binary, near binary, changed int"
#: What nodes are offered, packed by the partition that the offered nodes are in.
OFFERS = "part int, owner binary, ids binary, near binary"


def _packed(owner: np.ndarray, found: np.ndarray, near: np.ndarray, parts: int) -> pd.DataFrame:
    """Offers as one row for each partition of their owners."""
    part = owner % parts
    order = np.argsort(part, kind="stable")
    keys, first = np.unique(part[order], return_index=True)
    cut = lambda x, kind: [v.astype(kind).tobytes() for v in np.split(x[order], first[1:])] if len(keys) else []
    return pd.DataFrame({"part": keys.astype(np.int32), "owner": cut(owner, np.int64), "ids": cut(found, np.int64), "near": cut(near, np.float32)})


def _start(nodes: DataFrame, n: int, parts: int) -> DataFrame:
    """Best neighbours inside random blocks, as offers."""
    blocks = max(1, n // START_BLOCK)
    dealt = nodes.select("node", "packed", F.explode(F.sequence(F.lit(1), F.lit(STARTS if blocks > 1 else 1))).alias("t"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "t"), F.lit(blocks)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["node"].to_numpy()
        near = closeness(coordinates(group["packed"].tolist()))
        np.fill_diagonal(near, -np.inf)
        k = min(DEGREE, len(ids) - 1)
        at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return _packed(np.repeat(ids, k), ids[at].reshape(-1), np.take_along_axis(near, at, 1).reshape(-1), parts)

    return dealt.groupBy("t", "block").applyInPandas(compare, OFFERS)


def _merged(graph: DataFrame, offers: DataFrame, parts: int) -> DataFrame:
    """Every node's best neighbours from its own list and the offers."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        own, offered = rows[rows["packed"].notna()], rows[rows["owner"].notna()]
        before = [x or b"" for x in own["ids"]]
        owner, found, near = _flat(own["node"].to_numpy(np.int64), before, [x or b"" for x in own["near"]])
        owner = np.concatenate((owner, np.frombuffer(b"".join(offered["owner"]), np.int64)))
        found = np.concatenate((found, np.frombuffer(b"".join(offered["ids"]), np.int64)))
        near = np.concatenate((near, np.frombuffer(b"".join(offered["near"]), np.float32)))
        lists = _lists(*best(owner, found, near, DEGREE)).set_index("node")
        out = own[["node", "packed"]].copy()
        out["node"] = out["node"].astype("int64")
        for c in ("ids", "near"):
            out[c] = [x if isinstance(x, bytes) else b"" for x in lists[c].reindex(out["node"])]
        out["changed"] = [len(np.setdiff1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))) for a, b in zip(out["ids"], before)]
        yield out

    part = F.pmod("node", F.lit(parts)).cast("int").alias("part")
    rows = graph.select(part, "node", "packed", "ids", "near").unionByName(offers.withColumn("node", F.lit(0).cast("long")), allowMissingColumns=True)
    return rows.repartition(parts, "part").mapInPandas(merge, GRAPH)


def _offers(graph: DataFrame, parts: int, number: int) -> DataFrame:
    """Neighbours of neighbours: what each node is offered by the nodes it meets."""

    # those that have the centre as a neighbour, at most MEMBERS of them, and the centre's own neighbours
    ahead = graph.select("node", "ids", "near").mapInPandas(_exploded, "node long, found long, near float").select(F.col("node").alias("centre"), F.col("found").alias("member"))
    drawn = F.row_number().over(W.partitionBy("centre").orderBy(F.xxhash64("centre", "member", F.lit(number))))
    back = ahead.select(F.col("member").alias("centre"), F.col("centre").alias("member")).withColumn("r", drawn).where(F.col("r") <= MEMBERS).drop("r")
    own = graph.select(F.col("node").alias("member"), "packed", "near").mapInPandas(_with_least, "member long, packed binary, least float")
    met = ahead.unionByName(back).join(own, "member").select("centre", "member", "packed", "least")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        rows = rows.drop_duplicates(["centre", "member"])
        rows = rows.iloc[np.lexsort(((rows["member"].to_numpy() * (2 * number + 1)) ^ rows["centre"].to_numpy(), rows["centre"].to_numpy()))]
        rows = rows[rank_in(rows["centre"].to_numpy()) < MEMBERS]
        centres, first = np.unique(rows["centre"].to_numpy(), return_index=True)
        sizes = np.diff(np.append(first, len(rows)))
        ids, least = rows["member"].to_numpy(), rows["least"].to_numpy()
        vectors = coordinates(rows["packed"].tolist())
        owner, found, near = [], [], []
        for a in range(0, len(centres), 256):
            width = int(sizes[a:a + 256].max())
            at = first[a:a + 256, None] + np.arange(width)
            there = np.arange(width) < sizes[a:a + 256, None]
            at = np.where(there, at, 0)
            close = closeness(vectors[at])
            good = (close > least[at][:, :, None]) & there[:, :, None] & there[:, None, :]
            good[:, np.arange(width), np.arange(width)] = False
            i, j, k = np.nonzero(good)
            o, f, c = best(ids[at[i, j]], ids[at[i, k]], close[i, j, k], DEGREE)
            owner.append(o)
            found.append(f)
            near.append(c)
        yield _packed(*best(np.concatenate(owner), np.concatenate(found), np.concatenate(near), DEGREE // 2), parts)

    return met.repartition(parts, "centre").mapInPandas(compare, OFFERS)


def _with_least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        least = [float(np.frombuffer(x, np.float32)[-1]) if len(x) == 4 * DEGREE else -np.inf for x in batch["near"]]
        yield pd.DataFrame({"member": batch["member"], "packed": batch["packed"], "least": np.array(least, np.float32)})


def build_graph(nodes: DataFrame, n: int) -> DataFrame:
    """The neighbour graph: ``node, packed, ids, near``."""
    parts = max(1, -(-n // NODES_PER_PART))
    empty = F.lit(None).cast("binary")
    graph = stored(_merged(nodes.select("node", "packed", empty.alias("ids"), empty.alias("near")), _start(nodes, n, parts), parts))
    for number in range(ROUNDS):
        before, graph = graph, stored(_merged(graph, _offers(graph, parts, number), parts))
        dropped(before)
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * DEGREE * n:
            break
    return graph


STATE = "query long, asked binary, ids binary, near binary, expanded binary, front array<long>"


def within_rounding(near: np.ndarray, k: int) -> int:
    """How many of the nearest (pairs of score and error, nearest first) can be among the ``k + 1`` nearest."""
    if len(near) <= k + 1:
        return len(near)
    least = np.sort(near[:, 0] - near[:, 1])[-(k + 1)]
    return int(np.flatnonzero(near[:, 0] + near[:, 1] >= least)[-1]) + 1


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores, with the bound of their error, of each query with the nodes of a fetched list."""
    for batch in batches:
        scores = []
        for asked, theirs in zip(batch["asked"], batch["theirs"]):
            x = coordinates(list(theirs)).astype(np.float64)
            scores.append(np.stack((x @ coordinates([asked])[0].astype(np.float64), ROUNDED * np.linalg.norm(x, axis=1)), axis=1).tobytes())
        yield pd.DataFrame({"query": batch["query"], "found": [np.asarray(v, np.int64).tobytes() for v in batch["found"]], "score": scores})


def brute_force(graph: DataFrame, queries: DataFrame, k: int) -> dict[int, list[int]]:
    """The ``k`` nearest nodes of ``MEASURED`` queries, chosen by hash, by products with all nodes."""
    some = queries.select("query", "asked").orderBy(F.xxhash64("query"), "query").limit(MEASURED).collect()
    shared = queries.sparkSession.sparkContext.broadcast(([r.query for r in some], [bytes(r.asked) for r in some]))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, best_ = shared.value, None
        for batch in batches:
            if len(batch) and asked[0]:
                score = coordinates(asked[1]).astype(np.float64) @ coordinates(batch["packed"].tolist()).astype(np.float64).T
                ids = np.broadcast_to(batch["node"].to_numpy(), score.shape)
                if best_ is not None:
                    score, ids = np.concatenate((best_[0], score), axis=1), np.concatenate((best_[1], ids), axis=1)
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best_ = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)
        if best_ is not None:
            yield pd.DataFrame({"query": np.repeat(np.array(asked[0], np.int64), best_[0].shape[1]), "node": best_[1].reshape(-1), "score": best_[0].reshape(-1)})

    found = graph.select("node", "packed").mapInPandas(products, "query long, node long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("r", rank).where(F.col("r") <= k).select("query", "node").collect():
        out.setdefault(r.query, []).append(r.node)
    return out


def measured_recall(state: DataFrame, truth: dict[int, list[int]], k: int) -> float:
    """The share of the measured queries' nearest nodes that a search holds among its ``k`` nearest, or as near."""
    hits = total = 0
    for r in state.where(F.col("query").isin(list(truth))).select("query", "ids", "near").collect():
        near = np.frombuffer(r.near, np.float64).reshape(-1, 2)
        held = np.frombuffer(r.ids, np.int64)[:within_rounding(near, k)]
        hits, total = hits + len(np.intersect1d(held, truth[r.query])), total + len(truth[r.query])
    return hits / total if total else 1.0


def greedy_search(graph: DataFrame, queries: DataFrame, k: int, n: int) -> DataFrame:
    """The nodes nearest to each query: ``query, ids, near`` (bytes, nearest first; scores with their error).

    ``queries`` has ``query`` (the node a search starts at) and ``asked``.
    """
    truth = brute_force(graph, queries, min(n, k + 1))
    parts = max(1, -(-queries.count() // QUERIES_PER_PART))
    # lists of neighbours and of the nearest that have the node as one, with vectors; else a node that is in no list is never found
    flat = graph.select("node", "ids", "near").mapInPandas(_exploded, "node long, found long, near float")
    back = flat.select(F.col("found").alias("node"), F.col("node").alias("found"), "near")
    nearest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("near"), "found"))
    back = back.withColumn("r", nearest).where(F.col("r") <= BACK)
    own = graph.select(F.col("node").alias("found"), F.col("packed").alias("theirs"))
    # most links go both ways; once each, before the vectors join them
    met = flat.select("node", "found").unionByName(back.select("node", "found")).distinct()
    # dealt by node once: vectors move once, and the rounds' joins then move the search fronts only
    met = met.join(own, "found").repartition(max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // NODES_PER_PART)), "node")
    lists = met.groupBy("node").agg(F.collect_list(F.struct("found", "theirs")).alias("list"))
    lists = lists.select("node", F.col("list.found").alias("found"), F.col("list.theirs").alias("theirs")).persist(StorageLevel.DISK_ONLY)

    def step(batches: Iterator[pd.DataFrame], beam: int, expanded: int) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        fetched = {q: g for q, g in rows[rows["found"].notna()].groupby("query")}
        out = []
        for state in rows[rows["asked"].notna()].itertuples():
            ids = np.frombuffer(state.ids or b"", np.int64)
            near = np.frombuffer(state.near or b"", np.float64).reshape(-1, 2)
            done = np.frombuffer(state.expanded or b"", bool)
            if (own := fetched.get(state.query)) is not None:
                found = np.frombuffer(b"".join(own["found"]), np.int64)
                scored = np.frombuffer(b"".join(own["score"]), np.float64).reshape(-1, 2)
                found, first = np.unique(found, return_index=True)
                new = ~np.isin(found, ids)
                found, first = found[new], first[new]
                if len(found):
                    ids, near, done = np.concatenate((ids, found)), np.concatenate((near, scored[first])), np.concatenate((done, np.zeros(len(found), bool)))
                    order = np.argsort(-near[:, 0], kind="stable")
                    order = order[:max(beam, within_rounding(near[order], k))]
                    ids, near, done = ids[order], near[order], done[order].copy()
            at = np.flatnonzero(~done)[:expanded]
            done = done.copy()
            done[at] = True
            out.append((state.query, state.asked, ids.tobytes(), near.tobytes(), done.tobytes(), ids[at].tolist()))
        yield pd.DataFrame(out, columns=["query", "asked", "ids", "near", "expanded", "front"])

    # the first lists fetched are those of the query's own node and of the best of the sample
    sample = graph.select("node", "packed").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    sampled = queries.sparkSession.sparkContext.broadcast((np.array([v.node for v in sample], np.int64), [bytes(v.packed) for v in sample]))

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = sampled.value[0], coordinates(sampled.value[1]).astype(np.float64)
        error = ROUNDED * np.linalg.norm(x, axis=1)
        for batch in batches:
            if len(batch):
                out = []
                for query, asked, score in zip(batch["query"], batch["asked"], coordinates(batch["asked"].tolist()).astype(np.float64) @ x.T):
                    order = np.argsort(-score, kind="stable")
                    order = order[:max(BEAM, within_rounding(np.stack((score, error), axis=1)[order], k))]
                    near, done = np.stack((score, error), axis=1)[order], np.arange(len(order)) < EXPANDED
                    out.append((query, asked, ids[order].tobytes(), near.tobytes(), done.tobytes(), [query, *(v for v in ids[order[:EXPANDED]].tolist() if v != query)]))
                yield pd.DataFrame(out, columns=["query", "asked", "ids", "near", "expanded", "front"])

    state = queries.select("query", "asked").mapInPandas(begun, STATE)
    beam, expanded, rounds = BEAM, EXPANDED, 0
    while True:
        # the query's vector goes to the lists: scores are moved, not the vectors of all that is met
        front = state.select("query", "asked", F.explode("front").alias("node")).join(lists, "node").select("query", "asked", "found", "theirs")
        front = front.mapInPandas(_scored, "query long, found binary, score binary")
        rows = state.drop("front").unionByName(front, allowMissingColumns=True)
        before, state = state, stored(rows.repartition(parts, "query").mapInPandas(partial(step, beam=beam, expanded=expanded), STATE))
        if rounds:
            dropped(before)
        rounds += 1
        if rounds >= SEARCH_ROUNDS and (measured_recall(state, truth, k) >= RECALL or state.where(F.size("front") > 0).isEmpty()):
            break
        if rounds >= SEARCH_ROUNDS and rounds % 2 == 0:
            beam, expanded = min(2 * beam, n), min(2 * expanded, n)
    lists.unpersist()
    return state.select("query", "ids", "near")


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        owner, found, near = _flat(batch["node"].to_numpy(), batch["ids"].tolist(), batch["near"].tolist())
        yield pd.DataFrame({"node": owner, "found": found, "near": near})


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's ``k`` nearest other rows: ``query_id, rank, id_col, score``.

    ``is_query`` is a Column over ``id`` that says which rows are queries.
    """
    rows = checkpointed(usable(vectors, id_col, vector_col))
    nodes = checkpointed(nodes_of(rows))
    n = nodes.count()
    graph = build_graph(nodes, n)
    asking = rows.where(is_query).select("id", "node")
    queries = asking.select(F.col("node").alias("query")).distinct().join(nodes.select(F.col("node").alias("query"), "asked"), "query")
    found = greedy_search(graph, queries, k, n)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [max(EXACT, 2 * k, within_rounding(np.frombuffer(x, np.float64).reshape(-1, 2), k)) for x in batch["near"]]
            ids = [np.append(np.frombuffer(x, np.int64)[:n], q) for q, x, n in zip(batch["query"], batch["ids"], kept)]
            yield pd.DataFrame({"query": np.repeat(batch["query"].to_numpy(), [len(x) for x in ids]), "node": np.concatenate(ids) if ids else []}, dtype="int64")

    pairs = found.mapInPandas(nearest, "query long, node long").distinct()
    vector = rows.select("node", "vector").dropDuplicates(["node"])
    score = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(vector, "node").join(vector.select(F.col("node").alias("query"), F.col("vector").alias("other")), "query")
    scored = scored.select("query", "node", score.alias("score"))
    # of equal vectors the k + 1 smallest ids can be among the k nearest
    few = rows.select("node", "id").withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1)
    offered = scored.join(few.select("node", "id"), "node").withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    offered = offered.where(F.col("r") <= k + 1).select(F.col("query").alias("node"), "id", "score")
    out = asking.withColumnRenamed("id", "query_id").join(offered, "node").where("query_id != id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
