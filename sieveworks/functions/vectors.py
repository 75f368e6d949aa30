"""Vectors as array columns, similarity, affinity layouts and route vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null with a zero vector."""
    return clip(F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(a: Column, width: int | None = None) -> Column:
    """A vector of length one; raises on zero, non-finite or wrongly sized ones."""
    bad = (norm(a) <= 0) | F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if width is not None:
        bad = bad | (F.size(a) != width)
    n = norm(a)
    return F.when(bad, F.raise_error(F.lit("signatures must be finite, non-zero and of one width")).cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def set_similarity(a: Column, b: Column) -> Column:
    """Common share of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def folded_slot(feature: Column, width: int = 2048) -> Column:
    """The slot of a folded count fingerprint: 32 bits of the feature's MD5 by ``width``."""
    return F.pmod(F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width))


def bitmap(slots: Column, width: int = 2048) -> Column:
    """Slots as a packed bitmap, ``width / 64`` longs; null slots give null, those outside the width are an error.

    One pass over the sorted slots: a word is put down once its last bit is set.
    """
    words = -(-width // 64)
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("bits"))

    def merge(state: Column, slot: Column) -> Column:
        inside = F.when((slot >= 0) & (slot < width), slot).otherwise(F.raise_error(F.lit("a slot is outside the bitmap")).cast("long"))
        word = F.floor(inside / 64)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (inside % 64).cast("int"))
        more = F.struct(state["done"].alias("done"), state["at"].alias("at"), state["bits"].bitwiseOR(bit).alias("bits"))
        new = F.struct(F.concat(state["done"], F.array(state["bits"]), zeros(word - state["at"] - 1)).alias("done"), word.alias("at"), bit.alias("bits"))
        return F.when(word == state["at"], more).otherwise(new)

    finish = lambda state: F.concat(state["done"], F.array(state["bits"]), zeros(F.lit(words) - state["at"] - 1))
    return F.aggregate(F.array_sort(F.array_distinct(slots.cast("array<bigint>"))), start, merge, finish)


def bitmap_similarity(a: Column, b: Column) -> Column:
    """Common share of two bitmaps' bits by counting them; 0 if a bitmap is missing or both are empty."""
    bits = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))
    both, either = bits(lambda x, y: x.bitwiseAND(y)), bits(lambda x, y: x.bitwiseOR(y))
    return F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0))


def folded_counts(rows: DataFrame, by: list[str], feature: str, width: int = 2048) -> DataFrame:
    """Folded count fingerprints in long form: ``by, slot, n``, the counts of all features that fall in a slot."""
    return rows.groupBy(*by, folded_slot(F.col(feature), width).alias("slot")).agg(F.count("*").alias("n"))


def cosine_graph(signatures: DataFrame, node: str = "node", vector: str = "signature", max_nodes: int = 4096) -> DataFrame:
    """Cosines of all pairs of nodes: ``src, dst, cosine`` with ``src < dst``.

    Nodes are the few parts of a program, not rows of a corpus: their number
    squared is the size of the wanted matrix. More than ``max_nodes`` raise.
    """
    if signatures.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"a matrix of more than {max_nodes} nodes")
    a = signatures.select(F.col(node).alias("src"), F.col(vector).alias("a"))
    b = signatures.select(F.col(node).alias("dst"), F.col(vector).alias("b"))
    return a.join(b, F.col("src") < F.col("dst")).select("src", "dst", cosine(F.col("a"), F.col("b")).alias("cosine"))


def spectral_layout(signatures: DataFrame, rank: int = 16, common: int = 8, floor: float = 0.25, node: str = "node", vector: str = "signature", max_nodes: int = 4096) -> tuple[dict, DataFrame]:
    """Ranks from signed eigenvectors of the affinity of few nodes (at most ``max_nodes``).

    Every factor gives one rank to positive and one to negative loadings. The
    sign of a factor is fixed: its largest loading is positive. Returns the
    layout and its weights as rows ``node, rank_index, weight``.
    """
    import numpy as np

    residual = rank - common
    if rank < 3 or not 1 <= common < rank or residual % 2 or not 0 < floor < 1:
        raise ValueError("rank, common ranks or floor out of range")
    rows = signatures.select(node, vector).limit(max_nodes + 1).collect()
    if not 1 <= len(rows) <= max_nodes:
        raise ValueError(f"between 1 and {max_nodes} signatures are needed")
    rows = sorted(rows, key=lambda r: str(r[0]))
    matrix = np.array([r[1] for r in rows], float)
    size = np.linalg.norm(matrix, axis=1)
    if not np.isfinite(matrix).all() or (size <= 0).any():
        raise ValueError("signatures must be finite and non-zero")
    matrix /= size[:, None]
    values, vectors = np.linalg.eigh(np.clip(matrix @ matrix.T, -1, 1))
    top = np.argsort(values)[::-1][: min(residual // 2, len(rows))]
    strengths = np.sqrt(np.maximum(values[top], 0) / values[top[0]])
    out = []
    for f, (k, strength) in enumerate(zip(top, strengths)):
        loading = vectors[:, k] / np.abs(vectors[:, k]).max()
        loading = loading * np.sign(loading[np.argmax(np.abs(loading))])
        for row, x in zip(rows, loading):
            for shift, value in ((0, x), (1, -x)):
                out.append((str(row[0]), int(common + 2 * f + shift), float(max(0.0, value) * strength)))
    layout = {"rank": rank, "common_ranks": list(range(common)), "inactive_floor": floor, "normalization": "rms_active", "eigenvalues": [float(values[k]) for k in top]}
    return layout, signatures.sparkSession.createDataFrame(out, "node string, rank_index int, weight double")


def rank_list_ok(ranks: Column, rank: int | Column) -> Column:
    """Whether a list of ranks is not empty, repeats none and stays in range."""
    inside = F.forall(ranks, lambda r: r.isNotNull() & (r >= 0) & (r < rank))
    return F.coalesce((F.size(ranks) > 0) & (F.size(F.array_distinct(ranks)) == F.size(ranks)) & inside, F.lit(False))


def node_signatures(rows: DataFrame, node: str, vector: str) -> DataFrame:
    """Each node's probe: the mean of its rows' vectors, ``node, signature``; pre-aggregated before the shuffle.

    Null nodes, vectors and components are left out; a node's vectors must be of one size.
    """
    parts = rows.where(F.col(node).isNotNull()).select(F.col(node).cast("string").alias("node"), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy("node", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one number a position
    return means.groupBy("node").agg(F.transform(sorted_, lambda s: s["x"]).alias("signature"))


def load_layout(spark, path: str) -> dict:
    """A layout from a JSON document in any file system Spark reaches, checked; the document is one small file."""
    import json

    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"no single layout at {path}")
    layout = json.loads(found[0][0])
    if not isinstance(layout, dict):
        raise ValueError("a layout is an object")
    check_layout(layout)
    return layout


def check_layout(layout: dict) -> None:
    """Raises if ranks repeat or lie outside, or weights, floor or scaling are out of range."""
    rank = int(layout.get("rank", 0))
    lists = [layout.get("common_ranks", []), *layout.get("property_ranks", {}).values(), *layout.get("mode_ranks", {}).values()]
    weights = [(int(k), float(w)) for routed in layout.get("node_rank_weights", {}).values() for k, w in routed.items()]
    problems = (
        (rank < 1 or not layout.get("common_ranks"), "a positive rank and common ranks are needed"),
        (any(len(set(x)) < len(x) or min(x, default=0) < 0 or max(x, default=0) >= rank for x in lists), "ranks repeat or are out of range"),
        (not layout.get("property_ranks") and not layout.get("node_rank_weights"), "nothing is routed"),
        (any(not x for x in layout.get("property_ranks", {}).values()), "a property has no ranks"),
        (any(not 0 <= k < rank or not math.isfinite(w) or not 0 <= w <= 1 for k, w in weights), "a weight is out of range"),
        (any(":" not in k for k in layout.get("node_rank_weights", {})), "a node needs a mode and a property"),
        (not 0 <= float(layout.get("inactive_floor", 0)) <= 1, "the floor is out of range"),
        (layout.get("normalization", "binary") not in ("binary", "rms_active"), "unknown scaling"),
    )
    for bad, why in problems:
        if bad:
            raise ValueError(why)


def layout_rows(spark, layout: dict) -> DataFrame:
    """A checked layout as a small table ``node, rank_index, weight``; the node "" holds for all."""
    check_layout(layout)
    rows = [("", int(k), 1.0) for k in layout["common_ranks"]]
    if layout.get("node_rank_weights"):
        rows += [(n, int(k), float(w)) for n, routed in layout["node_rank_weights"].items() for k, w in routed.items()]
    else:
        rows += [(p, int(k), 1.0) for p, ranks in layout["property_ranks"].items() for k in ranks]
        rows += [(f"mode={m}", int(k), 1.0) for m, ranks in layout.get("mode_ranks", {}).items() for k in ranks]
    return spark.createDataFrame(rows, "node string, rank_index int, weight double")


def route_vectors(requests: DataFrame, layout: dict, key: str = "key") -> DataFrame:
    """One vector of ``rank`` weights for each request: ``key, route array<double>``.

    ``requests`` has ``key, mode, properties array<string>``. A weight is the
    largest of its nodes', common ranks have 1, others the floor. Raises where a
    property has no node. With ``rms_active`` the squares add up to the rank.
    """
    rank, weighted = int(layout["rank"]), bool(layout.get("node_rank_weights"))
    rows = F.broadcast(layout_rows(requests.sparkSession, layout))
    name = F.concat(F.col("mode"), F.lit(":"), F.col("p")) if weighted else F.col("p")
    named = requests.select(key, "mode", F.explode("properties").alias("p")).select(key, name.alias("node"))
    extra = requests.select(key, F.explode(F.array(F.lit(""), F.concat(F.lit("mode="), F.col("mode")))).alias("node"))
    missed = named.join(rows.select("node").distinct().withColumn("known", F.lit(True)), "node", "left")
    checked = missed.select(key, F.when(F.col("known"), F.col("node")).otherwise(F.raise_error(F.concat(F.lit("no route for "), F.col("node"))).cast("string")).alias("node"))
    active = checked.unionByName(extra).join(rows, "node").groupBy(key, "rank_index").agg(F.max("weight").alias("weight"))
    floor = float(layout.get("inactive_floor", 0.0)) if weighted else 0.0
    found = active.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank_index", "weight"))).alias("w"))
    values = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: F.greatest(F.coalesce(F.try_element_at(F.col("w"), k), F.lit(0.0)), F.lit(floor)))
    out = found.select(key, values.alias("route"))
    if layout.get("normalization") == "rms_active":
        scale = F.sqrt(F.lit(float(rank)) / dot(F.col("route"), F.col("route")))
        out = out.select(key, F.transform("route", lambda x: x * scale).alias("route"))
    return out


def route_matrix(routes: DataFrame, key: str = "key") -> DataFrame:
    """Routes in key order as rows of a matrix: ``row_index, route``."""
    from ..operators.selection import global_place

    return global_place(routes, [key], "row_index").select("row_index", "route")


def bisector(a: Column, b: Column) -> Column:
    """The equal-norm bisector of two vectors, with its cosine and descent flags."""
    na, nb = norm(a), norm(b)
    sa, sb = F.greatest(na, F.lit(1e-12)), F.greatest(nb, F.lit(1e-12))
    half = 0.25 * (na + nb)
    merged = F.zip_with(a, b, lambda x, y: half * (x / sa + y / sb))
    cos = dot(a, b) / (sa * sb)
    da, db = dot(merged, a), dot(merged, b)
    return F.struct(merged.alias("merged"), cos.alias("cosine"), (cos < 0).alias("conflict"), na.alias("first_norm"), nb.alias("second_norm"), norm(merged).alias("merged_norm"), ((da >= -1e-8) & (db >= -1e-8)).alias("common_descent"))
