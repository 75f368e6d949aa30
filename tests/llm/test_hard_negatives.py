"""Hard negatives against brute force: skewed norms, ties, twins, large components, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import hard_negatives as hard


def plain(rows, anchor, positives=5, negatives=10, window=(30, 90)):
    """Every product; rows are (id, label, vector of ints)."""
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows})
    out = []
    for a in (r for r in rows if anchor(r[0])):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r) for r in rows if r != a and len(r[2]) == len(a[2])]
        scored.sort(key=lambda s: (s[0], s[1]))
        for s, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            fits = [(n, r) for n, r in scored if r[1] != a[1] and window[0] * -s <= 100 * -n <= window[1] * -s]
            out += [(a[0], p[0], k + 1, r[0], -s, -n) for k, (n, r) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, every=10):
    rows = [(i, l, None if v is None else [None if x is None else float(x) for x in v]) for i, l, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({c: F.lit("clash") for c in ("id", "norm", "dim", "window", "rank", "score")})
    return sorted(map(tuple, hard.mine(df, F.col("id") % every == 0, F.col("label"), F.col("vector")).collect()))


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(3)), [int(x) for x in rng.integers(-9, 10, 6) * (1 + 40 * (k % 17 == 0))]) for k in range(300)]
    rows += [(k, 1, [3, 3, 3, 0, 0, 1]) for k in range(300, 400)]  # one very common vector
    rows += [(400, 0, [0] * 6), (401, 2, [0] * 6), (50, 0, [7, 7, 7, 7, 7, 7]), (50, 1, [7, 7, 7, 7, 7, 7]), (60, 1, [3, 3, 3, 0, 0, 1])]
    return rows


def test_equal_to_brute_force_whatever_the_blocks(spark, skewed, monkeypatch):
    want = plain(skewed, lambda i: i % 10 == 0)
    assert mined(spark, skewed) == want and len(want) > 500
    monkeypatch.setattr(hard, "BUCKET", 37)
    monkeypatch.setattr(hard, "WAVE", 11)
    monkeypatch.setattr(hard, "SLICE", 4)
    assert mined(spark, skewed) == want


def test_short_buckets_are_passed_by_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(4000, 8)) * np.exp(rng.normal(0, 2, 4000))[:, None] * 100).astype(np.int64)
    vectors = vectors[np.argsort(-(vectors.astype(float) ** 2).sum(axis=1))]
    labels, ids = rng.integers(0, 4, 4000), np.arange(4000)
    row = lambda at: {"dim": 8, "ids": ids[at].tobytes(), "labels": labels[at].tobytes(), "vectors": vectors[at].tobytes(), "top": float(np.sqrt((vectors[at].astype(float) ** 2).sum(axis=1)).max())}
    anchors = hard.Block.of(row(np.arange(0, 4000, 100)))
    n = len(anchors.ids)
    low = np.full(n, 30_000)
    windows = hard.Windows(anchors, np.arange(n), low, np.full(n, 90_000), 10, same=False)
    for at in range(0, 4000, 100):
        windows.take(hard.Block.of(row(np.arange(at, at + 100))))
    scores = anchors.vectors @ vectors.T
    for w in range(n):
        fits = [(-s, i) for i, s in enumerate(scores[w]) if labels[i] != anchors.labels[w] and 30_000 <= s <= 90_000]
        assert list(zip(-windows.scores[w], windows.ids[w])) == sorted(fits)[:10]
    assert windows.passed > windows.met > 0


def test_large_components_are_exact_or_refused(spark):
    rows = [(k, k % 2, [2**29 + k, 3 * k - 2**28, 7]) for k in range(40)]  # products beyond 2^53
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    for size in (2.0**40, 2.0**63, 1e300):
        with pytest.raises(Exception, match="64-bit"):
            mined(spark, [(k, k % 2, [size, 1.0]) for k in range(20)])


def test_awkward_vectors(spark):
    good = [(0, 1, [4, 4]), (1, 1, [4, 3]), (2, 2, [2, 2]), (3, 2, [1, 3]), (4, 3, [-1, 9]), (10, 1, [-5, 1]), (11, 1, [3, 1]), (12, 2, [1, 0]), (20, 5, [1, 1]), (30, 6, []), (31, 6, []), (32, 7, []), (40, 1, [1, 2, 3]), (41, 1, [1, 2, 2]), (42, 2, [1, 0, 2])]
    bad = [(5, None, [9.0, 9.0]), (6, 1, None), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [1.0, float("inf")]), (None, 2, [2.0, 2.0])]
    rows = [(i, l, [float(x) for x in v]) for i, l, v in good]
    assert mined(spark, rows + rows[:3] + bad) == plain(good, lambda i: i % 10 == 0)
    floored = [(0, 1, [1.9, 2.0]), (1, 1, [1.2, 2.5]), (2, 2, [1.0, 1.99]), (3, 2, [-0.5, 2.0])]
    assert mined(spark, floored) == plain([(0, 1, [1, 2]), (1, 1, [1, 2]), (2, 2, [1, 1]), (3, 2, [-1, 2])], lambda i: i == 0)
    assert mined(spark, rows[1:5]) == [] and mined(spark, bad) == []
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<double>")
    assert hard.mine(empty, F.col("id") > 0, F.col("label"), F.col("vector")).count() == 0
