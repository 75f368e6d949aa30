"""Score caches, pinned models, bitmaps, digest trees, folding and the bootstrap, against plain versions."""

import hashlib
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import folding, models, vectors
from sieveworks.operators import merkle, resample
from sieveworks.operators import score_cache as caches


def test_a_second_run_scores_only_unseen_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caches, "BUCKETS", 4)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scorer(text):
        seen.add(1)
        return None if text == "none" else float(len(text))

    cache = caches.ScoreCache(spark, f"{tmp_path}/cache")
    frame = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    rows, counts = cache.score(frame("a", "bb", "a", None, "none"), "t", scorer)
    assert sorted(map(str, ((r.t, r.score) for r in rows.collect()))) == sorted(map(str, [("a", 1.0), ("bb", 2.0), ("a", 1.0), (None, None), ("none", None)]))
    assert counts == {"wanted": 3, "scored": 3} and seen.value == 3
    rows, counts = cache.score(frame("bb", "none", "ccc"), "t", scorer)
    assert {(r.t, r.score) for r in rows.collect()} == {("bb", 2.0), ("none", None), ("ccc", 3.0)} and counts == {"wanted": 3, "scored": 1} and seen.value == 4
    assert cache.score(frame("a", "bb", "ccc"), "t", scorer)[1]["scored"] == 0 and seen.value == 4
    assert cache.score(frame(), "t", scorer)[1] == {"wanted": 0, "scored": 0}
    assert {(r.text, r.last_use) for r in cache.entries().collect()} == {("a", 3), ("bb", 3), ("ccc", 3), ("none", 2)}


def test_the_entries_of_latest_use_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caches, "BUCKETS", 1)
    cache = caches.ScoreCache(spark, f"{tmp_path}/cache", capacity=3)
    frame = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string")
    for texts in (("a", "b", "c"), ("b",), ("d",), ("e", "b")):
        cache.score(frame(*texts), "t", F.length)
    kept = {r.text for r in cache.entries().collect()}
    assert len(kept) == 3 and {"e", "b", "d"} == kept
    # a run that dies before its version file is not in the cache
    spark.range(1).write.parquet(f"{tmp_path}/cache/data/_attempt=99999999-dead")
    assert cache.score(frame("a", "b"), "t", F.length)[1] == {"wanted": 2, "scored": 1}


def test_pinned_models_are_checked_before_any_row(spark, tmp_path):
    rng = np.random.default_rng(0)
    model = models.Linear(rng.normal(size=32), 0.25, 2)
    pinned = models.publish(spark, model, f"file://{tmp_path}/models", "DRD2")
    rows = spark.createDataFrame([("abc",), ("",), (None,), ("Ünï",)], "t string")
    got = {r.t: r.s for r in rows.select("t", pinned.scorer(spark)(F.col("t")).alias("s")).collect()}
    slots = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 32 for g in ("ab", "bc")]
    assert got["abc"] == pytest.approx(1 / (1 + np.exp(-(model.weights[slots].sum() + 0.25)))) and got[None] is None and got[""] == pytest.approx(1 / (1 + np.exp(-0.25)))
    assert [tuple(r) for r in pinned.provenance(spark).select("property", "sha256").collect()] == [("DRD2", pinned.digest)]
    for wrong in ("0" * 64, "", pinned.digest.upper()):
        with pytest.raises(models.WrongDigest):
            models.Pinned("DRD2", pinned.path, wrong).scorer(spark)
    with pytest.raises(ValueError):  # pickled content is refused
        np.savez(tmp_path / "bad.npz", weights=np.array([{}], object), bias=0.0, width=1)
        models.Linear.load((tmp_path / "bad.npz").read_bytes())
    with pytest.raises(ValueError, match="finite"):
        models.Linear.load(models.Linear(np.array([np.nan]), 0.0, 1).save())


def test_bitmaps_count_as_sets_do(spark):
    sets = [([0, 63, 64, 2047], [0, 64, 100]), ([], []), ([5], []), (None, [1]), ([1, 1, 2], [2, 1]), (list(range(0, 2048, 3)), list(range(0, 2048, 2)))]
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(sets)], "k int, a array<int>, b array<int>")
    a, b = vectors.bitmap(F.col("a")), vectors.bitmap(F.col("b"))
    for r in df.select("k", a.alias("x"), b.alias("y"), vectors.bitmap_similarity(a, b).alias("s")).collect():
        x, y = sets[r.k]
        want = 0.0 if not x and not y or x is None else len(set(x) & set(y)) / len(set(x) | set(y))
        assert r.s == pytest.approx(want)
        if x is not None:
            assert len(r.x) == 32 and {64 * w + i for w, bits in enumerate(r.x) for i in range(64) if bits >> i & 1} == set(x)
    for bad in ([2048], [-1]):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad,)], "a array<int>").select(vectors.bitmap(F.col("a"))).collect()


def test_digest_trees(spark):
    rows = [(f"dir/{k}", hashlib.md5(str(k).encode()).hexdigest()) for k in range(700)] + [("", "x"), ("twice", "y"), ("twice", "y")]
    frame = lambda rs: merkle.leaves_of(spark.createDataFrame(rs, "n string, d string"), "n", "d")
    nodes = lambda t: {(r.level, r.node): (r.leaves, r.digest) for r in t.collect()}
    depth = merkle.depth_of(len(rows))
    assert depth == 2 and [merkle.depth_of(n) for n in (0, 1, 16, 17, 256, 257, 10**9)] == [1, 1, 1, 1, 1, 2, 7]
    before = merkle.tree(frame(rows), depth).cache()
    assert nodes(before) == nodes(merkle.tree(frame(rows[::-1]).repartition(7), depth)) and nodes(before)[0, ""][0] == len(rows)
    changes = {"changed": rows[:5] + [("dir/5", "other")] + rows[6:], "gone": rows[1:], "new": rows + [("brand new", "z")]}
    names = {"changed": "dir/5", "gone": "dir/0", "new": "brand new"}
    for what, now in changes.items():
        name = names[what]
        again = merkle.updated(before, frame(now), spark.createDataFrame([(name,)], "name string"), depth).cache()
        assert nodes(again) == nodes(merkle.tree(frame(now), depth)), what
        place = hashlib.sha256(name.encode()).hexdigest()
        assert {tuple(r) for r in merkle.differing(before, again, depth).collect()} == {(level, place[:level]) for level in range(depth + 1)}
    # lengths before the parts: moving a border changes the digest
    two = [nodes(merkle.tree(frame([(a, b)]), 1))[0, ""][1] for a, b in (("ab", "c"), ("a", "bc"), ("a", "=bc"))]
    assert len(set(two)) == 3 and merkle.tree(frame(rows).where("name = 'no such'"), 1).count() == 0
    before.unpersist()


def test_folding_is_that_of_unicode(spark):
    texts = [None, "", "plain", "ＭＷ", "é", "éa", "ﬁne", "①²", "Å", "ｶﾞ", "한글", "각", "각", "각", "ạ̇", "ạ̇", "̈́", "ﷺ", "𝐀x", "ſ", "　x", "½", "ΐ", "क़", "ো", "😀é", " ", "ǆ", "ẛ̣"]
    texts += ["".join(chr(p) for p in range(a, a + 256) if not 0xD800 <= p <= 0xDFFF) for a in (*range(0, 0x3400, 256), 0xF900, 0xFB00, 0xFD00, 0xFE00, 0xFF00, 0x1D400, 0x1F100, 0x2F800)]
    texts += [chr(p) for a in (0xA0, 0x2000, 0x2100, 0x3300, 0xFB00, 0xFF00, 0x1D400) for p in range(a, a + 120)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k int, t string, _x int")
    got = {r.k: r.t for r in folding.nfkc(df, "t").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else unicodedata.normalize("NFKC", t)), (k, ascii(t)[:80])
    assert folding.nfkc(df, "t", "folded").columns == ["k", "t", "_x", "folded"] and folding.nfkc(df.where("k < 0"), "t").count() == 0


def test_blocks_share_the_draws_of_the_whole(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 10)
    n, replicates = 47, 4000
    drawn = np.array([resample.draws_of_block(n, b, replicates, 7, 99) for b in range(5)])
    assert (drawn.sum(axis=0) == n).all() and (drawn >= 0).all()
    sizes = np.array([10, 10, 10, 10, 7])
    assert np.abs(drawn.mean(axis=1) - sizes).max() < 0.25  # means of a multinomial draw
    assert np.abs(drawn.var(axis=1) - sizes * (1 - sizes / n)).max() < 0.9
    values = np.arange(47.0)
    sums = sum(resample.block_sums(values[None, 10 * b:10 * b + 10], drawn[b], 7, 1000 + b)[0][0] for b in range(5))
    assert sums[-1] == values.sum()
    means = sums[:-1] / n
    assert abs(means.mean() - values.mean()) < 0.15 and abs(means.std() - values.std() / np.sqrt(n)) < 0.1


def test_the_bootstrap_of_few_pairs(spark):
    rows = [("a", 1, 1.0, None), ("a", 2, 3.0, 2.0), ("b", 3, 5.0, None), (None, 4, 7.0, 1.0), (None, 5, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "b string, k int, x double, y double")
    got = {r.metric: r for r in resample.bootstrap(df, "b", ["k"], ["x", "y"], 500).collect()}
    assert got["x"].delta == pytest.approx((2 + 5 + 7) / 3) and got["y"].delta == pytest.approx((2 + 1) / 2)
    assert got["x"].ci_low == pytest.approx((1 + 5 + 7) / 3) and got["x"].ci_high == pytest.approx((3 + 5 + 7) / 3)
    assert "Generate" not in resample.bootstrap(df, "b", ["k"], ["x"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert resample.bootstrap(df.where("k < 0"), "b", ["k"], ["x"], 10).count() == 0
