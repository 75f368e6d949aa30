"""Spelling variants against brute force: the wavelet tree, near words, cut keys, forms and roots."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain(docs, every=97):
    """All pairs of words of whole texts."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@settings(max_examples=80, deadline=None)
@given(st.permutations(range(23)), st.lists(st.tuples(*[st.integers(0, 23)] * 4), min_size=1, max_size=12))
def test_the_tree_reports_the_rectangles(values, boxes):
    tree = spelling.WaveletTree(np.array(values))
    which, found = tree.report(*(np.array(c) for c in zip(*boxes)))
    want = [(k, v) for k, (x1, x2, y1, y2) in enumerate(boxes) for v in values[x1:x2] if y1 <= v < y2]
    assert sorted(zip(which, found)) == sorted(want)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6).flatmap(lambda size: st.tuples(st.just(size), st.sets(st.text("abé", min_size=max(1, size - 1), max_size=size), min_size=1, max_size=40))))
def test_near_pairs_are_each_found_once(case):
    size, words = case
    words = sorted(words, key=hash)
    got = []
    for first, last in ((0, size // 2), (size // 2, size)):
        if first < last:
            a, b = spelling.near_pairs(words, size, first, last)
            got += [(words[x], words[y]) for x, y in zip(a, b)]
    want = [(a, b) for a in words for b in words if one_edit(a, b) and len(b) == size]
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcÉé"), 7)) for _ in range(60)]
    docs = []
    for k in range(80):
        words = [stems[int(rng.integers(60) ** 2 // 60)] for _ in range(60)]
        for j in range(0, 60, 3):
            at = int(rng.integers(len(words[j]) + 1))
            words[j] = words[j][:at] + str(rng.choice(list("abcÉ"))) + words[j][at + int(rng.integers(2)):]
        docs.append((k if k % 9 else None, " ".join(words) + f" {stems[0].upper()},{stems[1]}7{stems[1]}"))
    return docs + [(90, None), (91, ""), (92, " \n7!"), (93, "x" * 3000 + " " + "x" * 2999), (93, "x" * 3000 + "-" + "x" * 2999), (None, "x" * 3000 + "_" + "x" * 2999), (94, "×÷×÷×abcd abcdefg")]


def test_equal_to_all_pairs_whatever_the_parts(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "first", "last", "size", "root", "near")})
    want = plain(texts)
    rows = lambda: {tuple(r) for r in spelling.spelling_variants(df).collect()}
    assert rows() == want and len(want) > 100
    assert {w for w, f, *_ in want if f and len(w) > 2000} == set() and {n for w, _, _, _, n, _ in want if len(w) > 2000} == {1}
    monkeypatch.setattr(spelling, "HOT", 6)
    monkeypatch.setattr(spelling, "PART", 300)
    monkeypatch.setattr(spelling, "CHUNK", 64)
    short = df.where(F.length("text") < 2000)
    assert {tuple(r) for r in spelling.spelling_variants(short).collect()} == plain([d for d in texts if len(d[1] or "") < 2000])


def test_counts_do_not_depend_on_pieces(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {tuple(r) for r in spelling.counted(df, 1, 3).collect()}
    monkeypatch.setattr(spelling, "READ", 10)
    assert list(spelling.pieces("ab cd " * 5)) == ["ab cd ab cd", " ab cd ab cd", " ab cd "]
    monkeypatch.setattr(spelling, "HELD", 5)
    assert {tuple(r) for r in spelling.counted(df, 1, 3).collect()} == want


def test_ties_and_chains(spark):
    n = {"abcde": 3, "abcdf": 6, "abcdg": 6, "abcdgh": 12, "abcxgh": 24, "lonely": 3, "lonelyx": 5}
    df = spark.createDataFrame([(k, w) for k, w in enumerate(w for w, c in n.items() for _ in range(c))], "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, every=10**12).collect()}
    assert got["abcde"] == ("abcdf", "abcdf", 3, 2, 6) and got["abcdg"] == ("abcdgh", "abcxgh", 6, 3, 12)
    assert got["abcdgh"] == ("abcxgh", "abcxgh", 12, 2, 24) and got["abcxgh"][:2] == (None, "abcxgh") and got["lonely"] == (None, "lonely", 3, 1, None)
    assert spelling.spelling_variants(df.where("doc_id < 0")).count() == 0


def test_all_of_the_smallest_table(spark, sf_dir, duck):
    from sieveworks.llm import registry

    got = {tuple(r) for r in registry.queries()["op13_spelling_variants"](spark, sf_dir).collect()}
    assert got == plain(duck.execute("SELECT doc_id, text FROM documents").fetchall())
