"""Operators against plain versions, exact round trips and held-out accuracy."""

import bisect
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import components, decontaminate, html_extract, language_id, line_dedup, lm_score, near_dup, neighbours, packing, registry, secret_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def best_fit_sequences(lengths, capacity):
    """The number of sequences of piece-by-piece best-fit decreasing."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 90).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=120))))
def test_the_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    steps = packing.plan(Counter(lengths), capacity)
    placed = {}
    for length, n in Counter(lengths).items():
        own = [s for s in steps if s[0] == length]
        for k in range(n):
            _, first, each, sequence, offset = max((s for s in own if s[1] <= k), key=lambda s: s[1])
            placed.setdefault(sequence + (k - first) // each, []).append((offset + (k - first) % each * length, length))
    for pieces in placed.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(placed) == best_fit_sequences(lengths, capacity)


def test_pieces_hold_the_tokenizers_ids(spark, sf_dir, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = registry.queries()["op2_best_fit_packing"](spark, sf_dir).toPandas().set_index(["doc_id", "piece"])
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for number, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            assert tuple(rows.loc[(doc_id, number), ["start", "length", "ids_crc32"]]) == (start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()))
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@lru_cache(maxsize=1)
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", " ", "  \n", "\t", "it's", "<|endoftext", "|>", "\u3000", "\x85", "\u200b", "12", "é", "漢字"]))).map("".join))
def test_ids_are_those_of_tokenizers_defaults(text):
    assert packing.encoder()(text) == tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b", "a" * 1_000_000, "x <|endoftext|>" + "\u3000" * 20_000 + "\n" + " " * 9_999, " \n" * 30_000 + "<|endoftext|> end"])
def test_ids_of_long_runs(text):
    assert packing.encoder()(text) == tokenizer().encode(text, add_special_tokens=False).ids


def test_packing_of_very_long_texts(spark):
    df = spark.createDataFrame([(1, " " * 2_000_000), (2, "a <|endoftext|>"), (3, "word " * 300_000)], "doc_id long, text string")
    rows = packing.pack(df, with_ids=False).collect()
    for i, text in ((1, " " * 2_000_000), (2, "a <|endoftext|>"), (3, "word " * 300_000)):
        assert sum(r.length for r in rows if r.doc_id == i) == len(tokenizer().encode(text, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("pieces", [1, 10_000_000])
def test_pieces_are_placed_alike_in_all_parts(spark, monkeypatch, pieces):
    monkeypatch.setattr(packing, "PIECES_PER_PART", pieces)
    df = spark.range(400).selectExpr("id AS doc_id", "CAST(0 AS int) AS piece", "CAST(pmod(id * 37, 9) + 1 AS long) AS length")
    rows = packing.place(df, 20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        ends = [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 20
    assert len(by) == best_fit_sequences([r.length for r in rows], 20)


def brute_components(texts, k, percent):
    sets = {i: {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for i, w in ((i, words(t)) for i, t in texts)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf_dir, duck):
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    rows = registry.queries()["op10_near_duplicates"](spark, sf_dir).collect()
    want = brute_components(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("switches", [{}, {"TILE": 7}, {"TILE": 3, "BAND_TILE": 2}, {"TILE_BYTES": 2000, "BAND_TILE": 5}])
def test_chains_and_tiles_of_near_duplicates(spark, monkeypatch, switches):
    for name, value in switches.items():
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    texts = []
    for k in range(60):  # every copy changes a word of the one before: a chain whose ends are far apart
        texts.append((k, " ".join(base)))
        base = base[:]
        base[r.randrange(80)] = f"n{k}"
    star = [f"s{r.randrange(10**6)}" for _ in range(90)]
    for k in range(60, 90):  # near copies of one text, and some of those
        own = star[:]
        for _ in range(r.randint(0, 6)):
            own[r.randrange(90)] = f"x{r.randrange(10**6)}"
        texts.append((k, " ".join(own)))
    for k in range(90, 120):  # half alike: they share bands, but are not linked
        texts.append((k, " ".join(star[:45] + [f"y{r.randrange(10**6)}" for _ in range(20)])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


@pytest.mark.parametrize("limit", [0, 300_000])
def test_components_of_any_graph_take_few_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_NODES", limit)
    r = random.Random(7)
    edges = [(k, k + 1) for k in range(1000)] + [(2000, 2000 + k) for k in range(1, 400)] + [(5000 + r.randrange(300), 5000 + r.randrange(300)) for _ in range(200)] + [(9000, 9000), (None, 4), (7, 6), (6, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    rounds = []
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components.components(df, rounds=rounds).collect()}
    assert got == {x: find(x) for x in parent} and len(rounds) < 25
    assert components.components(df.where("a < -5")).count() == 0


def test_language_on_held_out_documents(spark, sf_dir, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = registry.queries()["op6_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_counted_scores_equal_bundled_vectors():
    counts = language_id.count_grams  # the identity below is what counting relies on
    text, codes = "hola que tal", language_id.gram_counts("hola que tal")
    bundle = (language_id.gram_vectors(codes[0]).astype(float) * codes[1][:, None]).sum(axis=0)
    import pandas as pd

    model = language_id.LanguageModel.from_counts(pd.DataFrame({"lang": "es", "code": codes[0], "n": codes[1]}))
    assert counts and np.allclose(codes[1] @ model.scores[codes[0], 0], bundle @ bundle / np.linalg.norm(bundle), rtol=1e-4) and model.predict(text)[0] == "es"


def test_base_scores_and_both_transports(spark, sf_dir, duck, monkeypatch):
    tokens = {i: [*words(t), None] for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    train = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(t)
    n, v = sum(train.values()), len(train)
    query = registry.queries()["op8_lm_score"]
    rows = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(train[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    assert sum(r.score - r.base_score for r in rows.values() if r.held_out) > 0
    monkeypatch.setattr(lm_score, "BROADCAST_BYTES", -1)
    assert {r.doc_id: r.score for r in query(spark, sf_dir).collect()} == {i: r.score for i, r in rows.items()}


@pytest.mark.parametrize("entries", [2_000_000, 300])
def test_scores_equal_an_exact_pair_model(spark, sf_dir, duck, monkeypatch, entries):
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", 3_000_000 if entries > 1000 else 2_000)
    tokens = {i: [*words(t), None] for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    single, pairs, texts = Counter(), Counter(), 0
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            single.update(t)
            pairs.update(zip(["start", *map(repr, t[:-1])], t))
            texts += 1
    n, v = sum(single.values()), len(single)
    excess = total = 0
    for r in registry.queries()["op8_lm_score"](spark, sf_dir).collect():
        want, t = 0.0, tokens[r.doc_id]
        for before, word in zip(["start", *map(repr, t[:-1])], t):
            context = texts if before == "start" else single[eval(before)]
            base = (single[word] + 0.1) / (n + 0.1 * (v + 1))
            count = pairs[before, word]
            low = 2 ** math.floor(math.log2(count)) if count else 0  # the filter holds powers of two
            want += math.log10(lm_score.MIX * min(1, low / context) + (1 - lm_score.MIX) * base) if context else math.log10(base)
        # a filter can only take a pair for more frequent than it is, and rarely does
        assert r.score >= want - 1e-6 * len(t)
        excess, total = excess + r.score - want, total + len(t)
    assert excess <= 0.03 * total


def test_language_predictions_equal_bundled_vectors(spark, sf_dir, duck):
    rows = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    bundle = {}
    for i, text, _ in rows:
        if (grams := language_id.gram_counts(text)) is not None:
            bundle[i] = grams[1].astype(float) @ language_id.gram_vectors(grams[0]).astype(float)
    names = sorted({lang for _, _, lang in rows if lang})
    learn = {i: lang for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 5 and i in bundle}
    prototypes = np.stack([sum(bundle[i] for i, lang in learn.items() if lang == name) for name in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    for r in registry.queries()["op6_language_id"](spark, sf_dir).collect():
        if r.doc_id not in bundle:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = np.maximum(prototypes @ bundle[r.doc_id], 0)
        assert r.lang_pred == names[int(np.argmax(cosines))] and r.score == pytest.approx(cosines.max() / cosines.sum(), rel=1e-3)


def test_ties_between_languages_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "uno dos tres", "b"), (2, "uno dos tres", "a"), (3, "uno dos", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(df)).collect()} == {"a"}


def test_secret_scores_equal_the_forest_itself(spark, sf_dir):
    trees = secret_scan.default_trees(spark)

    def predict(tree, row):
        lines = [x.strip() for x in tree.splitlines()[1:] if x.strip()]
        at = 0

        def node():
            nonlocal at
            line = lines[at]
            at += 1
            if line.startswith("Predict"):
                return float(line.split(":")[1])
            _, number, sign, bound = re.match(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line).groups()
            low = node()
            at += 1
            high = node()
            return low if row[secret_scan.FEATURES[int(number)]] <= float(bound) else high

        return node()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = secret_scan.described(secret_scan.candidates(docs)).select("doc_id", "at", "value", *secret_scan.FEATURES).collect()
    want = Counter((r.doc_id, r.at, r.value, round(sum(predict(t, r) for t in trees) / len(trees), 9)) for r in rows)
    assert rows and Counter((r.doc_id, r.at, r.secret, round(r.score, 9)) for r in secret_scan.scan(docs, trees).collect()) == want


def test_long_runs_are_scanned_in_proportion(spark):
    import time

    trees = secret_scan.default_trees(spark)
    texts = ["a" * 400_000, "a-" * 200_000 + " x", "1" * 400_000, "aaaaaaaaaaaaaaaaa " * 20_000, "9" + "b" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    assert secret_scan.scan(df, trees).count() == 2 and time.perf_counter() - began < 30


def test_filter_levels_are_never_too_low():
    r = np.random.default_rng(1)
    keys, counts = np.unique(r.integers(0, 1 << 62, 20_000).astype(np.uint64)), None
    counts = r.geometric(0.2, len(keys))
    shard = lm_score.Shard.build(keys, counts)
    level = shard.read(keys)
    assert (level >= lm_score.levels_of(counts)).all() and (level > lm_score.levels_of(counts)).mean() < 0.03
    assert (shard.read(r.integers(0, 1 << 62, 20_000).astype(np.uint64)) > 0).mean() < 0.03
    assert (lm_score.lowest(lm_score.levels_of(np.arange(1, 99))) <= np.arange(1, 99)).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("switches", [{}, {"HOT_KEY": 2, "BROADCAST_KEYS": 0}, {"COMMON": 1, "SHARE": 1, "HOT_KEY": 5}])
def test_line_links_equal_brute_force(spark, monkeypatch, switches):
    for name, value in switches.items():
        monkeypatch.setattr(line_dedup, name, value)
    r = random.Random(3)
    lines = ["".join(r.choice("abcdé ") for _ in range(r.randint(24, 40))) for _ in range(30)]
    for line in lines[:30]:
        for edits in (1, 2, 3):
            own = list(line)
            for _ in range(edits):
                k = r.randrange(len(own))
                own[k:k + 1] = r.choice(([], ["x"], [own[k], "y"]))
            lines.append("".join(own))
    for _ in range(40):  # lines of one length that share segments
        own = list("gdhabecfdgehacbdfgeahcbdgfehadcbgfehdabc")
        for _ in range(r.randint(0, 3)):
            own[r.randrange(40)] = r.choice("xyzé😀")
        lines.append("".join(own))
    lines = sorted({x for x in lines if len(x) >= 24})
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup.lines_of(df, 24, "doc_id", "text")
    names = dict((h, x) for x, h in df.select("text", F.xxhash64("text").alias("h")).collect())
    got = {tuple(sorted((names[p.a], names[p.b]))) for p in line_dedup.links(rows).collect()}
    want = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1:] if edit_distance(a, b) <= 2}
    assert got == want
    first = rows.select("h", "g", F.struct("doc", "row", "number").alias("first"), "line")
    assert {names[x.h] for x in line_dedup.near_earlier(first).collect()} == {b for _, b in want}


def test_common_lines_are_cut_alike(spark, monkeypatch):
    r = random.Random(8)
    texts = [(k, "\n".join(["a line that every document holds", f"own line {k} {r.random()}", "ok"])) for k in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = [(k, 3, 2 if k else 0, t if not k else t.split("\n")[1]) for k, t in texts]
    assert sorted(tuple(x) for x in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_repeated", "text").collect()) == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(9)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", ""), ("", "abcd")]
    for _ in range(150):
        own = [r.choice("abé") for _ in range(r.randint(1, 12))]
        other = own[:]
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(other) + 1)
            other[k:k + r.randint(0, 1)] = r.choice(([], ["x"], ["a"]))
        pairs.append(("".join(own), "".join(other)))
    rows = spark.createDataFrame([(a, b, list(a), list(b)) for a, b in pairs], "a string, b string, x array<string>, y array<string>")
    for row in rows.select("a", "b", line_dedup.within_by_bits(F.col("x"), F.col("y"), edits).alias("bits"), line_dedup.within(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert row.bits == row.near == (edit_distance(row.a, row.b) <= edits)


def test_leaks_survive_edits_and_clean_texts_do_not_match(duck):
    items = [(str(i), t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    search, r = decontaminate.Items(items, decontaminate.EDITS), random.Random(2)
    vocabulary = [w for _, t in items for w in t.split()]
    found = 0
    for item, text in items:
        own = text.split()
        for _ in range(len(own) // 6):
            k = r.randrange(len(own))
            own[k:k + 1] = r.choice(([], [r.choice(vocabulary)], [own[k], r.choice(vocabulary)]))
        hits = search.search(" ".join(r.choices(vocabulary, k=50) + own + r.choices(vocabulary, k=50)))
        found += any(h[0] == item for h in hits)
    assert found >= 0.97 * len(items)
    assert sum(bool(search.search(" ".join(r.choices(vocabulary, k=300)))) for _ in range(50)) == 0


@pytest.mark.parametrize("passes", [20_000, 7])
def test_leaks_equal_exact_search(spark, sf_dir, duck, monkeypatch, passes):
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", passes)
    items = [(i, decontaminate.words_of(t)) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    numbers, want = {}, {}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        words_ = np.array([numbers.setdefault(w, len(numbers)) for w in decontaminate.words_of(text)])
        for item, own in items:
            edits = decontaminate.passage_distance(np.array([numbers.setdefault(w, len(numbers)) for w in own]), words_)
            if edits <= int(decontaminate.EDITS * len(own)):
                want[doc, item] = edits
    got = {(r.doc_id, r.item_id): r.edits for r in registry.queries()["op5_benchmark_leaks"](spark, sf_dir).collect()}
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want)
    verbatim = duck.execute("SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()
    assert {r[0] for r in verbatim} <= {d for d, _ in got}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 12, 40, 300])
def test_leaks_of_items_of_any_length(width):
    r = random.Random(width)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(str(k), " ".join(r.choices(vocabulary, k=width))) for k in range(30)]
    search, t, found, n = decontaminate.Items(items, decontaminate.EDITS), int(decontaminate.EDITS * width), 0, 0
    for item, text in items:
        for edits in sorted({0, t // 2, t}):
            own = text.split()
            for _ in range(edits):
                k = r.randrange(len(own))
                own[k:k + 1] = r.choice(([], [r.choice(vocabulary)], [own[k], r.choice(vocabulary)]))
            hits = [h for h in search.search(" ".join(["aa"] * 20 + own + ["bb"] * 20)) if h[0] == item]
            assert edits or hits == [(item, 0, 20)]
            found, n = found + bool(hits), n + 1
    assert found >= 0.95 * n


@pytest.mark.parametrize("width", [8, 20, 40, 41, 60, 100, 200, 300, 600, 1200])
def test_nine_in_ten_are_found_at_the_full_budget_of_each_kind_of_edit(width):
    r, n = random.Random(width), 30 if width <= 300 else 8
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(width)] for _ in range(n)]
    search, budget = decontaminate.Items([(k, " ".join(x)) for k, x in enumerate(items)], decontaminate.EDITS), int(decontaminate.EDITS * width)
    for kind in ("delete", "insert", "replace", "mixed"):
        found = 0
        for k, words_ in enumerate(items):
            kinds = [kind if kind != "mixed" else r.choice(("delete", "insert", "replace")) for _ in range(budget)]
            places = r.sample(range(width), sum(x != "insert" for x in kinds))
            gone = set(places[:kinds.count("delete")])
            text = [f"x{r.randrange(10**9)}" if i in set(places) else w for i, w in enumerate(words_) if i not in gone]
            for _ in range(kinds.count("insert")):
                text.insert(r.randrange(len(text) + 1), f"y{r.randrange(10**9)}")
            around = lambda: [r.choice(vocabulary) for _ in range(30)]
            found += any(hit[0] == k and hit[1] <= budget for hit in search.search(" ".join([*around(), *text, *around()])))
        assert found >= 0.9 * n, (kind, found, n)


def test_leaks_in_scripts_without_blanks():
    search = decontaminate.Items([("1", "以下哪个城市是法国的首都和最大的城市"), ("2", "ประเทศไทยมีเมืองหลวงชื่อว่าอะไร")], decontaminate.EDITS)
    assert [h[:2] for h in search.search("他问：以下哪个城市是法国的首都和最大的城市？")] == [("1", 0)]
    assert [h[0] for h in search.search("他问以下哪座城市是法国的首都或最大的城市吗")] == ["1"] and [h[0] for h in search.search("ถามว่าประเทศไทยมีเมืองหลวงชื่อว่าอะไรครับ")] == ["2"]
    assert search.search("一个完全不同的句子没有任何关系") == []


def test_extraction_of_unseen_layouts():
    trees, r, good, n = html_extract.model(), random.Random(12_345), 0, 0
    for _ in range(120):
        order, label = html_extract.labelled(html_extract.training_page(r))
        html_extract.decode(order, trees.raw(html_extract.features(order)))
        n += (label >= 0).sum()
        good += sum((x.main == 2) == (m == 1) for x, m in zip(order, label) if m >= 0)
        for x in order:  # nothing is kept inside what is dropped
            assert x.parent is None or x.main == 0 or x.parent.main != 0
    assert good / n > 0.98


PROSE = "The quick brown fox jumps over a lazy dog and then it runs back into the forest where all of its friends have been waiting since the early morning".split()


@pytest.mark.parametrize("size", [1, 3, 8, 20, 28, 60])
def test_extraction_of_short_and_plain_pages(size):
    text = " ".join((PROSE * 3)[:size]) + "."
    menu, foot = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav>", "<footer>&copy; 2024 Site</footer>"
    pages = {
        f"<article><p>{text}</p></article>": text, f"<html><body><p>{text}</p></body></html>": text, f"<html><body>{menu}<article><p>{text}</p></article>{foot}</body></html>": text,
        f"<div>{text}</div>": text, f"<html><body><h1>Title</h1><p>{text}</p></body></html>": f"Title\n\n{text}", f"<html><body>{menu}<article><h1>Title</h1><p>{text}</p></article>{foot}</body></html>": f"Title\n\n{text}",
        f"<html><body><article>{text}</article></body></html>": text, f"<body><h1>Title</h1>{text}<br><br>second part<p>last</p></body>": f"Title\n\n{text} second part\n\nlast",
    }
    assert dict(zip(pages, html_extract.extract_texts(list(pages), html_extract.model()))) == pages


def test_hidden_elements_and_attributes():
    shown = "Some words of the valley are here to be read by all of us."
    pages = {
        f"<article><p>{shown} <span style='display: none'>secret <span>x</span> more</span>And <button>Buy</button>these too.</p></article>": f"{shown} And these too.",
        f'<article aria-hidden="false" data-hidden title="the hidden valley"><p>{shown}</p></article>': shown, f"<article><p>{shown}</p><div hidden><p>not this</p></div></article>": shown,
        f"<article><p>{shown}</p><script>if (a<b) x = '<p>no</p>'</script></article>": shown, f"<article><p>1 < 2 and {shown}</p></article>": f"1 < 2 and {shown}",
    }
    assert dict(zip(pages, html_extract.extract_texts(list(pages), html_extract.model()))) == pages


@pytest.mark.parametrize("piece", ["<a ", "</p", "<!--", '<a title="x> ', "<script>", "</script ", "<b x='", "<p>", "a<", "<div>", "<li>", "<body>", "<span hidden>", "&amp", "<p>x</p>"])
def test_long_pages_take_time_in_proportion(piece):
    import time

    began = time.perf_counter()
    html_extract.extract_texts([piece * (1_000_000 // len(piece))], html_extract.model())
    html_extract.extract_texts(["<div>" * 50_000 + piece * 50_000 + "</p>" * 50_000], html_extract.model())
    assert time.perf_counter() - began < 30


def test_extraction_of_repeated_and_no_pages(spark):
    df = spark.createDataFrame([(1, "<p>Some words to read here.</p>"), (1, "<p>Some words to read here.</p>"), (None, None)], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(df).collect()) == [(0, ""), (1, "Some words to read here."), (1, "Some words to read here.")]
    assert html_extract.extract(df.where("page_id > 5")).count() == 0


def test_extraction_of_the_pages_table(spark, sf_dir, duck):
    import html

    def gold(page):
        parts = re.split(r"</?(?:p|h1|h2|li|div)[^>]*>", re.search(r"<article>(.*)</article>", page, re.S)[1])
        out = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", ""))).strip() for x in parts]
        return "\n\n".join(x for x in out if x)

    want = {i: gold(h) for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    rows = registry.queries()["op1_html_extraction"](spark, sf_dir).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_secrets_in_documents(spark, sf_dir, duck):
    want = set()
    for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        want |= {(i, m[1]) for m in re.finditer(r'(?i)(?:token = "|password=)([0-9a-f]{12,})', t)} | {(i, m[0]) for m in re.finditer(r"\bAKIA[0-9A-Z]{16}\b", t)}
    assert {(r.doc_id, r.secret) for r in registry.queries()["op7_secret_scan"](spark, sf_dir).collect()} == want


def test_neighbour_recall(spark, sf_dir, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in registry.queries()["op4_nearest_neighbours"](spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(set(best) & set(got[ids[k]])), total + 20
        for i, v in got[ids[k]].items():
            assert v == pytest.approx(float(x[np.flatnonzero(ids == i)[0]] @ x[k]), abs=1e-9)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("size, hub", [(1500, False), (4000, True)])
def test_the_graph_improves_by_rounds(spark, monkeypatch, size, hub):
    r = np.random.default_rng(4)
    x = r.normal(size=(size, 16))
    if hub:  # many nodes have the same neighbours
        x += 2 * (np.arange(size) % 50 == 0)[:, None]
        monkeypatch.setattr(neighbours, "MEMBERS", 24)
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in neighbours.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20]))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("kind", ["near copies", "one long vector"])
def test_recall_beside_near_copies_and_a_long_vector(spark, kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "near copies":
        x[::3] = x[0] + 0.0001 * r.normal(size=(500, 32))
    else:
        x[7] *= 1000
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in neighbours.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20]))
    assert hits >= 0.97 * 20 * len(got) and len(got) == 75


def test_a_search_follows_the_links_back_to_a_hub(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 1)
    r = np.random.default_rng(8)
    x = r.normal(size=(101, 16))
    x[1:61] = x[0] + 0.05 * r.normal(size=(60, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = neighbours.closeness(x).astype(np.float32)
    # the hub 0 has 32 far neighbours; 60 near nodes have it as their only one and are in no list
    lists = {k: list(range(61, 93)) if k == 0 else [0] for k in range(101)}
    graph = spark.createDataFrame([(k, x[k].tobytes(), np.array(v, np.int64).tobytes(), near[k, v].tobytes()) for k, v in lists.items()], "node long, packed binary, ids binary, near binary")
    queries = spark.createDataFrame([(0, x[0].tobytes())], "query long, asked binary")
    [found] = neighbours.greedy_search(graph, queries, 40, 101).collect()
    assert set(np.argsort(-(x.astype(float) @ x[0].astype(float)))[:41]) <= set(np.frombuffer(found.ids, np.int64))
