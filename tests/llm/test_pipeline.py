"""The pipeline's stages against plain versions of them, each on the stage's own input."""

import importlib.util
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import decontaminate, language_id, packing
from tests.llm.test_brute_force import brute_components, edit_distance

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(pipeline)


def cut_lines(docs):
    """Lines that equal an earlier one go, and those of at least 24 characters that nearly do; blank lines stay."""
    seen, short, out = [], set(), {}
    for i, text in sorted(docs.items()):
        kept = []
        for line in text.split("\n"):
            if len(line) < 24:
                if line not in short or not line.strip(" "):
                    kept.append(line)
                short.add(line)
                continue
            own = Counter(line)
            # two edits change at most two characters on either side
            near = any(line == s or abs(len(line) - len(s)) <= 2 and (own - c).total() <= 2 and (c - own).total() <= 2 and edit_distance(line, s) <= 2 for s, c in seen)
            seen.append((line, own))
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_stages_equal_plain_versions(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.columns, dict(pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = steps["language_id"](spark, docs, sf_dir).cache()
    before, after = texts(docs), texts(kept)
    assert kept.columns == columns and all(before[i] == t for i, t in after.items())
    assert all(language_id.gram_counts(t) is None for i, t in before.items() if i not in after)

    lines = steps["line_dedup"](spark, kept, sf_dir).cache()
    want = {i: t for i, t in cut_lines(after).items() if t.strip(" ") or t == after[i]}
    assert lines.columns == columns and texts(lines) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text != before[r.doc_id])

    near = steps["near_duplicates"](spark, lines, sf_dir).cache()
    want = {i for i, (_, c) in brute_components(list(texts(lines).items()), 5, 80).items() if i == c}
    assert near.columns == columns and set(texts(near)) == want

    clean = steps["decontamination"](spark, near, sf_dir).cache()
    items = decontaminate.Items([(str(i), t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()], decontaminate.EDITS)
    assert clean.columns == columns and texts(clean) == {i: t for i, t in texts(near).items() if not items.search(t)}

    packed = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in steps["packing"](spark, clean, sf_dir).collect()}
    encode, want = packing.encoder(), {}
    for i, t in texts(clean).items():
        ids = np.array([*encode(t), 0], "<u4")
        want |= {(i, k): (s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))}
    assert packed == want
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect()} == want


def test_stages_take_awkward_and_no_rows(spark, sf_dir, awkward, nothing):
    clashing = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    mine = ["lang_pred", "_language", "_judged", "n_lines", "n_repeated", "n_near", "_lines", "judged", "hot", "own", "at", "g", "first", "near", "rid", "n", "signature", "component_id", "kept"]
    for docs in (awkward, nothing):
        docs = docs.withColumns({c: docs["doc_id"] for c in mine})
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == columns
                assert docs.where(" OR ".join(f"NOT ({c} <=> doc_id)" for c in clashing + mine)).count() == 0
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == (0 if not rows else len({r.doc_id for r in rows if r.piece == 0}))
    near = dict(pipeline.STAGES)["near_duplicates"]
    twice = awkward.where("doc_id = 2").select("doc_id", "text", "lang", "source", "n_chars")
    assert near(spark, twice, sf_dir).count() == 1


@pytest.mark.parametrize("labels", [1, 3, 6])
def test_the_language_decision_holds_for_any_number_of_languages(spark, sf_dir, labels):
    stage = dict(pipeline.STAGES)["language_id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.concat("lang", F.pmod(F.xxhash64("doc_id"), F.lit(labels)).cast("string")))
    kept = stage(spark, docs, sf_dir)
    assert kept.count() == docs.count() - sum(language_id.gram_counts(r.text) is None for r in docs.select("text").collect())
    r = random.Random(4)
    noise = [(10**6 + k, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz漢字日本кдвжф") for _ in range(r.randint(2, 9))) for _ in range(80))) for k in range(20)]
    more = docs.unionByName(spark.createDataFrame(noise, "doc_id long, text string"), allowMissingColumns=True)
    assert stage(spark, more, sf_dir).where("doc_id >= 1000000").count() == 0
    unknown = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    assert stage(spark, unknown, sf_dir).where("lang IS NULL").count() == 0
