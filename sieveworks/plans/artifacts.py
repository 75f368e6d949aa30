"""Registered queries: score caches, pinned models, bitmaps, folded texts, digest trees, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folding, graphs, models, programs, vectors
from ..operators import merkle
from ..operators.score_cache import ScoreCache
from ..sources import tables
from .selection import documents, table

SLOTS, BIAS = 64, -0.1


def score_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of part names in a second run over all parts, after a first one over every other."""
    cache = ScoreCache(spark, tables.new_folder(spark, "scores"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    scorer = lambda text: F.length(text) / 2.0
    cache.score(parts.where("p_partkey % 2 = 0"), "p_name", scorer)
    out, counts = cache.score(parts, "p_name", scorer)
    return out.select("p_partkey", "score", F.lit(counts["wanted"]).cast("long").alias("wanted"), F.lit(counts["scored"]).cast("long").alias("scored"))


def pinned_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names scored by a model made from the parts, written, pinned by its digest and read by the workers."""
    parts = table(spark, sf_dir, "part")
    letters = parts.select((F.col("p_size") > 25).cast("double").alias("large"), F.explode(F.split("p_name", "")).alias("c"))
    weights = np.zeros(SLOTS)
    for slot, weight in letters.groupBy(vectors.folded_slot(F.col("c"), SLOTS).alias("slot")).agg(F.round(F.avg("large") - 0.5, 6)).collect():  # at most SLOTS rows
        weights[slot] = weight
    pinned = models.publish(spark, models.Linear(weights, BIAS, 1), tables.new_folder(spark, "models"), "LARGE")
    score = pinned.scorer(spark)
    source = pinned.provenance(spark).select("property", F.length("sha256").alias("digits"))
    return parts.select("p_partkey", F.round(score(F.col("p_name")), 9).alias("score")).join(F.broadcast(source))  # one row


def bitmap_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document's words with the next one's, by packed bitmaps of 2048 folded slots."""
    words = F.array_distinct(F.split("text", " "))
    bits = documents(spark, sf_dir).select("doc_id", vectors.bitmap(F.transform(words, lambda w: vectors.folded_slot(w))).alias("bits"))
    after = bits.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bits").alias("next"))
    ones = F.aggregate("bits", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))
    return bits.join(after, "doc_id").select("doc_id", F.round(vectors.bitmap_similarity(F.col("bits"), F.col("next")), 9).alias("similarity"), ones.alias("ones"))


def compatibility_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of texts that were written in wide letters, in decomposed letters, or plainly."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    wide = F.translate("text", "abcdefghijklmno", "".join(chr(0xFF41 + k) for k in range(15)))
    for plain, apart in (("é", "é"), ("ñ", "ñ"), ("ü", "ü"), ("ç", "ç")):
        apart_text = F.replace(F.col("text") if plain == "é" else apart_text, F.lit(plain), F.lit(apart))  # noqa: F821  the text so far
    way = F.pmod("doc_id", F.lit(3))
    written = docs.withColumn("text", F.when(way == 0, wide).when(way == 1, apart_text).otherwise(F.col("text")))
    return folding.nfkc(written, "text").select("doc_id", F.md5(programs.plain_name(F.col("text")).cast("binary")).alias("name_md5"))


def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of parts, and which of its nodes differ once one part has another name."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.md5(F.col("p_name").cast("binary")).alias("digest"))
    changed = parts.withColumn("digest", F.when(F.col("name") == "77", F.lit("other")).otherwise(F.col("digest")))
    nodes = tables.checkpointed(merkle.tree(merkle.leaves_of(parts, "name", "digest"), 2))
    now = tables.checkpointed(merkle.updated(nodes, merkle.leaves_of(changed, "name", "digest"), spark.range(1).select(F.lit("77").alias("name")), 2))
    differs = merkle.differing(nodes, now, 2).withColumn("differs", F.lit(True))
    return nodes.join(differs, ["level", "node"], "left").withColumn("differs", F.coalesce("differs", F.lit(False)))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph texts from parts: a chain of 1 + size % 9 carbons between two of six end groups by partkey, written from either end; every 13th is broken."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    left, right = (F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 6 + 1).cast("int")) for texts in (("O", "N", "OC(=O)", "c1ccccc1", "F", "C1CC1"), ("O", "N", "C(=O)O", "c1ccccc1", "F", "C1CC1")))
    end = F.element_at(F.array(*map(F.lit, ("N", "O", "Cl"))), (F.floor(F.col("p_partkey") / 6) % 3 + 1).cast("int"))
    chain = F.repeat(F.lit("C"), (1 + F.col("p_size") % 9).cast("int"))
    broken = F.when(F.col("p_partkey") % 13 == 0, "(").otherwise("")
    return parts.select("p_partkey", "p_size", F.concat(left, chain, end, broken).alias("one"), F.concat(end, chain, right, broken).alias("other"))


def graph_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both ways to write a part's graph have one form, and how many parts share it."""
    texts = _chains(spark, sf_dir)
    a = graphs.forms(texts, "one", "form").drop("descriptors")
    both = graphs.forms(a, "other", "form2").drop("descriptors")
    same = both.groupBy("form").agg(F.count("*").alias("copies"))
    return both.join(same, "form").select("p_partkey", (F.col("form") == F.col("form2")).alias("same"), (F.col("form") != "").alias("valid"), "copies")


def graph_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven descriptors of each part's graph."""
    return graphs.forms(_chains(spark, sf_dir), "other").select("p_partkey", "descriptors.*")


_FOLDED = "('0x' || substr(md5(w), 1, 8))::UBIGINT"
_NODE = "sha256(string_agg(strlen({0})::VARCHAR || ':' || {0}, '' ORDER BY {0}))"
SQL = {
    "score_cache_reuse": """
WITH w AS (SELECT count(DISTINCT p_name) AS wanted, count(DISTINCT p_name) - count(DISTINCT p_name) FILTER (WHERE p_partkey % 2 = 0) AS scored FROM part)
SELECT p_partkey, length(p_name) / 2.0::DOUBLE AS score, wanted, scored FROM part, w""",
    "pinned_model_scores": f"""
WITH l AS (SELECT p_partkey, p_size > 25 AS large, unnest(string_split(p_name, '')) AS w FROM part), s AS (SELECT *, {_FOLDED} % {SLOTS} AS slot FROM l),
m AS (SELECT slot, round(avg(large::INTEGER::DOUBLE) - 0.5::DOUBLE, 6) AS weight FROM s GROUP BY slot)
SELECT p_partkey, round(1 / (1 + exp(-(sum(weight) + {BIAS}::DOUBLE))), 9) AS score, 'LARGE' AS property, 64 AS digits FROM s JOIN m USING (slot) GROUP BY p_partkey""",
    "bitmap_similarity": f"""
WITH s AS (SELECT doc_id, list_distinct(list_transform(list_distinct(string_split(text, ' ')), lambda w: {_FOLDED} % 2048)) AS s FROM documents)
SELECT a.doc_id, round(coalesce(len(list_intersect(a.s, b.s))::DOUBLE / nullif(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 0), 0), 9) AS similarity, len(a.s)::BIGINT AS ones FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
    "compatibility_folded": "SELECT doc_id, md5(regexp_replace(lower(trim(coalesce(text, ''))), '[\\s_\\-]+', '', 'g')) AS name_md5 FROM documents",
    "tree_digest": f"""
WITH l AS (SELECT sha256(p_partkey::VARCHAR) AS place, p_partkey::VARCHAR || '=' || md5(p_name) AS item FROM part),
n2 AS (SELECT substr(place, 1, 2) AS node, count(*) AS leaves, {_NODE.format('item')} AS digest FROM l GROUP BY 1),
n1 AS (SELECT substr(node, 1, 1) AS node, sum(leaves)::BIGINT AS leaves, {_NODE.format('item')} AS digest FROM (SELECT *, node || '=' || digest AS item FROM (SELECT node, leaves, digest FROM n2)) GROUP BY 1),
n0 AS (SELECT '' AS node, sum(leaves)::BIGINT AS leaves, {_NODE.format('item')} AS digest FROM (SELECT *, node || '=' || digest AS item FROM (SELECT node, leaves, digest FROM n1)))
SELECT level, node, leaves, digest, starts_with(sha256('77'), node) AS differs FROM (SELECT 0 AS level, * FROM n0 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 2, * FROM n2)""",
}
_CHAIN = """
SELECT p_partkey, 1 + p_size % 9 AS n, p_partkey % 6 AS g, (p_partkey // 6) % 3 AS e, p_partkey % 13 = 0 AS broken FROM part"""
SQL["graph_forms"] = f"""
WITH c AS ({_CHAIN}),
-- an oxygen at one end and a nitrogen at the other are one graph whichever is written first
k AS (SELECT *, CASE WHEN broken THEN '' WHEN g = 0 AND e = 0 OR g = 1 AND e = 1 THEN 'on' || n ELSE g || '-' || e || '-' || n END AS form FROM c)
SELECT p_partkey, true AS same, NOT broken AS valid, count(*) OVER (PARTITION BY form) AS copies FROM k"""
SQL["graph_descriptors"] = f"""
WITH c AS ({_CHAIN}),
-- of each end group: mass, donors, acceptors, polar area, rings, atoms, and whether the bond to it can turn
g AS (SELECT * FROM (VALUES (0, 15.999 + 1.008, 1, 1, 20.23, 0, 1, 0), (1, 14.007 + 2 * 1.008, 1, 1, 26.02, 0, 1, 0), (2, 12.011 + 2 * 15.999 + 1.008, 1, 1, 37.30, 0, 3, 1), (3, 6 * 12.011 + 5 * 1.008, 0, 0, 0.0, 1, 6, 1),
      (4, 18.998, 0, 0, 0.0, 0, 1, 0), (5, 3 * 12.011 + 5 * 1.008, 0, 0, 0.0, 1, 3, 1)) AS t(g, gm, gd, ga, gp, gr, gn, gt)),
e AS (SELECT * FROM (VALUES (0, 14.007 + 2 * 1.008, 1, 1, 26.02), (1, 15.999 + 1.008, 1, 1, 20.23), (2, 35.453, 0, 0, 0.0)) AS t(e, em, ed, ea, ep)),
j AS (SELECT *, NOT broken AS ok FROM c JOIN g USING (g) JOIN e USING (e))
SELECT p_partkey, CASE WHEN ok THEN round((n * (12.011 + 2 * 1.008) + gm + em)::DOUBLE, 3) END AS weight, CASE WHEN ok THEN (gd + ed)::BIGINT END AS donors, CASE WHEN ok THEN (ga + ea)::BIGINT END AS acceptors,
       CASE WHEN ok THEN (n - 1 + gt)::BIGINT END AS rotatable, CASE WHEN ok THEN round((gp + ep)::DOUBLE, 2) END AS polar_area, CASE WHEN ok THEN gr::BIGINT END AS rings, CASE WHEN ok THEN (n + gn + 1)::BIGINT END AS heavy_atoms FROM j"""
QUERIES = {f.__name__: f for f in (graph_forms, graph_descriptors, score_cache_reuse, pinned_model_scores, bitmap_similarity, compatibility_folded, tree_digest)}
