"""Registered queries: selection, splits, schedules and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, programs
from ..operators import integrity, schedule, selection
from ..sources.tables import bucket_index

SEED = 1701


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly to all tasks, before what costs much a row: one row group of narrow rows is one task, though it holds millions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def balanced_clean_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    leaked = selection.containing(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")
    keyed = docs.select("doc_id", "lang", keys.rank16(keys.sha(F.col("text"))).alias("key")).join(leaked, "doc_id", "left_anti")
    first = selection.first_seen(keyed, F.col("key"), ["doc_id"])
    return selection.smallest(first, ["lang"], [keys.stable_key(SEED, F.col("doc_id")), "doc_id"], 30)


def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = documents(spark, sf_dir).select("doc_id", "lang", keys.rank16(keys.sha(F.col("text"))).alias("key"))
    return selection.first_seen(keyed, F.col("key"), ["doc_id"])


def dup_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = documents(spark, sf_dir).select("doc_id", "lang", keys.sha(F.col("text")).alias("key"))
    # one small row per key instead of a window over whole groups of copies
    by_key = keyed.groupBy("key", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    least = by_key.groupBy("key").agg(F.min("first").alias("least"))
    rows = by_key.join(least, "key").withColumn("kept", (F.col("first") == F.col("least")).cast("long"))
    items = F.array(F.struct(F.lit("kept").alias("outcome"), F.col("kept").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - F.col("kept")).alias("n")))
    return rows.select("lang", F.explode(items).alias("o")).groupBy("lang", "o.outcome").agg(F.sum("o.n").alias("n")).where("n > 0")


def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "benchmark").select(keys.text_hash(F.col("text")).alias("key"))
    return selection.drop_leaks(documents(spark, sf_dir).select("doc_id", "lang", keys.text_hash(F.col("text")).alias("text_key")), held, ["text_key"])


def leakage_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.containing(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


def hash_mod_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = keys.sha(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", selection.hash_bucket(digest, 2, 6).alias("bucket"), keys.short_id("doc", digest).alias("short_id"), keys.pair_key(F.col("lang"), F.col("source")).alias("pair_key"))


def quota_split_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quota_split(documents(spark, sf_dir), "lang", 30 + F.floor(F.col("n") / 2))


def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "lang", keys.stable_key(SEED, F.col("doc_id")).alias("key"))
    return selection.by_quota(rows, selection.quota_split(docs, "lang", 61), ["key", "doc_id"], "lang").select("doc_id", "lang")


def bucket_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", keys.rank16(keys.sha(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))).alias("key"))
    return selection.cutoffs(rows, "lang", "key", 50)


def dev_final_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return selection.split_two(orders, ["o_orderpriority"], [keys.stable_key(37001, F.col("o_orderkey")), "o_orderkey"], 50)


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    parts = [selection.smallest(orders, ["o_orderpriority"], [keys.stable_key(s, F.col("o_orderkey")), "o_orderkey"], 200).select("o_orderkey", F.lit(f"seed{s}").alias("name")) for s in (1, 2, 3)]
    return integrity.overlaps(parts[0].union(parts[1]).union(parts[2]), "name", "o_orderkey")


def per_task_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.smallest(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], 300).select("event_id", "event_type")


def greedy_bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("material"), F.sequence(F.lit(1), 1 + (F.col("p_size") % 5)).alias("feasible"))
    return selection.greedy_buckets(parts, "p_partkey", "feasible", "material", range(1, 6), "p_brand").select("p_partkey", "p_brand", "bucket")


def round_shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin_shards(documents(spark, sf_dir).select("doc_id"), ["doc_id"], 7).select("doc_id", "place", "shard")


def hashed_property_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", (2 + F.col("p_size") % 4).alias("n"))
    items = F.array(*map(F.lit, programs.PROPERTIES))
    return parts.select("p_partkey", F.array_join(selection.hashed_subset(items, F.col("p_partkey").cast("string"), F.col("n")), ",").alias("chosen"))


def edit_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("source"), F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("target"),
        F.when(F.col("p_size") % 11 == 0, "n/a").otherwise((F.col("p_size") / 50.0).cast("string")).alias("similarity"),
        F.when(F.col("p_size") % 5 == 0, "no").when(F.col("p_size") % 5 == 1, "").otherwise("TRUE").alias("flag"), F.when(F.col("p_size") % 13 != 0, F.array(F.lit("MW"))).otherwise(F.array().cast("array<string>")).alias("active"))
    ok = selection.eligible_pair(F.col("source"), F.col("target"), F.col("similarity"), [F.col("flag")], F.col("active"))
    return rows.select("p_partkey", ok.alias("eligible"))


def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_index(table(spark, sf_dir, "events"), "event_type")


def interleave_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.interleave(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "error"], ["event_id"])
    return out.select("event_id", F.col("turn").cast("long").alias("turn"), "turn_mode")


def proportional_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.proportional(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", [keys.stable_key(7, F.col("event_id")), "event_id"])
    return out.select("event_id", "event_type", F.col("pos").cast("long").alias("pos"), F.round("merge_key", 9).alias("merge_key"))


def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.batches(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"], 16)
    return out.select("event_id", "event_type", F.col("pos").cast("long").alias("pos"), "batch_round")


def round_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = schedule.rounds(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 40, 2525)
    return out.select("event_id", "event_type", F.col("round").cast("long").alias("round"), F.col("slot").cast("long").alias("slot"))


def balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("mode"), "event_type")
    out = schedule.balanced_pairs(rows, "mode", "event_type", "event_id", {"a": ["click", "view"], "b": ["error", "purchase", "signup"]}, 60, 37001)
    return out.select(F.col("pair").cast("long").alias("pair"), "left_event_id", "left_event_type", "right_event_id", "right_event_type")


_QUOTA = "SELECT lang AS bucket, CAST({total} // n + CASE WHEN i < {total} % n THEN 1 ELSE 0 END AS INTEGER) AS quota FROM (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents))"
_TOP = "SELECT event_id, event_type, mode, row_number() OVER (PARTITION BY event_type ORDER BY sha256(seed || ':' || event_id), event_id) AS r FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, {mode} AS mode, '{seed}' AS seed FROM events WHERE event_type IN ({types}))"

SQL = {
    "balanced_clean_selection": f"""
WITH c AS (SELECT doc_id, lang, substr(sha256(text), 1, 16) AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)
SELECT doc_id, lang, key FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id), doc_id) <= 30""",
    "first_seen_dedup": "SELECT doc_id, lang, substr(sha256(text), 1, 16) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id) = 1",
    "dup_audit_counts": "SELECT lang, outcome, count(*) AS n FROM (SELECT lang, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'kept' ELSE 'duplicate' END AS outcome FROM documents) GROUP BY ALL",
    "leakage_exact": "SELECT doc_id, lang, sha256(text) AS text_key FROM documents WHERE text NOT IN (SELECT text FROM benchmark)",
    "leakage_contains": "SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "hash_mod_buckets": "SELECT doc_id, CAST(2 + ('0x' || substr(sha256(text), 1, 16))::UBIGINT % 6 AS BIGINT) AS bucket, 'doc:' || substr(sha256(text), 1, 24) AS short_id, sha256(lang || chr(10) || source) AS pair_key FROM documents",
    "quota_split_dim": _QUOTA.format(total="(30 + n // 2)"),
    "quota_selection": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS r FROM documents) JOIN ({_QUOTA.format(total='61')}) ON lang = bucket WHERE r <= quota",
    "bucket_cutoffs": "SELECT lang, count(*) AS kept, max(key) AS cutoff FROM (SELECT lang, substr(sha256(doc_id || ':' || text), 1, 16) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY key) <= 50) GROUP BY lang",
    "dev_final_split": "SELECT o_orderkey, o_orderpriority, CASE WHEN r <= 50 THEN 'dev' ELSE 'final' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('37001:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 100",
    "split_overlaps": """
WITH s AS (SELECT o_orderkey, 'seed' || seed AS name FROM (SELECT o_orderkey, seed, row_number() OVER (PARTITION BY seed, o_orderpriority ORDER BY sha256(seed || ':' || o_orderkey), o_orderkey) AS r FROM orders, (SELECT unnest([1, 2, 3]) AS seed)) WHERE r <= 200)
SELECT a.name AS "left", b.name AS "right", count(*) AS n FROM s a JOIN s b ON a.o_orderkey = b.o_orderkey AND a.name < b.name GROUP BY ALL""",
    "per_task_cap": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 300",
    "round_shard_assign": "SELECT doc_id, place, CAST(place % 7 AS INTEGER) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)",
    "hashed_property_subset": "WITH p AS (SELECT p_partkey, 2 + p_size % 4 AS n, unnest([" + ", ".join(f"{{'p': '{p}', 'k': {k}}}" for k, p in enumerate(programs.PROPERTIES)) + """]) AS s FROM part),
r AS (SELECT p_partkey, n, s, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(p_partkey || ':' || s.p)) AS r FROM p)
SELECT p_partkey, string_agg(s.p, ',' ORDER BY s.k) AS chosen FROM r WHERE r <= n GROUP BY p_partkey""",
    "edit_eligibility": "SELECT p_partkey, NOT (p_size % 7 = 0 OR p_brand = p_name) AND p_size % 11 <> 0 AND p_size / 50.0 >= 0.15 AND p_size % 5 <> 0 AND p_size % 13 <> 0 AS eligible FROM part",
    "bucket_sizes": "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type",
    "interleave_modes": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS turn_mode FROM events WHERE event_type IN ('click', 'error')",
    "proportional_schedule": "SELECT event_id, event_type, pos, round((pos + 0.5::DOUBLE) / n, 9) AS merge_key FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('7:' || event_id), event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)",
    "round_robin_batches": "WITH n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM events GROUP BY event_type)), p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) SELECT event_id, event_type, pos, pos // 16 AS batch_round FROM p, n WHERE pos < least // 16 * 16",
    "round_schedule": """
WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('2525:' || event_id), event_id) - 1 AS round FROM events)
SELECT event_id, event_type, round, row_number() OVER (PARTITION BY round ORDER BY sha256((2525 + round) || ':' || event_type), event_type) - 1 AS slot FROM p WHERE round < 40""",
    "balanced_pairs": f"""
WITH a AS (SELECT event_id, event_type, row_number() OVER (ORDER BY sha256('37011:' || event_id)) - 1 AS pair FROM ({_TOP.format(mode="'a'", seed=37001, types="'click', 'view'")}) WHERE r <= 30),
b AS (SELECT event_id, event_type, row_number() OVER (ORDER BY sha256('37012:' || event_id)) - 1 AS pair FROM ({_TOP.format(mode="'b'", seed=37002, types="'error', 'purchase', 'signup'")}) WHERE r <= 20)
SELECT a.pair, a.event_id AS left_event_id, a.event_type AS left_event_type, b.event_id AS right_event_id, b.event_type AS right_event_type FROM a JOIN b ON a.pair = b.pair""",
}
QUERIES = {f.__name__: f for f in (
    balanced_clean_selection, first_seen_dedup, dup_audit_counts, leakage_exact, leakage_contains, hash_mod_buckets, quota_split_dim, quota_selection, bucket_cutoffs, dev_final_split, split_overlaps,
    per_task_cap, greedy_bucket_assign, round_shard_assign, hashed_property_subset, edit_eligibility, bucket_sizes, interleave_modes, proportional_schedule, round_robin_batches, round_schedule, balanced_pairs,
)}
