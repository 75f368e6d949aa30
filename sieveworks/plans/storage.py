"""Registered queries: readers, writers, step logs and streams over the tables, and their SQL.

Each writes rows of the tables to a new folder of the shared folder, by the
writer in question, and reads them again by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..sources import indexed, tables
from ..streaming import keyed, logs, steps
from .selection import documents, table

#: Pieces in which a stream's rows arrive, each a new start from the checkpoint.
PIECES = 3
ORDER_ROW = "o_orderkey long, o_orderpriority string, o_totalprice double"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def _streamed(rows: DataFrame, piece: Column, run, name: str) -> str:
    """Adds the rows piece by piece to a folder and runs the stream of it after each; returns the folder used."""
    folder = tables.new_folder(rows.sparkSession, name)
    for k in range(PIECES):
        rows.where(piece == k).write.mode("append").parquet(f"{folder}/in")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)
    return folder


def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth place of the shards that ``orders`` are dealt to, odd ones counted from the end."""
    path = tables.new_folder(spark, "indexed")
    indexed.write_indexed(_orders(spark, sf_dir), path, 7, ["o_orderkey"])
    n = sum(s.rows for s in indexed.manifest(path))
    place = F.col("id")
    wanted = spark.range(0, n, 5).select(F.when(place % 2 == 1, place - n).otherwise(place).alias("place"))
    return indexed.fetch(wanted, path, ORDER_ROW)


def indexed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of shards that were written in two commits, with the two ends of the table by their places."""
    path = tables.new_folder(spark, "indexed")
    rows = _orders(spark, sf_dir)
    for odd in (0, 1):
        indexed.write_indexed(rows.where(F.col("o_orderkey") % 2 == odd), path, 4, ["o_orderkey"])
    ends = indexed.read_indexed(spark, path, ORDER_ROW, [0, -1]).select("place", F.lit(True).alias("is_end"))
    return indexed.read_indexed(spark, path, ORDER_ROW).join(F.broadcast(ends), "place", "left").select("place", "o_orderkey", F.coalesce("is_end", F.lit(False)).alias("is_end"))


def stream_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 events of each type, kept as keyed state while the events stream in."""
    keyed.with_rocksdb(spark)
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("change", T.IntegerType())])

    def run(stream: DataFrame, folder: str) -> None:
        log = steps.StepLog(spark, f"{folder}/log", schema)
        keyed.run_available(keyed.top_k_changes(stream, "event_type", ["ts", "event_id"], 300), log.sink(), f"{folder}/ck")

    folder = _streamed(rows, F.pmod(F.col("event_id"), F.lit(PIECES)), run, "top-k")
    return keyed.current(steps.StepLog(spark, f"{folder}/log", schema).read()).select("event_id", "event_type")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen texts while the documents stream in by id; the state forgets within a millisecond, the store knows."""
    keyed.with_rocksdb(spark)
    docs = documents(spark, sf_dir)
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    rows = docs.select("doc_id", "lang", keys.rank16(keys.sha(F.col("text"))).alias("key"))

    def run(stream: DataFrame, folder: str) -> None:
        first = keyed.FirstSeen(spark, f"{folder}/store", rows.schema, "key")
        keyed.run_available(keyed.not_seen_lately(stream, "key", ["doc_id"], 1), first.sink(), f"{folder}/ck")

    folder = _streamed(rows, F.least(F.floor(F.col("doc_id") * PIECES / (last + 1)), F.lit(PIECES - 1)).cast("int"), run, "first-seen")
    return keyed.FirstSeen(spark, f"{folder}/store", rows.schema, "key").rows()


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of an append log of events, after the last piece."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("long").alias("whole"))
    schema = "event_type string, rows long, whole_total long"

    def run(stream: DataFrame, folder: str) -> None:
        log = steps.StepLog(spark, f"{folder}/log", schema)
        keyed.run_available(logs.totals_stream(stream, ["event_type"], ["whole"]), log.sink(), f"{folder}/ck")

    folder = _streamed(rows, F.pmod(F.col("event_id"), F.lit(PIECES)), run, "totals")
    updates = steps.StepLog(spark, f"{folder}/log", schema).read()
    return updates.groupBy("event_type").agg(F.max_by(F.struct("rows", "whole_total"), "rows").alias("r")).select("event_type", "r.*")


def step_log_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in four steps, one of them written twice and one left half: the whole steps, their rows, and where to resume."""
    path = tables.new_folder(spark, "steps")
    rows = _orders(spark, sf_dir)
    log = steps.StepLog(spark, path, ORDER_ROW)
    step = lambda k: rows.where(F.pmod(F.col("o_orderkey"), F.lit(4)) == k)
    for k in (0, 1, 2, 1):
        log.append(step(k), k, {"dear": F.count(F.when(F.col("o_totalprice") > 100_000, 1))}, state={"next": k + 1})
    step(3).write.parquet(f"{path}/data/{steps.ATTEMPT}=000000000003-half")
    found = spark.createDataFrame([(r["step"], r["metrics"]["rows"], r["metrics"]["dear"], r["state"]["next"], r == log.newest()) for r in log.steps()], "step long, listed long, dear long, next long, resume boolean")
    read = log.read().groupBy(F.pmod(F.col("o_orderkey"), F.lit(4)).alias("step")).agg(F.count("*").alias("rows"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return found.join(read, "step", "left")


def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and routability of documents by language, taken while they are written; a table with unroutable rows is refused."""
    path = tables.new_folder(spark, "preflight")
    docs = documents(spark, sf_dir)
    metrics = steps.routability("lang", ["de", "en", "es", "fr"])
    found = steps.checked_write(docs, path, metrics, {"some rows": lambda m: m["rows"] > 0, "all routable": lambda m: m["unroutable"] == 0})
    try:
        steps.checked_write(docs, f"{path}-narrow", steps.routability("lang", ["de", "en"]), {"all routable": lambda m: m["unroutable"] == 0})
        refused = None
    except steps.Refused as e:
        refused = e.metrics["unroutable"]
    rows = [(name, int(n)) for name, n in found.items()] + [("refused", refused), ("written", spark.read.parquet(path).count())]
    return spark.createDataFrame(rows, "metric string, n long")


def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines and back, with their places in the files."""
    path = tables.new_folder(spark, "lines")
    tables.write_json_lines(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = tables.read_json_lines(spark, path, "conv_id long, turn long, role string, text string", allow_empty=False)
    placed = tables.read_json_objects(spark, path, "conv_id long, turn long")
    n = placed.agg(F.count("*").alias("places"), (F.max("place") - F.min("place") + 1).alias("span"))
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5")).join(n)  # one row


def csv_union_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as one CSV of all columns and back, every value as text."""
    path = tables.new_folder(spark, "csv")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.col("n_name"), F.lit(' "x", ,')).alias("name"))
    tables.write_csv([suppliers, nations], path)
    return tables.read_csv(spark, path).select("key", "name", "nation")


def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers dealt to three shards of JSON lines: rows of each shard, and whether its digest is that of its lines."""
    path = tables.new_folder(spark, "shards")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), "s_name", (F.col("s_suppkey") % 3).cast("int").alias("shard"))
    digests = tables.write_shards(rows, path).withColumn("shard", F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int"))
    # files are named by their tasks: one file a shard holds its lines in the order that the text reader gives
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    own = lines.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard"), F.sha2("value", 256).alias("own"), F.regexp_count("value", F.lit("\n")).cast("long").alias("rows"))
    return digests.join(own, "shard").groupBy("shard").agg(F.sum("rows").alias("rows"), F.bool_or(F.col("sha256") == F.col("own")).alias("same"))


_DEALT = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders"
SQL = {
    "indexed_lookup": f"""
WITH p AS (SELECT row_number() OVER (ORDER BY k % 7, k) - 1 AS place, o_orderkey::BIGINT AS o_orderkey, o_orderpriority, o_totalprice::DOUBLE AS o_totalprice FROM ({_DEALT}))
SELECT * FROM p WHERE place % 5 = 0""",
    "indexed_scan": """
WITH k AS (SELECT o_orderkey, o_orderkey % 2 AS odd, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS k FROM orders),
p AS (SELECT row_number() OVER (ORDER BY odd, k % 4, k) - 1 AS place, o_orderkey::BIGINT AS o_orderkey FROM k)
SELECT place, o_orderkey, place IN (0, (SELECT max(place) FROM p)) AS is_end FROM p""",
    "stream_top_k": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 300",
    "stream_first_seen": "SELECT doc_id, lang, substr(sha256(text), 1, 16) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id) = 1",
    "stream_totals": "SELECT event_type, count(*) AS rows, sum(floor(value))::BIGINT AS whole_total FROM events GROUP BY event_type",
    "step_log_resume": """
SELECT (o_orderkey % 4)::BIGINT AS step, count(*) AS listed, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, (o_orderkey % 4 + 1)::BIGINT AS next, o_orderkey % 4 = 2 AS resume, count(*) AS rows,
       sum(round(o_totalprice::DOUBLE * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_orderkey % 4 < 3 GROUP BY o_orderkey % 4""",
    "preflight_counts": """
SELECT 'rows' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'written', count(*) FROM documents UNION ALL SELECT 'unroutable', count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) FROM documents
UNION ALL SELECT 'refused', count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('de', 'en')) FROM documents
UNION ALL SELECT 'rows_' || l, count(*) FILTER (WHERE lang = l) FROM documents, (SELECT unnest(['de', 'en', 'es', 'fr']) AS l) GROUP BY l""",
    "json_lines_round_trip": "SELECT conv_id, turn, role, md5(text) AS text_md5, count(*) OVER () AS places, count(*) OVER () AS span FROM conversations",
    "csv_union_round_trip": """
SELECT s_suppkey::VARCHAR AS key, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier UNION ALL SELECT n_nationkey::VARCHAR, n_name || ' "x", ,', NULL FROM nation""",
    "shard_digests": "SELECT (s_suppkey % 3)::INTEGER AS shard, count(*) AS rows, true AS same FROM supplier GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (
    indexed_lookup, indexed_scan, stream_top_k, stream_first_seen, stream_totals, step_log_resume, preflight_counts, json_lines_round_trip, csv_union_round_trip, shard_digests,
)}
