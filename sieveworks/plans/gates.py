"""Registered queries: gates whose counts, baselines and layouts come from the tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import compare, integrity
from ..sources import tables
from ..streaming.steps import Files
from .evaluation import rounded
from .selection import table

METRICS = ("de_novo_strict", "edit_strict", "edit_relaxed", "de_novo_valid", "edit_valid")
KEPT = METRICS[1:]
TASKS = ("click", "error", "purchase", "signup", "view")


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("raw"), F.col("o_orderpriority").alias("task"))
    other = orders.where((F.col("key") % 997 != 0) | (F.col("task") < "3")).withColumn("raw", F.when((F.col("key") % 1009 == 0) & (F.col("task") >= "3"), "?").otherwise(F.col("raw")))
    return orders, other


def residual_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both arms where the residual is active (tasks below 3) and where it is not, and the gate with counts from the rows."""
    left, right = _arms(spark, sf_dir)
    found = compare.subset_identity(left, right, "key", "raw", F.col("task") < "3")
    expected = left.groupBy(F.when(F.col("task") < "3", "active").otherwise("inactive").alias("subset")).agg(F.count("*").alias("expected"))
    wide = found.join(expected, "subset").agg(*(F.max(F.when(F.col("subset") == s, F.col(c))).alias(f"{s}_{c}") for s in ("active", "inactive") for c in ("checked", "identical", "expected")))  # one row
    zero = F.lit(0.05)
    gate = compare.residual_gate(
        {"edit_only": zero, "edit_all": zero, "edit_valid": zero}, F.col("inactive_identical"), F.col("inactive_checked"), F.col("active_identical"), F.col("active_checked"), F.lit(0.0),
        (F.col("inactive_expected"), F.col("active_expected")))
    decision = wide.select(gate.alias("g")).select(F.col("g.decision").alias("decision"), F.col("g.active_complete").alias("complete"))
    return found.select("subset", "checked", "mismatches", "identical", F.array_join(F.transform("first_mismatches", lambda k: k.cast("string")), ",").alias("first")).join(decision)  # two rows and one


def wanted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as gates, those that candidates (nations below 12) ask for, in order of output."""
    gate = [table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("key"), F.lit("c").alias("gate")),
            table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("key"), F.lit("s").alias("gate"))]
    candidates = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("id"))
    return compare.wanted(gate, candidates.union(candidates), "id").orderBy("gate", "key")


def united_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that documents, labels or pages have, and in how many of the tables each is."""
    frames = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))]
    ids = compare.united_ids(frames, "id")
    for k, f in enumerate(frames):
        ids = ids.join(f.distinct().withColumn(f"_{k}", F.lit(1)), "id", "left")
    return ids.select("id", sum((F.coalesce(f"_{k}", F.lit(0)) for k in range(len(frames))), F.lit(0)).alias("tables"))


def _rates(rows: DataFrame, *by: str) -> DataFrame:
    tests = ("l_discount > 0.05", "l_tax > 0.04", "l_tax > 0.02", "l_quantity > 10", "l_returnflag = 'N'")
    return rows.groupBy(*by).agg(*(F.avg(F.expr(t).cast("int").cast("double")).alias(m) for m, t in zip(METRICS, tests)))


def checkpoint_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checkpoints (line numbers) against the rates of all rows: deltas, safety flags, and the one that is picked."""
    rows = table(spark, sf_dir, "lineitem")
    deltas = compare.checkpoint_deltas(_rates(rows, "l_linenumber"), _rates(rows), "l_linenumber", METRICS, KEPT)
    picked = compare.pick_checkpoint(deltas, "l_linenumber", "de_novo_strict_delta", "edit_strict_delta", ["safe"]).select(F.col("l_linenumber").alias("picked"))
    return rounded(deltas.join(picked)).withColumn("is_picked", F.col("l_linenumber") == F.col("picked")).drop("picked")  # one row


def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an external result: all tasks and "all" once, one candidate for each input, all evaluable."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") > 1).cast("double").alias("good"))
    each = [F.count_distinct("event_id").alias("groups"), F.count("good").alias("candidates"), F.avg("good").alias("evaluable")]
    by_task = events.groupBy("user_id", F.col("event_type").alias("task")).agg(*each)
    whole = events.groupBy("user_id").agg(F.lit("all").alias("task"), *each)
    return integrity.external_results_ok(by_task.unionByName(whole), "user_id", "task", TASKS, "groups", "candidates", "evaluable")


def rank_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three ranks made from parts, and whether a layout of rank 40 may hold them."""
    lists = F.array(F.col("p_size") - 2, F.col("p_partkey") % 45, F.col("p_partkey") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", vectors.rank_list_ok(lists, 40).alias("ok"))


def layout_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout with two ranks for each event type, written as a document, loaded, checked, and laid out as rows."""
    types = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(1000).collect()]
    layout = {"rank": 1 + 2 * len(types), "common_ranks": [0], "property_ranks": {t: [1 + 2 * k, 2 + 2 * k] for k, t in enumerate(types)}}
    path = f"{tables.new_folder(spark, 'layout')}.json"
    Files(spark, path).write(path, json.dumps(layout))
    return vectors.layout_rows(spark, vectors.load_layout(spark, path))


def node_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label's embeddings."""
    probes = vectors.node_signatures(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return probes.select("node", F.posexplode("signature").alias("pos", "x")).select("node", "pos", F.round("x", 6).alias("x"))


_ARMS = """
a AS (SELECT o_orderkey AS key, o_orderpriority AS task, o_orderkey % 997 = 0 AND o_orderpriority >= '3' OR o_orderkey % 1009 = 0 AND o_orderpriority >= '3' AS bad FROM orders),
s AS (SELECT *, CASE WHEN task < '3' THEN 'active' ELSE 'inactive' END AS subset FROM a)"""
_RATES = ", ".join(f"avg(({t})::INTEGER::DOUBLE) AS {m}" for m, t in zip(METRICS, ("l_discount > 0.05", "l_tax > 0.04", "l_tax > 0.02", "l_quantity > 10", "l_returnflag = 'N'")))
SQL = {
    "residual_identity": f"""
WITH {_ARMS}
SELECT subset, count(*) AS checked, count(*) FILTER (WHERE bad) AS mismatches, count(*) FILTER (WHERE bad) = 0 AS identical,
       coalesce(array_to_string(list_slice(list_sort(list(key) FILTER (WHERE bad)), 1, 10), ','), '') AS first,
       CASE WHEN (SELECT count(*) FROM s WHERE bad) = 0 THEN 'supported' ELSE 'not_supported' END AS decision, true AS complete FROM s GROUP BY subset""",
    "wanted_gate": "SELECT c_nationkey AS id, c_custkey AS key, 'c' AS gate FROM customer WHERE c_nationkey < 12 UNION ALL SELECT s_nationkey, s_suppkey, 's' FROM supplier WHERE s_nationkey < 12",
    "united_ids": """
WITH i AS (SELECT DISTINCT doc_id AS id FROM documents UNION ALL SELECT DISTINCT doc_id FROM labels UNION ALL SELECT DISTINCT page_id FROM pages)
SELECT id, count(*)::INTEGER AS tables FROM i WHERE id IS NOT NULL GROUP BY id""",
    "checkpoint_deltas": f"""
WITH r AS (SELECT l_linenumber, {_RATES} FROM lineitem GROUP BY l_linenumber), b AS (SELECT {_RATES} FROM lineitem),
d AS (SELECT l_linenumber, {', '.join(f'r.{m} - b.{m} AS {m}_delta' for m in METRICS)} FROM r, b),
f AS (SELECT *, {', '.join(f'{m}_delta >= -0.01::DOUBLE AS {m}_safe' for m in KEPT)}, {' AND '.join(f'{m}_delta >= -0.01::DOUBLE' for m in KEPT)} AS safe FROM d)
SELECT l_linenumber, {', '.join(f'round({m}_delta, 9) AS {m}_delta' for m in METRICS)}, {', '.join(f'{m}_safe' for m in KEPT)}, safe,
       row_number() OVER (ORDER BY safe DESC, f.de_novo_strict_delta DESC, least(f.de_novo_strict_delta, f.edit_strict_delta) DESC, l_linenumber) = 1 AS is_picked FROM f""",
    "external_results": """
WITH t AS (SELECT user_id, event_type AS task, count(DISTINCT event_id) AS g, count(value) AS c, avg((value > 1)::INTEGER) AS e FROM events GROUP BY ALL
           UNION ALL SELECT user_id, 'all', count(DISTINCT event_id), count(value), avg((value > 1)::INTEGER) FROM events GROUP BY ALL),
r AS (SELECT user_id, list_sort(list(task)) = ['all', 'click', 'error', 'purchase', 'signup', 'view'] AS tasks_ok, bool_and(g = c) AS one_each, bool_and(e = 1) AS evaluable FROM t GROUP BY user_id)
SELECT *, tasks_ok AND one_each AND evaluable AS ok FROM r""",
    "rank_lists": """
WITH l AS (SELECT p_partkey, [p_size - 2, p_partkey % 45, p_partkey % 7] AS l FROM part)
SELECT p_partkey, len(list_distinct(l)) = 3 AND len(list_filter(l, lambda x: x < 0 OR x >= 40)) = 0 AS ok FROM l""",
    "layout_file": """
WITH t AS (SELECT event_type AS node, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events))
SELECT '' AS node, 0 AS rank_index, 1.0::DOUBLE AS weight UNION ALL SELECT node, (2 * k - 1)::INTEGER, 1.0 FROM t UNION ALL SELECT node, (2 * k)::INTEGER, 1.0 FROM t""",
    "node_probes": """
SELECT label::VARCHAR AS node, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings) WHERE label IS NOT NULL GROUP BY ALL""",
}
QUERIES = {f.__name__: f for f in (residual_identity, wanted_gate, united_ids, checkpoint_deltas, external_results, rank_lists, layout_file, node_probes)}
