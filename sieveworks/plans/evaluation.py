"""Registered queries: rates, macro means, support, statistics, comparisons, audits and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, evaluation, integrity, resample
from ..operators.selection import global_place
from ..streaming import logs
from .selection import documents, table

# Groups of event types; a type may be in several.
GROUPS = (("all", "click"), ("all", "error"), ("all", "purchase"), ("all", "signup"), ("all", "view"), ("active", "click"), ("active", "purchase"), ("rest", "error"), ("rest", "view"))


def r9(c, name: str):
    return F.round(c, 9).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to nine places: sums differ in the last bits with the partitioning."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return docs.join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", how)


def bucket_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.bucket_metrics(labelled(spark, sf_dir), ["lang"], ["quality", "toxic"], ["n_chars"]))


def pooled_vs_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    by = evaluation.bucket_metrics(rows, ["source"], ["quality", "toxic"])
    buckets = table(spark, sf_dir, "documents").select("source").distinct()
    macro = evaluation.macro(by, buckets, ["quality_rate", "toxic_rate"], "source", "zero")
    return rounded(macro.join(evaluation.bucket_metrics(rows, [], ["quality", "toxic"])))  # one row each


def metric_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.bucket_and_total(labelled(spark, sf_dir), "lang", "source", ["quality", "toxic"]))


def null_skipping_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir, "left")
    out = rows.groupBy("lang").agg(F.count("*").alias("rows"), evaluation.mean_of(F.col("quality").cast("double")).alias("seen_mean"), evaluation.mean_of(F.coalesce(F.col("quality"), F.lit(0)).cast("double"), "zero").alias("all_mean"))
    return rounded(out)


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 100)
    return evaluation.bucket_metrics(events, ["event_type"], ["high"], ["value"])


def task_group_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame(list(GROUPS), "group string, event_type string")
    return rounded(evaluation.group_macro(event_rates(spark, sf_dir), groups, ["high_rate", "mean_value"], "event_type"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("task_key"), "event_id", (F.col("value") > 100).alias("strict"), F.col("value").alias("hard_reward"), F.floor(F.col("value") / 50).cast("double").alias("soft_reward"))


def group_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.group_support(candidates(spark, sf_dir), ["user_id", "task_key"])


def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.support_summary(group_support(spark, sf_dir)))


def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.support_gate(evaluation.support_summary(group_support(spark, sf_dir))))


def group_zscore_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.with_zscore(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "value", ["user_id", "event_type"], "z")
    return rows.select("event_id", r9(F.col("z"), "z"))


def decoupled_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") == "purchase").cast("double").alias("bought"))
    long = events.select("user_id", "event_id", F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k"), F.lit("bought"), F.col("bought"))).alias("channel", "x"))
    out = evaluation.advantages(long, "user_id", "event_id", {"value": 1.0, "k": 0.5, "bought": 0.25}, "channel", "x")
    return out.select("user_id", "event_id", F.round("advantage", 6).alias("advantage"), F.col("active_channels").cast("long").alias("active_channels"), "zero_signal")


def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.group_statistics(candidates(spark, sf_dir), ["user_id"], "hard_reward", ["strict"]))


def order_arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("bucket"))
    flag = lambda c: base.withColumn("hit", c)
    key = F.col("id").cast("long")
    return flag((key % 3 == 0).cast("double")), flag(((key % 3 == 0) | (key % 7 == 1)).cast("double"))


def paired_macro_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = order_arms(spark, sf_dir)
    pairs = compare.paired(left, right, ["id"], ["bucket", "hit"])
    return rounded(compare.macro_delta(pairs, "left_bucket", "left_hit", "right_hit"))


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = order_arms(spark, sf_dir)
    return compare.paired(left, right, ["id"], ["bucket", "hit"])


def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pairs = c.select(F.col("c_mktsegment").alias("bucket"), "c_custkey", ((F.col("c_acctbal") > 5000).cast("double") - (F.col("c_nationkey") < 12).cast("double")).alias("balance"), ((F.col("c_custkey") % 5 == 0).cast("double") - 0.1).alias("fifth"))
    return rounded(resample.bootstrap(pairs, "bucket", ["c_custkey"], ["balance", "fifth"], 2000))


def segment_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market segment: four differences that stand for mode deltas."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("arm")).agg(
        *((F.avg((F.col("c_nationkey") % m == 0).cast("double")) - 1.0 / m).alias(n) for n, m in (("a", 2), ("b", 3), ("c", 4), ("d", 5))), F.count("*").alias("n"))


def noninferiority_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_deltas(spark, sf_dir)
    return rows.select("arm", compare.transfer_decision([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("decision"))


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = {"edit_only": F.col("a"), "shared": F.col("b"), "de_novo": F.col("c"), "edit_valid": F.col("d"), "de_novo_valid": F.col("a"), "edit_all": F.col("b")}
    same = F.col("n") > 0
    gates = {
        "routing": compare.routing_gate(d, same), "transfer_aware": compare.transfer_aware_gate(d, same), "shared_transfer": compare.shared_transfer_gate(F.col("a"), F.col("b")),
        "residual": compare.residual_gate(d, same, F.lit(370), same, F.lit(250), F.lit(0.0)),
    }
    safe = compare.safe_promotion(*({"de_novo_strict": F.col("a"), "edit_strict": F.col("b"), "edit_relaxed": F.col("c"), "de_novo_valid": F.col("d"), "edit_valid": F.col("b")},) * 2)
    diag = compare.dense_diagnostic({"de_novo": F.col("a"), "edit_only": F.col("b")}, {"de_novo": F.col("c"), "edit_only": F.col("d"), "shared": F.col("a")})
    out = segment_deltas(spark, sf_dir).select("arm", *(g["decision"].alias(n) for n, g in gates.items()), safe["promote"].alias("promote"), diag["de_novo_recovers"].alias("recovers"), diag["shared_gain"].alias("shared_gain"), compare.headline_promotion(F.col("a") + 0.55, F.col("b") + 0.57, same, [same]).alias("headline"))
    return out


def checkpoint_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_deltas(spark, sf_dir).select(F.length("arm").alias("step"), "a", "b", (F.col("c") >= -0.01).alias("safe"))
    return rounded(compare.pick_checkpoint(rows, "step", "a", "b", ["safe"]))


def arm_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_quantity").alias("value"))
    return rounded(compare.arm_contrasts(rows, "arm", "metric", "value", [("A", "N"), ("R", "N"), ("A", "R")]))


def scale_sweep_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    return rounded(evaluation.scale_table(rows, "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"]))


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_linestatus").alias("metric")).agg(F.avg("l_discount").alias("value"))
    return rounded(evaluation.metric_deltas(side("A"), side("R")))


def identity_mismatch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("raw"))
    changed = orders.where(F.col("key") % 97 != 0).withColumn("raw", F.when(F.col("key") % 101 == 0, "?").otherwise(F.col("raw")))
    return compare.mismatches(orders, changed, "key", "raw")


def set_equality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return compare.identity_audit(a, b, "key")


def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 != 0).select(F.col("o_orderkey").alias("key"))
    b = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("key"))
    return integrity.set_difference(a, b, "key")


def candidate_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") <= 3, "de_novo").otherwise("edit").alias("mode"), F.col("l_orderkey").alias("id"))
    want = table(spark, sf_dir, "orders").select(F.lit("edit").alias("mode"), F.col("o_orderkey").alias("id"))
    return integrity.candidate_integrity(rows, want, ["mode", "id"], "mode")


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = global_place(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    docs = global_place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return turns.join(docs, "place").select("place", "conv_id", "turn", "doc_id")


def coverage_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.item_histogram(table(spark, sf_dir, "events").select(F.array("event_type", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))).alias("items")), "items")
    need = spark.createDataFrame([(x,) for x in ("click", "view", "k0", "k5", "k9", "none")], "item string")
    return integrity.coverage(found, need, 1000)


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.is_balanced(documents(spark, sf_dir).groupBy("source").count(), "count", 1000)


def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.content_manifest(documents(spark, sf_dir), ["source"], "doc_id", "text")


def nonfinite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.when(F.col("v") > 0.4, float("nan")).otherwise(F.col("v").cast("double")))
    return integrity.nonfinite_counts(rows, "label", "v")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return logs.remaining(events, events.where(F.col("event_id") % 4 != 0), "event_id")


def resume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), "event_type")
    return logs.verified_prefix(rows, rows.where("place < 250"), "place", ["event_type"])


def history_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v"))
    return rounded(evaluation.running_totals(daily, "day", ["n", "v"], ["event_type"]))


_L = "(SELECT d.doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, quality, toxic FROM documents d {how} JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"
_IN = _L.format(how="")
_RATES = "count(*) AS rows, round(avg(CAST(quality AS DOUBLE)), 9) AS quality_rate, round(avg(CAST(toxic AS DOUBLE)), 9) AS toxic_rate"
_G = """(SELECT user_id, event_type AS task_key, count(*) AS size, count(*) FILTER (value > 100) > 0 AS strict_any, count(*) FILTER (value > 100) > 0 AND count(*) FILTER (value > 100) < count(*) AS mixed,
max(value) - min(value) > 1e-12 AS hard_informative, max(floor(value / 50)) - min(floor(value / 50)) > 1e-12 AS soft_informative,
CASE WHEN count(*) FILTER (value > 100) > 0 THEN max(value) FILTER (value > 100) >= max(value) - 1e-12 END AS hard_top_strict,
CASE WHEN count(*) FILTER (value > 100) > 0 THEN max(floor(value / 50)) FILTER (value > 100) >= max(floor(value / 50)) - 1e-12 END AS soft_top_strict FROM events GROUP BY user_id, event_type)"""
_D = lambda c: f"avg(CAST({c} AS DOUBLE))"
_SUM = f"count(*) AS groups, min(size) AS size_min, max(size) AS size_max, {_D('strict_any')} AS strict_any_at_k, {_D('mixed')} AS mixed_rate, {_D('hard_informative')} AS hard_informative_rate, {_D('soft_informative')} AS soft_informative_rate, {_D('hard_top_strict')} AS hard_top_given_support, {_D('soft_top_strict')} AS soft_top_given_support"
_SUPPORT = f"(SELECT task_key, {_SUM} FROM {_G} GROUP BY ROLLUP (task_key))"
_R = lambda cols: ", ".join(f"round({c}, 9) AS {c}" for c in cols)
_SUPPORT_COLS = ("strict_any_at_k", "mixed_rate", "hard_informative_rate", "soft_informative_rate", "hard_top_given_support", "soft_top_given_support")
_Z = "CASE WHEN var_pop({x}) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE greatest(-3.0::DOUBLE, least(3.0::DOUBLE, ({x} - avg({x}) OVER w) / sqrt(var_pop({x}) OVER w))) END"
_SEG = "(SELECT c_mktsegment AS arm, " + ", ".join(f"avg(CAST(c_nationkey % {m} = 0 AS DOUBLE)) - 1.0::DOUBLE / {m} AS {n}" for n, m in (("a", 2), ("b", 3), ("c", 4), ("d", 5))) + ", count(*) AS n FROM customer GROUP BY c_mktsegment)"
_EPS = "1e-12::DOUBLE"
_ge = lambda c, b, s=True: f"{c} >= {b}::DOUBLE" + (f" - {_EPS}" if s else "")

#: The bootstrap's mix of a 32-bit number x0, as columns x1 to x3.
_MIX = "(xor(x0, x0 >> 16) * 2146121005) & 4294967295 AS x1, (xor(x1, x1 >> 15) * 2221713035) & 4294967295 AS x2, xor(x2, x2 >> 16) AS x3"
SQL = {
    "bucket_rates": f"SELECT lang, {_RATES}, round(avg(n_chars), 9) AS mean_n_chars FROM {_IN} GROUP BY lang",
    "pooled_vs_macro": f"""
WITH b AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS q, avg(CAST(toxic AS DOUBLE)) AS t FROM {_IN} GROUP BY source), s AS (SELECT DISTINCT source FROM documents)
SELECT round(m.q, 9) AS quality_rate_macro, round(m.t, 9) AS toxic_rate_macro, p.* FROM (SELECT avg(coalesce(q, 0)) AS q, avg(coalesce(t, 0)) AS t FROM s LEFT JOIN b USING (source)) m, (SELECT {_RATES} FROM {_IN}) p""",
    "metric_grouping_sets": f"SELECT lang, source, {_RATES} FROM {_IN} GROUP BY GROUPING SETS ((lang, source), (lang))",
    "null_skipping_means": f"SELECT lang, count(*) AS rows, round(avg(CAST(quality AS DOUBLE)), 9) AS seen_mean, round(avg(CAST(coalesce(quality, 0) AS DOUBLE)), 9) AS all_mean FROM {_L.format(how='LEFT')} GROUP BY lang",
    "task_group_macro": "WITH g(\"group\", event_type) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GROUPS) + "), e AS (SELECT event_type, avg(CAST(value > 100 AS DOUBLE)) AS h, avg(value) AS v FROM events GROUP BY event_type) SELECT \"group\", count(*) AS buckets, round(avg(h), 9) AS high_rate_macro, round(avg(v), 9) AS mean_value_macro FROM g JOIN e USING (event_type) GROUP BY \"group\"",
    "group_support": f"SELECT * FROM {_G}",
    "support_summary": f"SELECT task_key, groups, size_min, size_max, {_R(_SUPPORT_COLS)} FROM {_SUPPORT}",
    "support_gate": f"""
WITH s AS (SELECT * FROM {_SUPPORT}), t AS (SELECT * FROM s WHERE task_key IS NULL), n AS (SELECT count(*) AS task_count, count(*) FILTER (strict_any_at_k >= 0.05) AS supported_tasks FROM s WHERE task_key IS NOT NULL),
c AS (SELECT t.strict_any_at_k, mixed_rate, hard_informative_rate, hard_top_given_support, task_count, supported_tasks, t.strict_any_at_k >= 0.05 AS ok_any, mixed_rate >= 0.2 AS ok_mixed, hard_informative_rate >= 0.2 AS ok_informative,
coalesce(hard_top_given_support >= 0.7, false) AS ok_ranking, supported_tasks / greatest(task_count, 1) >= 0.7 AS ok_coverage, task_count >= 10 AS ok_tasks FROM t, n)
SELECT {_R(_SUPPORT_COLS[:3])}, round(hard_top_given_support, 9) AS hard_top_given_support, task_count, supported_tasks, ok_any, ok_mixed, ok_informative, ok_ranking, ok_coverage, ok_tasks,
CASE WHEN NOT ok_any OR NOT ok_informative THEN 'DO_NOT_RUN_ONLINE_RL_SUPPORT_TOO_LOW' WHEN NOT ok_ranking THEN 'REPAIR_REWARD_BEFORE_ONLINE_RL' WHEN NOT (ok_mixed AND ok_coverage AND ok_tasks) THEN 'BUILD_SUPPORT_BEFORE_ONLINE_RL' ELSE 'PROCEED_TO_SMALL_ONLINE_RL_PILOT' END AS decision FROM c""",
    "group_zscore_clip": f"SELECT event_id, round({_Z.format(x='value')}, 9) AS z FROM events WINDOW w AS (PARTITION BY user_id, event_type)",
    "decoupled_advantage": f"""
WITH l AS (SELECT user_id, event_id, unnest([{{'c': 'value', 'x': value, 'w': 1.0::DOUBLE}}, {{'c': 'k', 'x': CAST(json_extract(props, '$.k') AS DOUBLE), 'w': 0.5::DOUBLE}}, {{'c': 'bought', 'x': CAST(event_type = 'purchase' AS DOUBLE), 'w': 0.25::DOUBLE}}]) AS s FROM events),
z AS (SELECT user_id, event_id, s.c, s.w AS weight, {_Z.format(x='s.x')} AS z FROM l WINDOW w AS (PARTITION BY user_id, s.c)),
a AS (SELECT user_id, count(*) AS active_channels FROM (SELECT user_id, c FROM z GROUP BY user_id, c HAVING max(abs(z)) > 0) GROUP BY user_id),
s AS (SELECT user_id, event_id, sum(weight * z) AS x FROM z GROUP BY user_id, event_id), v AS (SELECT user_id, event_id, {_Z.format(x='x')} AS adv FROM s WINDOW w AS (PARTITION BY user_id))
SELECT v.user_id, event_id, round(adv, 6) AS advantage, coalesce(active_channels, 0) AS active_channels, max(abs(adv)) OVER (PARTITION BY v.user_id) = 0 AS zero_signal FROM v LEFT JOIN a USING (user_id)""",
    "group_statistics": "SELECT user_id, count(*) AS size, round(avg(value), 9) AS mean_reward, round(stddev_pop(value), 9) AS reward_std, round(avg(CAST(value > 100 AS DOUBLE)), 9) AS strict_fraction FROM events GROUP BY user_id",
    "paired_macro_delta": "SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS rows, round(avg(d), 9) AS delta FROM (SELECT o_orderpriority, count(*) AS n, avg(CAST(o_orderkey % 3 = 0 OR o_orderkey % 7 = 1 AS DOUBLE) - CAST(o_orderkey % 3 = 0 AS DOUBLE)) AS d FROM orders GROUP BY o_orderpriority)",
    "paired_arms": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS left_bucket, CAST(o_orderkey % 3 = 0 AS DOUBLE) AS left_hit, o_orderpriority AS right_bucket, CAST(o_orderkey % 3 = 0 OR o_orderkey % 7 = 1 AS DOUBLE) AS right_hit FROM orders",
    "paired_bootstrap_ci": f"""
WITH p AS (SELECT c_mktsegment AS bucket, CAST(c_acctbal > 5000 AS DOUBLE) - CAST(c_nationkey < 12 AS DOUBLE) AS balance, CAST(c_custkey % 5 = 0 AS DOUBLE) - 0.1::DOUBLE AS fifth,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n, ('0x' || substr(md5(c_mktsegment || ':0'), 1, 8))::UBIGINT AS h FROM customer),
r AS (SELECT r, x3 AS seeded FROM (SELECT range AS r, xor(37101::UBIGINT, range::UBIGINT) AS x0, {_MIX} FROM range(2000))),
b AS (SELECT r, bucket, n, x3 AS start FROM (SELECT r, bucket, n, xor(seeded, h) AS x0, {_MIX} FROM r, (SELECT DISTINCT bucket, n, h FROM p))),
d AS (SELECT bucket, r, (x3 % n)::BIGINT AS place FROM (SELECT b.bucket, b.r, b.n, xor(b.start, p.place::UBIGINT) AS x0, {_MIX} FROM b JOIN p ON p.bucket = b.bucket)),
m AS (SELECT r, bucket, avg(balance) AS balance, avg(fifth) AS fifth FROM d JOIN p USING (bucket, place) GROUP BY r, bucket), q AS (SELECT r, avg(balance) AS balance, avg(fifth) AS fifth FROM m GROUP BY r),
o AS (SELECT avg(balance) AS balance, avg(fifth) AS fifth FROM (SELECT avg(balance) AS balance, avg(fifth) AS fifth FROM p GROUP BY bucket))
SELECT 'balance' AS metric, round((SELECT balance FROM o), 9) AS delta, round(quantile_cont(balance, 0.025), 9) AS ci_low, round(quantile_cont(balance, 0.975), 9) AS ci_high FROM q
UNION ALL SELECT 'fifth', round((SELECT fifth FROM o), 9), round(quantile_cont(fifth, 0.025), 9), round(quantile_cont(fifth, 0.975), 9) FROM q""",
    "noninferiority_decision": f"SELECT arm, CASE WHEN least(a, b, c, d) >= -0.02 - {_EPS} AND greatest(a, b) >= 0.02 - {_EPS} THEN 'positive_transfer' WHEN least(a, b, c, d) >= -0.02 - {_EPS} THEN 'parameter_efficiency' WHEN least(a, b) < -0.02 THEN 'asymmetric_interference' ELSE 'inconclusive' END AS decision FROM {_SEG}",
    "gate_decisions": f"""
SELECT arm, CASE WHEN {_ge('a', 0.02)} AND {_ge('b', -0.02)} AND {_ge('c', -0.02)} AND {_ge('d', -0.02)} THEN 'supported' ELSE 'not_supported' END AS routing,
CASE WHEN {_ge('a', 0.02, False)} AND {_ge('b', 0.0, False)} AND {_ge('c', -0.02, False)} AND {_ge('d', -0.02, False)} THEN 'supported' ELSE 'not_supported' END AS transfer_aware,
CASE WHEN {_ge('a', 0.02)} AND {_ge('b', -0.02)} THEN 'positive_transfer' ELSE 'not_supported' END AS shared_transfer, CASE WHEN {_ge('a', 0.02)} AND {_ge('b', 0.0)} AND {_ge('d', -0.02)} THEN 'supported' ELSE 'not_supported' END AS residual,
a >= 0.02 AND least(b, c, d) >= -0.01 AS promote, a >= 0.02 AS recovers, a >= 0.02 AS shared_gain, a + 0.55::DOUBLE >= 0.5345 AND b + 0.57::DOUBLE >= 0.5694 AS headline FROM {_SEG}""",
    "checkpoint_argmax": f"SELECT CAST(length(arm) AS INTEGER) AS step, c >= -0.01 AS safe, round(a, 9) AS gain FROM {_SEG} ORDER BY CAST(c >= -0.01 AS INTEGER) DESC, a DESC, least(a, b) DESC, length(arm) LIMIT 1",
    "arm_contrasts": "WITH w AS (SELECT l_linestatus AS metric, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT metric, c.contrast AS contrast, round(c.delta, 9) AS delta FROM (SELECT metric, unnest([{'contrast': 'A_minus_N', 'delta': a - n}, {'contrast': 'R_minus_N', 'delta': r - n}, {'contrast': 'A_minus_R', 'delta': a - r}]) AS c FROM w)",
    "scale_sweep_pivot": "SELECT l_linenumber, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{x}'), 9) AS \"{x}\"" for x in "ANR") + " FROM lineitem GROUP BY l_linenumber",
    "metric_deltas": "SELECT metric, round(a, 9) AS left_value, round(r, 9) AS right_value, round(r - a, 9) AS delta FROM (SELECT l_linestatus AS metric, avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND r IS NOT NULL",
    "identity_mismatch_audit": "SELECT o_orderkey AS key, o_orderstatus AS left_value, CASE WHEN o_orderkey % 97 <> 0 THEN '?' END AS right_value FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0",
    "set_equality_audit": """
WITH a AS (SELECT o_orderkey AS key, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS key, count(*) AS b FROM lineitem GROUP BY 1),
s AS (SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(b), 0) AS BIGINT) AS right_rows, count(a) AS left_keys, count(b) AS right_keys, count(*) FILTER (a IS NULL) AS missing_left, count(*) FILTER (b IS NULL) AS missing_right FROM a FULL JOIN b USING (key))
SELECT *, missing_left = 0 AND missing_right = 0 AND left_rows = left_keys AND right_rows = right_keys AS matches FROM s""",
    "symmetric_difference": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 <> 0 THEN 'missing_right' ELSE 'missing_left' END AS side FROM orders WHERE (o_orderkey % 5 <> 0) <> (o_orderkey % 3 <> 0)",
    "candidate_integrity": """
WITH r AS (SELECT CASE WHEN l_linenumber <= 3 THEN 'de_novo' ELSE 'edit' END AS mode, l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT DISTINCT 'edit' AS mode, o_orderkey AS id, true AS w FROM orders),
s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(n) AS keys, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (w IS NULL) AS extra, CAST(coalesce(sum(n) FILTER (mode = 'de_novo'), 0) AS BIGINT) AS de_novo_rows, CAST(coalesce(sum(n) FILTER (mode = 'edit'), 0) AS BIGINT) AS edit_rows FROM r FULL JOIN w USING (mode, id))
SELECT *, rows = keys AND missing = 0 AND extra = 0 AS intact FROM s""",
    "positional_join": "SELECT place, conv_id, turn, doc_id FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) USING (place)",
    "coverage_minimum": "WITH f AS (SELECT item, count(*) AS n FROM (SELECT unnest([event_type, 'k' || CAST(json_extract(props, '$.k') AS INTEGER) % 10]) AS item FROM events) GROUP BY item) SELECT item, coalesce(n, 0) AS n, coalesce(n, 0) >= 1000 AS enough FROM (SELECT unnest(['click', 'view', 'k0', 'k5', 'k9', 'none']) AS item) LEFT JOIN f USING (item)",
    "balance_check": "SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS rows, min(n) AS least, max(n) AS most, min(n) = max(n) AND sum(n) = 1000 AS balanced FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
    "content_manifest": "SELECT source, count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(doc_id || ':' || text), 1, 15))::UBIGINT AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY source",
    "nonfinite_counts": "SELECT label, count(*) AS n, count(*) FILTER (v > 0.4) AS nonfinite FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label",
    "resume_antijoin": "SELECT event_id, event_type FROM events WHERE event_id % 4 = 0",
    "resume_prefix": "SELECT count(*) AS done, max(event_id) = count(*) - 1 AS is_prefix FROM events WHERE event_id < 250",
    "history_running_totals": "WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY ALL) SELECT event_type, day, n, v, CAST(sum(n) OVER w AS BIGINT) AS n_total, round(sum(v) OVER w, 9) AS v_total FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)",
}
QUERIES = {f.__name__: f for f in (
    bucket_rates, pooled_vs_macro, metric_grouping_sets, null_skipping_means, task_group_macro, group_support, support_summary, support_gate, group_zscore_clip, decoupled_advantage, group_statistics, paired_macro_delta, paired_arms,
    paired_bootstrap_ci, noninferiority_decision, gate_decisions, checkpoint_argmax, arm_contrasts, scale_sweep_pivot, metric_deltas, identity_mismatch_audit, set_equality_audit, symmetric_difference, candidate_integrity, positional_join,
    coverage_minimum, balance_check, content_manifest, nonfinite_counts, resume_antijoin, resume_prefix, history_running_totals,
)}
