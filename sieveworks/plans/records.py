"""Registered queries: dataset records, bucket labels, subset filters, audits and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import programs, records, scoring, vectors
from ..operators import evaluation, integrity, selection
from . import programs as scored_plans
from .evaluation import rounded
from .selection import spread, table

SEED, SYSTEM = 1701, "design"
_TASK_PICK = (*programs.REGISTERED_TASKS, "LogP:increase+HBA:decrease", "")


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a mode, a number of properties and a task."""
    pick = F.element_at(F.array(*map(F.lit, _TASK_PICK)), (F.col("p_partkey") % len(_TASK_PICK) + 1).cast("int"))
    mode = F.when(F.col("p_size") % 3 == 0, "de_novo").when(F.col("p_size") % 3 == 1, "edit").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", mode.alias("mode"), (F.col("p_partkey") % 10).cast("int").alias("size"), pick.alias("task"))


def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("mode"), F.col("size"), F.col("task"))
    return labelled_parts(spark, sf_dir).select(
        "p_partkey", records.bucket(*c).alias("balanced"), records.bucket(*c, sizes=records.TARGET_SIZES).alias("target"), records.bucket(*c, missing=None).alias("by_task"),
        records.bucket(*c, by="property_count", missing=None).alias("by_count"))


def bucket_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every expected bucket, and whether they are enough."""
    rows = labelled_parts(spark, sf_dir).select(records.bucket(F.col("mode"), F.col("size"), F.col("task")).alias("bucket"))
    names = spark.createDataFrame([(b,) for b in records.bucket_names()], "bucket string")
    out = names.join(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("enough", F.col("n") >= 5)


def _properties() -> Column:
    """Some properties of a part: those whose place divides or whose bit is set in its size."""
    return F.filter(F.array(*map(F.lit, programs.PROPERTIES)), lambda p: F.getbit(F.col("p_partkey").cast("long"), programs.place_of(p) % 6) == 1)


def subset_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_parts(spark, sf_dir).withColumn("properties", F.slice(_properties(), 1, 3))
    size = F.size("properties")
    return rows.select("p_partkey", records.shared_only(F.col("properties"), size, F.col("mode")).alias("replayed"), records.is_edit_only(F.col("properties"), F.col("mode")).alias("edit_only"), F.col("task").isin(*records.edit_only_tasks()).alias("edit_only_task"))


def _values() -> Column:
    number = lambda k: F.round(F.col("p_retailprice") / (k + 3), 6)
    return F.create_map(*(x for k, p in enumerate(records.DESCRIPTORS) for x in (F.lit(p), number(k))))


def construction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank, target = F.sha2(F.col("p_partkey").cast("string"), 256), F.translate("p_name", " ", "_")
    parts = spread(table(spark, sf_dir, "part")).withColumn("program", records.construction_program(rank, _values(), SEED, selection.hashed_subset))
    columns = records.construction_record(target, rank, _values(), F.sha2(target, 256), F.col("p_partkey").cast("string"), SEED, SYSTEM, selection.hashed_subset, program=F.col("program"))
    rows = parts.select("p_partkey", *columns)
    return rows.select("p_partkey", "dataset", "release_version", "example_id", "task_mode", "source_smiles", "target_smiles", "source_hash", "target_hash", "condition_hash", "task_key", "property_count", F.col("messages")[1]["content"].alias("request"), F.col("messages")[2]["content"].alias("answer"), F.col("provenance.program_view").alias("program_view"), "selection_rank")


def edit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part")).where("p_size % 7 <> 0")
    active = F.filter(F.array(*map(F.lit, records.DESCRIPTORS)), lambda p: (programs.place_of(p) + F.col("p_size")) % 3 != 0)
    ways = F.create_map(*(x for k, p in enumerate(records.DESCRIPTORS) for x in (F.lit(p), F.when((F.col("p_size") + k) % 2 == 0, "Up").otherwise("lower"))))
    ids = F.col("p_partkey").cast("string"), F.translate("p_brand", "#", "_"), F.translate("p_name", " ", "_")
    # computed once for the columns that need them
    parts = parts.withColumn("active", active).withColumn("program", records.edit_program(*ids, F.col("active"), ways, SEED, selection.hashed_subset))
    columns = records.edit_record(*ids, F.col("active"), ways, F.col("p_size") / 50, F.col("p_type"), F.lit(""), SEED, SYSTEM, selection.hashed_subset, program=F.col("program"))
    rows = parts.select("p_partkey", *columns)
    return rows.select("p_partkey", "example_id", "task_mode", "source_hash", "target_hash", "pair_hash", F.round("source_tanimoto", 9).alias("source_tanimoto"), "condition_hash", "task_key", "property_count", F.col("messages")[1]["content"].alias("request"), F.array_join("provenance.verified_descriptor_properties", ",").alias("active"), "selection_rank")


def scorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, way = F.element_at(F.array(*map(F.lit, programs.PROPERTIES)), (F.col("p_size") % 5 + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "increase").otherwise("decrease")
    program = F.array(programs.condition(first, way), programs.condition(F.lit("RB"), None, F.col("p_size") / 4), programs.condition(F.lit("unknown"), way))
    rows = table(spark, sf_dir, "part").select("p_partkey", records.scorer_row(F.when(F.col("p_size") % 3 == 0, programs.EMPTY_SOURCE).otherwise(F.col("p_brand")), F.lit("edit"), program).alias("m"))
    return rows.select("p_partkey", F.explode("m").alias("field", "content"))


def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_plans.scored(spark, sf_dir)
    sim, strict = F.when(F.col("mode") == "edit", F.col("similarity")), F.col("all_met") & ((F.col("mode") != "edit") | (F.col("similarity") >= scoring.STRICT))
    c = [F.col(x) for x in ("valid", "canonical", "fraction", "satisfaction", "bottleneck", "all_met")]
    soft, hard = scoring.soft_reward(*c, F.col("mode"), sim, F.col("copy") & (F.col("mode") == "edit")), scoring.hard_reward(*c, strict, sim, F.col("copy"))
    return rounded(rows.select("p_partkey", soft.alias("soft_reward"), hard.alias("hard_reward"), records.reward(F.col("mode"), soft, hard).alias("reward"), records.reward(F.col("mode"), soft, hard, "soft").alias("reward_soft"), records.source_feasible(F.col("valid"), F.col("copy"), sim).alias("source_feasible"), "valid", "copy"))


def program_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = F.to_json(F.array(F.struct(F.lit("Mol Wt").alias("property"), F.when(F.col("p_size") % 2 == 0, "up").otherwise("lower").alias("direction"))))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", F.when(F.col("p_size") % 3 == 0, "edit").otherwise("de_novo").alias("mode"), tasks.alias("tasks"), F.lit("1").alias("QED_active"), (F.col("p_size") / 8).cast("string").alias("target_QED"))
    program = records.program_of(F.col("mode"), programs.from_instructions(F.col("tasks"), F.lit(None).cast("string"), F.lit(None).cast("string")), programs.from_controls(set(rows.columns)))
    return rows.select("p_partkey", "mode", programs.task_label(program).alias("label"))


def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped training rows of each task in input order, four fields each."""
    rows = table(spark, sf_dir, "events").where("user_id % 10 <> 0")
    kept = selection.smallest(rows, ["event_type"], ["event_id"], 250)
    return kept.select(F.col("event_type").alias("task"), F.col("event_id").cast("string").alias("source_smiles"), F.col("user_id").cast("string").alias("target_smiles"), F.pmod("user_id", F.lit(7)).cast("int").alias("instr_idx"))


def available_and_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each task there are, and how many a cap selects."""
    rows = table(spark, sf_dir, "events")
    n = selection.outcome_counts(rows, F.when(F.col("user_id") % 10 == 0, "other_split").otherwise("available"), ["event_type"])
    have = F.coalesce(F.sum(F.when(F.col("outcome") == "available", F.col("n"))), F.lit(0))
    return n.groupBy("event_type").agg(F.sum("n").alias("rows"), have.alias("available"), F.least(have, F.lit(250)).cast("long").alias("selected"))


def active_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = vectors.route_vectors(scored_plans._requests(spark, sf_dir), scored_plans.BINARY)
    return routes.select(F.size(F.filter("route", lambda x: x != 0)).alias("active_ranks")).groupBy("active_ranks").agg(F.count("*").alias("n"))


def folded_count_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a document's words folded into 2048 slots."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return vectors.folded_counts(words, ["doc_id"], "word", 2048)


def external_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("groups"), F.count("user_id").alias("candidates"), F.lit(1.0).alias("evaluable"))
    whole = by.agg(F.lit("all").alias("task"), F.sum("groups").alias("groups"), F.sum("candidates").alias("candidates"), F.lit(1.0).alias("evaluable"))
    return integrity.external_result_ok(by.unionByName(whole), "task", ["click", "error", "purchase", "signup", "view"], "groups", "candidates", "evaluable")


def frozen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.sha2(F.concat(F.lit("37001:"), F.col("o_orderkey").cast("string")), 256).alias("key"), F.col("o_orderkey").cast("string").alias("content"))
    sizes = {f"{k}-{n}": 20 + k for k, n in enumerate(("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), 1)}
    return integrity.freeze(rows, "o_orderpriority", sizes, "key", "content")[0].select("o_orderpriority", "content")


def gate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by text, then the hash-ranked first of each language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"), F.sha2(F.concat(F.lit("37002:"), F.col("doc_id").cast("string")), 256).alias("r"))
    return selection.balanced_gate(rows, F.col("key"), ["lang"], ["r"], 25).select("doc_id", "lang")


def parameter_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("joint"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("a"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("b"))
    return rounded(n.select("l_linenumber", integrity.parameter_ratio(F.col("joint"), [F.col("a"), F.col("a"), F.col("b")]).alias("ratio")))


def _bucket_sql(sizes, edit: str, missing: str) -> str:
    inside = ", ".join(map(str, sizes))
    return f"coalesce(CASE WHEN mode = 'de_novo' AND size IN ({inside}) THEN 'de_novo:' || size || 'p' WHEN mode = 'edit' THEN 'edit:' || {edit} END, {missing})"


_quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
# the labels as they are known, written out
_KNOWN = (
    "DRD2:decrease+MW:decrease+SA:decrease", "GSK3B:increase", "HBA:decrease+LogP:increase", "HBA:decrease+MW:decrease", "HBA:decrease+SA:decrease", "HBA:increase+MW:increase+QED:decrease", "MW:increase",
    "QED:increase+SA:decrease", "RB:decrease", "SA:decrease",
)
_ROWS = f"(SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'de_novo' WHEN 1 THEN 'edit' ELSE 'other' END AS mode, CAST(p_partkey % 10 AS INTEGER) AS size, [{_quoted(_TASK_PICK)}][p_partkey % {len(_TASK_PICK)} + 1] AS task FROM part)"
_BY_TASK = f"CASE WHEN task IN ({_quoted(_KNOWN)}) THEN task END"
_DESC = ", ".join(f"{{'p': '{p}', 'k': {k}}}" for k, p in enumerate(records.DESCRIPTORS))
_num = lambda x: f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '.0')"
#: A program's rows, in order, from rows ``p_partkey, material, n, s`` with a goal in ``goal`` and a label part in ``part``.
_CHOSEN = "r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(material || ':' || s.p)) AS r FROM q)"
_LABELS = f"CASE WHEN string_agg(part, '+' ORDER BY part) IN ({_quoted(_KNOWN)}) THEN string_agg(part, '+' ORDER BY part) ELSE string_agg(part, '+' ORDER BY s.k) END"
_JS = """'[' || string_agg('{"goal":' || goal || ',"property":"' || s.p || '"}', ',' ORDER BY s.k) || ']'"""
_hexnum = lambda x: f"CAST(('0x' || substr(sha256({x}), 1, 16)) AS UBIGINT)"

SQL = {
    "bucket_labels": f"SELECT p_partkey, {_bucket_sql(range(2, 8), _BY_TASK, repr(''))} AS balanced, {_bucket_sql((5, 6, 7), _BY_TASK, repr(''))} AS target, {_bucket_sql(range(2, 8), _BY_TASK, 'NULL')} AS by_task, {_bucket_sql(range(2, 8), 'CASE WHEN size BETWEEN 1 AND 7 THEN size || ' + repr('p') + ' END', 'NULL')} AS by_count FROM {_ROWS}",
    "bucket_minimum": f"WITH b AS (SELECT {_bucket_sql(range(2, 8), _BY_TASK, repr(''))} AS bucket FROM {_ROWS}), e AS (SELECT unnest([{_quoted([f'de_novo:{n}p' for n in range(2, 8)] + [f'edit:{t}' for t in _KNOWN])}]) AS bucket) SELECT e.bucket, count(b.bucket) AS n, count(b.bucket) >= 5 AS enough FROM e LEFT JOIN b ON e.bucket = b.bucket GROUP BY e.bucket",
    "subset_filters": f"""
WITH p AS (SELECT *, list_slice(list_filter([{_quoted(programs.PROPERTIES)}], lambda x, i: ((p_partkey >> ((i - 1) % 6)) & 1) = 1), 1, 3) AS ps FROM {_ROWS})
SELECT p_partkey, CASE WHEN mode = 'de_novo' AND len(ps) IN (2, 3) AND len(list_filter(ps, lambda x: x NOT IN ('MW', 'LogP', 'QED', 'HBA', 'RB'))) = 0 THEN CAST(len(ps) AS INTEGER) END AS replayed,
mode = 'edit' AND len(list_filter(ps, lambda x: x IN ('SA', 'GSK3B', 'DRD2'))) > 0 AS edit_only, task IN ('DRD2:decrease+MW:decrease+SA:decrease', 'GSK3B:increase', 'HBA:decrease+SA:decrease', 'QED:increase+SA:decrease', 'SA:decrease') AS edit_only_task FROM p""",
    "construction_records": f"""
WITH p AS (SELECT *, sha256(CAST(p_partkey AS VARCHAR)) AS rank, replace(p_name, ' ', '_') AS target FROM part),
q AS (SELECT p_partkey, rank, target, p_retailprice, CAST(2 + {_hexnum(f"'{SEED}:count:' || rank")} % 6 AS INTEGER) AS n, '{SEED}:' || rank AS material, unnest([{_DESC}]) AS s FROM p), {_CHOSEN},
c AS (SELECT *, round(p_retailprice / (s.k + 3), 6) AS v FROM r WHERE r <= n), d AS (SELECT *, '{{"around":' || printf('%.6f', v) || '}}' AS goal, s.p || ':around=' || {_num('v')} AS part FROM c),
g AS (SELECT p_partkey, rank, target, n, {_JS} AS js, {_LABELS} AS label FROM d GROUP BY ALL)
SELECT p_partkey, 'MolProgramInstruct-Balanced' AS dataset, '1.0' AS release_version, 'mpi4m:de_novo:' || substr(sha256(target), 1, 24) AS example_id, 'de_novo' AS task_mode, '<EMPTY>' AS source_smiles, target AS target_smiles, '' AS source_hash,
sha256(target) AS target_hash, sha256(js) AS condition_hash, label AS task_key, n AS property_count, '{{"conditions":' || js || ',"source":"<EMPTY>"}}' AS request, '{{"plan":"BUILD","smiles":"' || target || '"}}' AS answer, 'deterministic_property_subset' AS program_view, rank AS selection_rank FROM g""",
    "edit_records": f"""
WITH p AS (SELECT *, replace(p_brand, '#', '_') AS source, replace(p_name, ' ', '_') AS target FROM part WHERE p_size % 7 <> 0), a AS (SELECT *, list_filter([{_DESC}], lambda s: (s.k + p_size) % 3 <> 0) AS act, '{SEED}:' || p_partkey || ':' || source || ':' || target AS material FROM p),
q AS (SELECT p_partkey, p_size, source, target, material, array_to_string(list_transform(act, lambda s: s.p), ',') AS active, CAST(1 + {_hexnum(f"'{SEED}:count:' || material")} % least(7, len(act)) AS INTEGER) AS n, unnest(act) AS s FROM a), {_CHOSEN},
c AS (SELECT *, CASE WHEN (p_size + s.k) % 2 = 0 THEN 'increase' ELSE 'decrease' END AS way FROM r WHERE r <= n), d AS (SELECT *, '"' || way || '"' AS goal, s.p || ':' || way AS part FROM c),
g AS (SELECT p_partkey, p_size, source, target, material, active, n, {_JS} AS js, {_LABELS} AS label FROM d GROUP BY ALL)
SELECT p_partkey, 'mpi4m:edit:' || substr(sha256(source || chr(10) || target), 1, 24) AS example_id, 'edit' AS task_mode, sha256(source) AS source_hash, sha256(target) AS target_hash, sha256(source || chr(10) || target) AS pair_hash, round(p_size / 50, 9) AS source_tanimoto,
sha256(js) AS condition_hash, label AS task_key, n AS property_count, '{{"conditions":' || js || ',"source":"' || source || '"}}' AS request, active, sha256(material) AS selection_rank FROM g""",
    "scorer_rows": f"""
WITH p AS (SELECT p_partkey, p_size, p_brand, [{_quoted(programs.PROPERTIES)}][p_size % 5 + 1] AS f, CASE WHEN p_size % 2 = 0 THEN 'increase' ELSE 'decrease' END AS d FROM part),
m AS (SELECT p_partkey, unnest([{{'k': 'source_smiles', 'v': CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END}}, {{'k': 'task_mode', 'v': 'edit'}}, {{'k': f || '_active', 'v': 'True'}}, {{'k': 'RB_active', 'v': 'True'}}, {{'k': f || '_direction', 'v': d}},
{{'k': 'target_RB', 'v': {_num('p_size / 4')}}}, {{'k': 'condition_properties', 'v': f || ',RB'}}, {{'k': 'instruction_tasks', 'v': '[{{"property":"' || f || '","direction":"' || d || '"}}]'}}]) AS e FROM p) SELECT p_partkey, e.k AS field, e.v AS content FROM m""",
    "candidate_audit": f"""
WITH s AS (SELECT p_partkey, mode, valid, copy, CASE WHEN NOT valid THEN -1 ELSE {scored_plans._BASE} + CASE WHEN mode = 'edit' THEN {scored_plans._EDIT} ELSE 0 END END AS soft, coalesce(valid AND NOT copy AND sim >= 0.65, false) AS near,
CASE WHEN valid AND NOT copy AND sim >= 0.65 THEN 0.25::DOUBLE * {scored_plans._one('canonical')} + 0.5::DOUBLE * satisfaction + 0.75::DOUBLE * bottleneck + 0.5::DOUBLE * fraction + {scored_plans._one('all_met')} + 4 * {scored_plans._one(scored_plans._STRICT)} ELSE -4.0::DOUBLE END AS hard FROM {scored_plans._SCORE})
SELECT p_partkey, round(soft, 9) AS soft_reward, round(hard, 9) AS hard_reward, round(CASE WHEN mode = 'edit' THEN hard ELSE soft END, 9) AS reward, round(soft, 9) AS reward_soft, near AS source_feasible, valid, copy FROM s""",
    "program_dispatch": f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'edit' ELSE 'de_novo' END AS mode, CASE WHEN p_size % 3 = 0 THEN 'MW:' || CASE WHEN p_size % 2 = 0 THEN 'increase' ELSE 'decrease' END ELSE 'QED:around=' || {_num('p_size / 8')} END AS label FROM part",
    "compact_rows": "SELECT event_type AS task, CAST(event_id AS VARCHAR) AS source_smiles, CAST(user_id AS VARCHAR) AS target_smiles, CAST(user_id % 7 AS INTEGER) AS instr_idx FROM events WHERE user_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 250",
    "available_and_selected": "SELECT event_type, count(*) AS rows, count(*) FILTER (user_id % 10 <> 0) AS available, least(count(*) FILTER (user_id % 10 <> 0), 250) AS selected FROM events GROUP BY event_type",
    "active_rank_histogram": f"SELECT CAST(a AS INTEGER) AS active_ranks, count(*) AS n FROM (SELECT key, count(*) FILTER (weight <> 0) AS a FROM ({scored_plans._route_sql(scored_plans.BINARY, False)}) GROUP BY key) GROUP BY a",
    "folded_count_fingerprint": "SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8))::UBIGINT % 2048 AS BIGINT) AS slot, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL",
    "external_result": "SELECT true AS tasks_ok, count(*) = count(user_id) AS one_each, true AS evaluable, count(*) = count(user_id) AS ok FROM events",
    "frozen_gate": "SELECT o_orderpriority, CAST(o_orderkey AS VARCHAR) AS content FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('37001:' || o_orderkey)) <= 20 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)",
    "gate_selection": "WITH f AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY sha256('37002:' || doc_id)) = 1) SELECT doc_id, lang FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('37002:' || doc_id)) <= 25",
    "parameter_ratio": "SELECT l_linenumber, round(sum(l_quantity)::DOUBLE / (2 * sum(l_quantity) FILTER (l_returnflag = 'N') + sum(l_quantity) FILTER (l_returnflag <> 'N'))::DOUBLE, 9) AS ratio FROM lineitem GROUP BY l_linenumber",
}
QUERIES = {f.__name__: f for f in (
    bucket_labels, bucket_minimum, subset_filters, construction_records, edit_records, scorer_rows, candidate_audit, program_dispatch, compact_rows, available_and_selected, active_rank_histogram, folded_count_fingerprint, external_result,
    frozen_gate, gate_selection, parameter_ratio,
)}
