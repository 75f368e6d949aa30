"""Registered queries: programs, scoring, text parsing, vectors, sequences and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, plugins, programs, scoring, sequences, vectors
from ..operators import evaluation, integrity
from .evaluation import rounded
from .selection import documents, spread, table

#: Binary layout by property, and a weighted one by mode and property.
BINARY = {"rank": 8, "common_ranks": [0, 1], "property_ranks": {"click": [2, 3], "error": [3, 4], "purchase": [5], "signup": [6, 7], "view": [4]}, "mode_ranks": {"edit": [2]}, "normalization": "rms_active"}
WEIGHTED = {"rank": 8, "common_ranks": [0], "inactive_floor": 0.25, "normalization": "rms_active", "node_rank_weights": {f"{m}:{e}": {str(1 + (k + o) % 7): 0.5 + 0.1 * k, str(1 + (2 * k) % 7): 0.9} for o, m in enumerate(("de_novo", "edit")) for k, e in enumerate(("click", "error", "purchase", "signup", "view"))}}
TEMPLATES = ["Raise the first.", "Lower the second.", "Keep the third."]
SPELLINGS = ("Mol Wt", "LOG-P", "h_bond acceptor", "QED", " tpsa ", "Rotatable Bonds", "unknown", "gsk3-beta")
WORDS = ("Increase", "up", "-", "LOWER", "same", "raise", "?", "un-changed")


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests: two conditions around and by direction, with values and sources."""
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select(
        "p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, "edit").otherwise("de_novo").alias("mode"), size.alias("value"), (price % 50).alias("source"),
        (size * 2).alias("value2"), (price % 37).alias("source2"), F.when(F.col("p_partkey") % 3 == 0, "increase").when(F.col("p_partkey") % 3 == 1, "decrease").otherwise("preserve").alias("direction"),
        (F.col("p_partkey") % 11 != 0).alias("valid"), (F.col("p_partkey") % 5 == 0).alias("canonical"), ((F.col("p_partkey") * 7) % 100 / 100.0).alias("similarity"), (F.col("p_partkey") % 17 == 0).alias("copy"))


def margin_columns(edit_only: bool = True) -> tuple[Column, Column, Column, Column]:
    """Margins and hits of both conditions: around 30 by 20, and the direction by 40 (edits only)."""
    none, source = F.lit(None).cast("double"), F.when(F.col("mode") == "edit", F.col("source2"))
    m1 = scoring.margin(F.col("value"), F.col("source"), F.lit(None).cast("string"), F.lit(30.0), F.lit(1.0), F.lit(20.0))
    m2 = scoring.margin(F.col("value2"), source, F.col("direction"), none, F.lit(40.0), F.lit(1.0))
    return m1, m2, scoring.satisfied(m1, F.lit(None).cast("string")), scoring.satisfied(m2, F.col("direction"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m1, m2, h1, h2 = margin_columns()
    return part_rows(spark, sf_dir).withColumn("s", scoring.program_score(F.array(m1, m2), F.array(h1, h2))).select("*", "s.*")


def condition_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m1, m2, h1, h2 = margin_columns()
    return rounded(part_rows(spark, sf_dir).select("p_partkey", m1.alias("m1"), m2.alias("m2"), h1.alias("h1"), h2.alias("h2")))


def softmin_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("p_partkey", "fraction", "satisfaction", "bottleneck", "all_met"))


def _outcome() -> tuple[Column, Column]:
    sim = F.when(F.col("mode") == "edit", F.col("similarity"))
    strict = F.col("all_met") & ((F.col("mode") != "edit") | (sim >= scoring.STRICT))
    return sim, strict


def soft_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim, _ = _outcome()
    c = [F.col(x) for x in ("valid", "canonical", "fraction", "satisfaction", "bottleneck", "all_met", "mode")]
    return rounded(scored(spark, sf_dir).select("p_partkey", scoring.soft_reward(*c, sim, F.col("copy") & (F.col("mode") == "edit")).alias("reward")))


def hard_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim, strict = _outcome()
    c = [F.col(x) for x in ("valid", "canonical", "fraction", "satisfaction", "bottleneck", "all_met")]
    return rounded(scored(spark, sf_dir).where("mode = 'edit'").select("p_partkey", scoring.hard_reward(*c, strict, sim, F.col("copy")).alias("reward")))


def reward_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim, strict = _outcome()
    c = [F.col(x) for x in ("valid", "canonical", "satisfaction", "bottleneck", "all_met", "mode")]
    made = scored(spark, sf_dir).select("p_partkey", "mode", scoring.channels(*c, sim, F.col("all_met") & (sim >= scoring.RELAXED), strict, F.col("copy")).alias("ch"))
    weights = F.when(F.col("mode") == "edit", scoring.weighted(F.col("ch"), scoring.EDIT_WEIGHTS)).otherwise(scoring.weighted(F.col("ch"), scoring.DE_NOVO_WEIGHTS))
    return rounded(made.select("p_partkey", F.size("ch").alias("n"), weights.alias("scalar")))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    kind = F.when(F.col("event_type") == "click", "source_copy").when(F.col("event_type") == "view", "invalid_corruption").otherwise("condition_mismatch")
    ratio = (F.col("k") - 50) / 25
    values, mask = F.array(F.col("value"), F.col("k"), F.col("value") + 1), F.array((F.col("k") % 2), F.lit(0.0), (F.col("event_id") % 3 == 0).cast("double"))
    return rounded(e.select(
        "event_id", scoring.kl_estimate(ratio).alias("kl"), scoring.hinge(F.lit(0.5), ratio, F.col("value") / 100, scoring.negative_weight("semantic_only", kind, F.lit(0.7))).alias("hinge"),
        scoring.masked_mean(values, mask).alias("masked"), scoring.exposure(F.col("event_id"), 4, 2, 13)["per_bucket"].alias("per_bucket"), scoring.finite(F.try_divide(F.col("value"), F.col("k") - 50)).alias("ratio")))


def alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", programs.property_of(pick(SPELLINGS)).alias("property"), programs.direction_of(pick(WORDS)).alias("direction"), programs.truthy(pick(("YES", "no", " 1 ", "true", "", "0"))).alias("yes"))


def _tasks(p: str = "p_size") -> Column:
    """A JSON list of two tasks by the part's size."""
    prop = lambda c: F.element_at(F.array(*map(F.lit, ("MW", "LogP", "QED", "hba", "Rot Bonds"))), (c % 5 + 1).cast("int"))
    way = lambda c: F.when(c % 2 == 0, "up").otherwise("lower")
    size = F.col(p)
    return F.to_json(F.array(F.struct(prop(size).alias("property"), way(size).alias("direction")), F.struct(prop(size + 2).alias("property"), way(size + 1).alias("direction"))))


def task_key_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = programs.from_instructions(_tasks(), F.lit(None).cast("string"), F.lit(None).cast("string"))
    label = programs.task_label(F.col("program"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", program.alias("program")).select("p_partkey", label.alias("label"), programs.is_registered(label).alias("registered"), programs.program_hash(F.col("program")).alias("hash"))


def control_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part")).select("p_partkey", F.lit("yes").alias("MW_active"), (F.col("p_retailprice") / 3).cast("string").alias("MW_setting"), F.when(F.col("p_size") % 2 == 0, "false").otherwise("true").alias("QED_None"), F.lit("raise").alias("QED_direction"))
    program = programs.from_controls(set(p.columns))
    return p.select("p_partkey", F.size(program).alias("n"), programs.task_label(program).alias("label"))


def strict_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "edit").otherwise("de_novo").alias("mode"), F.translate("p_name", " ", "_").alias("name"))
    plan = F.when(F.col("p_partkey") % 3 == 0, "BUILD").otherwise("MODIFY")
    key = F.col("p_partkey")
    middle = F.when(key % 7 == 0, " x").when(key % 5 == 0, "/C=C\\F").when(key % 11 == 0, '"').when(key % 13 == 0, "\n").when(key % 17 == 0, "\r").otherwise("")
    text = F.concat(F.lit(' {"plan":"'), plan, F.lit('","smiles":"'), F.col("name"), middle, F.when(key % 19 == 0, '"}x').otherwise('"}\n'))
    return p.select("p_partkey", programs.parse_response(text, F.col("mode")).alias("r"), programs.response(F.col("name"), F.col("mode")).alias("answer")).select("p_partkey", "r.*", "answer")


def last_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(programs.last_tagged(F.col("html"), "p").cast("binary")).alias("last_md5"))


def clause_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    items = F.slice(F.array(F.lit("raise size"), F.lit("lower price"), F.lit("keep brand")), F.lit(1), 1 + (F.col("p_size") % 3))
    return p.select("p_partkey", programs.clauses(items).alias("clauses"), programs.template(TEMPLATES, F.col("p_size") % 3).alias("instruction"), programs.number_or_null(F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_size").cast("string"))).alias("number"), programs.key_value(F.concat("p_brand", F.lit("=a=b")))["value"].alias("value"))


def message_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("m"))
    payload = F.when(F.col("conv_id") % 3 == 0, '{"source":"x","target":"y"}').otherwise('{"source":"x"}')
    return turns.select("conv_id", integrity.roles_are(F.col("m"), ["user", "assistant"]).alias("is_pair"), integrity.is_target_blind(F.slice("m", 1, 1), payload).alias("blind"), F.size("m").cast("long").alias("turns"))


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = programs.from_instructions(_tasks(), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", program.alias("program"), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("source"))
    turns = rows.select("p_partkey", programs.prompt(F.col("source"), F.col("program"), "design").alias("m"))
    again = programs.request_program(F.lit(None).cast(programs.PROGRAM), F.col("m"))
    return turns.select("p_partkey", F.col("m")[1]["content"].alias("content"), programs.request_mode(F.lit(""), F.col("m")).alias("mode"), F.size(again).alias("conditions"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    docs = documents(spark, sf_dir).select("doc_id", words.alias("w"))
    marks = F.array(*map(F.lit, ("the", "of", "de", "la", "und", "to")))
    return docs.select("doc_id", F.round(vectors.set_similarity(F.col("w"), marks), 9).alias("similarity"), F.size("w").alias("n"))


def folded_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", vectors.folded_slot(F.col("p_name"), 64).alias("slot"))
    return rows.groupBy("slot").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("node"), F.posexplode("embedding").alias("i", "x"))
    means = v.groupBy("node", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("signature"))


def centroid_cosine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_graph(signatures(spark, sf_dir)).select("src", "dst", F.round("cosine", 8).alias("cosine"))


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding"), 64).alias("u"), F.col("embedding").alias("e"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("u")), 8).alias("norm"), F.round(F.col("u")[0], 8).alias("first"))


def gradient_bisector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("a")).join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    b = vectors.bisector(F.col("a"), F.col("b"))
    return pairs.select("vec_id", b.alias("r")).select("vec_id", F.round("r.cosine", 7).alias("cosine"), F.col("r.common_descent").alias("common_descent"), F.round("r.merged_norm", 6).alias("merged_norm"))


def spectral_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spectral_layout(signatures(spark, sf_dir))[1]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set(F.when(F.col("value") > 60, F.col("event_type")))).alias("properties")).where(F.size("properties") > 0).withColumn("mode", F.when(F.col("key") % 2 == 0, "edit").otherwise("de_novo"))


def _flat(routes: DataFrame) -> DataFrame:
    return routes.select("key", F.posexplode("route").alias("rank_index", "weight")).select("key", "rank_index", F.round("weight", 9).alias("weight"))


def route_vectors_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(vectors.route_vectors(_requests(spark, sf_dir), BINARY))


def route_vectors_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(vectors.route_vectors(_requests(spark, sf_dir), WEIGHTED))


def label_mask_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.col("text")).alias("full"))
    prompt = F.concat(F.slice("full", 1, 5), F.array(F.lit(-1)))
    labels = sequences.masked_labels(sequences.with_end(F.col("full"), 0), prompt, 40)
    out = rows.select("conv_id", "turn", labels.alias("l"), sequences.common_prefix(F.col("full"), prompt).alias("prefix"))
    return out.select("conv_id", "turn", "prefix", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("labels"), sequences.is_supervised(F.col("l")).alias("supervised"))


def pad_to_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.slice(F.split("text", " "), 1, 12), lambda w: F.length(w)).alias("ids"), (F.col("conv_id") % 20).alias("batch"))
    padded = sequences.pad_batches(rows, "ids", "batch", -100, left=True)
    return padded.select("conv_id", "turn", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def distinct_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return plugins.score_once(rows, "p_name", lambda c: F.length(c).cast("double") / 2, "score").select("p_partkey", "score")


def missing_oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = programs.from_instructions(_tasks(), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return integrity.missing_oracles(spread(table(spark, sf_dir, "part")).select(program.alias("program")), "program", ["MW", "QED"])


def property_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = programs.from_instructions(_tasks(), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = spread(table(spark, sf_dir, "part")).select(F.transform(program, lambda c: c["property"]).alias("items"))
    return evaluation.item_histogram(rows, "items")


def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.lit("Brand#1")).alias("example_id"), F.col("p_name").alias("condition_id"))
    return rows.select("p_partkey", keys.identity(["example_id", "condition_id"]).alias("presence"), keys.identity(["example_id", "condition_id"], "truthy").alias("truthy"))


_PART = """(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'edit' ELSE 'de_novo' END AS mode, CAST(p_size AS DOUBLE) AS value, CAST(p_size * 2 AS DOUBLE) AS value2, p_retailprice % 37 AS source2,
p_partkey % 3 AS way, p_partkey % 11 <> 0 AS valid, p_partkey % 5 = 0 AS canonical, (p_partkey * 7) % 100 / 100.0::DOUBLE AS similarity, p_partkey % 17 = 0 AS copy FROM part)"""
_MARGIN = f"(SELECT *, 1 - abs(value - 30) / 20 AS m1, CASE WHEN mode = 'edit' THEN CASE way WHEN 0 THEN (value2 - source2) / 40 WHEN 1 THEN -((value2 - source2) / 40) ELSE 1 - abs((value2 - source2) / 40) END END AS m2 FROM {_PART})"
_HIT = f"(SELECT *, m1 >= 0 AS h1, CASE WHEN way < 2 THEN m2 > 0 ELSE m2 >= 0 END AS h2, 0.5::DOUBLE * (tanh(m1 / 0.25::DOUBLE) + 1) AS s1, 0.5::DOUBLE * (tanh(m2 / 0.25::DOUBLE) + 1) AS s2, least(m1, coalesce(m2, m1)) AS lo FROM {_MARGIN})"
_SCORE = f"""(SELECT *, (CAST(h1 AS INTEGER) + coalesce(CAST(h2 AS INTEGER), 0)) / 2.0::DOUBLE AS fraction, (s1 + coalesce(s2, 0)) / 2 AS satisfaction,
0.5::DOUBLE * (tanh((lo - 0.25::DOUBLE * ln(exp(-(m1 - lo) / 0.25::DOUBLE) + coalesce(exp(-(m2 - lo) / 0.25::DOUBLE), 0))) / 0.25::DOUBLE) + 1) AS bottleneck, h1 AND coalesce(h2, false) AS all_met,
CASE WHEN mode = 'edit' THEN similarity END AS sim FROM {_HIT})"""
_one = lambda c: f"coalesce(CAST(({c}) AS INTEGER), 0)::DOUBLE"
_STRICT = "all_met AND (mode <> 'edit' OR sim >= 0.65)"
_BASE = f"0.5::DOUBLE + 0.1::DOUBLE * {_one('canonical')} + 0.75::DOUBLE * fraction + 0.75::DOUBLE * satisfaction + 0.75::DOUBLE * bottleneck + {_one('all_met')}"
_EDIT = f"0.25::DOUBLE * least(sim / 0.65::DOUBLE, 1.0::DOUBLE) + 0.25::DOUBLE * {_one('sim >= 0.15')} + 0.5::DOUBLE * {_one('sim >= 0.65')} + 0.5::DOUBLE * {_one('all_met AND sim >= 0.15')} + {_one('all_met AND sim >= 0.65')} - 0.25::DOUBLE * {_one('copy')}"
_CHANNELS = f"0.5::DOUBLE + 0.1::DOUBLE * {_one('canonical')} + 0.75::DOUBLE * satisfaction + bottleneck + {_one('all_met')}"
_CH_EDIT = f"0.5::DOUBLE * 0.5::DOUBLE * (tanh((sim - 0.65::DOUBLE) / 0.15::DOUBLE) + 1) + 0.25::DOUBLE * {_one('sim >= 0.15')} + 0.5::DOUBLE * {_one('sim >= 0.65')} + 0.5::DOUBLE * {_one('all_met AND sim >= 0.15')} + {_one(_STRICT)} + 0.25::DOUBLE * {_one('NOT copy')}"
_NAMES = ["MW", "LogP", "QED", "HBA", "RB"]
_lst = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_PLACE = {p: k for k, p in enumerate(programs.PROPERTIES)}
_TWO = f"""(SELECT p_partkey, p_brand, p_size, {_lst(_NAMES)}[p_size % 5 + 1] AS p1, {_lst(_NAMES)}[(p_size + 2) % 5 + 1] AS p2, CASE WHEN p_size % 2 = 0 THEN 'increase' ELSE 'decrease' END AS d1, CASE WHEN (p_size + 1) % 2 = 0 THEN 'increase' ELSE 'decrease' END AS d2,
{[_PLACE[n] for n in _NAMES]}[p_size % 5 + 1] < {[_PLACE[n] for n in _NAMES]}[(p_size + 2) % 5 + 1] AS first FROM part)"""
_LABEL = "CASE WHEN first THEN p1 || ':' || d1 || '+' || p2 || ':' || d2 ELSE p2 || ':' || d2 || '+' || p1 || ':' || d1 END"
_cond = lambda p, d: f"""'{{"goal":"' || {d} || '","property":"' || {p} || '"}}'"""
_JSON = f"'[' || CASE WHEN first THEN {_cond('p1', 'd1')} || ',' || {_cond('p2', 'd2')} ELSE {_cond('p2', 'd2')} || ',' || {_cond('p1', 'd1')} END || ']'"
_CENTROID = "(SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT range AS i FROM range(1, 65)) GROUP BY label, i)"
_REQ = "(SELECT user_id AS key, event_type AS p, CASE WHEN user_id % 2 = 0 THEN 'edit' ELSE 'de_novo' END AS mode FROM events WHERE value > 60 GROUP BY ALL)"


def _route_sql(layout: dict, weighted: bool) -> str:
    if weighted:
        rows = [(n, int(k), w) for n, r in layout["node_rank_weights"].items() for k, w in r.items()]
        node = "mode || ':' || p"
    else:
        rows = [(p, k, 1.0) for p, r in layout["property_ranks"].items() for k in r] + [(f"mode={m}", k, 1.0) for m, r in layout["mode_ranks"].items() for k in r]
        node = "p"
    floor = layout.get("inactive_floor", 0.0) if weighted else 0.0
    values = ", ".join(f"('{n}', {k}, {w}::DOUBLE)" for n, k, w in rows)
    common = ", ".join(map(str, layout["common_ranks"]))
    return f"""
WITH l(node, k, w) AS (VALUES {values}), r AS (SELECT * FROM {_REQ}), n AS (SELECT key, {node} AS node FROM r UNION SELECT key, 'mode=' || mode FROM r),
a AS (SELECT key, k, max(w) AS w FROM n JOIN l USING (node) GROUP BY key, k), f AS (SELECT DISTINCT key, k FROM r, (SELECT range AS k FROM range({layout['rank']}))),
v AS (SELECT f.key, f.k, CASE WHEN f.k IN ({common}) THEN 1.0::DOUBLE ELSE greatest(coalesce(a.w, 0.0::DOUBLE), {floor}::DOUBLE) END AS w FROM f LEFT JOIN a USING (key, k))
SELECT key, CAST(k AS INTEGER) AS rank_index, round(w * sqrt({layout['rank']}::DOUBLE / sum(w * w) OVER (PARTITION BY key)), 9) AS weight FROM v"""


_alias = lambda words, fn: _lst([fn(w) for w in words])
_plain = lambda w: "".join(c for c in w.strip().lower() if c not in " _-\t")
_dirs = {x: k for k, v in programs.DIRECTION_NAMES.items() for x in v}

SQL = {
    "condition_margins": f"SELECT p_partkey, round(m1, 9) AS m1, round(m2, 9) AS m2, h1, h2 FROM {_HIT}",
    "softmin_bottleneck": f"SELECT p_partkey, fraction, round(satisfaction, 9) AS satisfaction, round(bottleneck, 9) AS bottleneck, all_met FROM {_SCORE}",
    "soft_reward": f"SELECT p_partkey, round(CASE WHEN NOT valid THEN -1 ELSE {_BASE} + CASE WHEN mode = 'edit' THEN {_EDIT} ELSE 0 END END, 9) AS reward FROM {_SCORE}",
    "hard_reward": f"SELECT p_partkey, round(CASE WHEN valid AND NOT copy AND sim >= 0.65 THEN 0.25::DOUBLE * {_one('canonical')} + 0.5::DOUBLE * satisfaction + 0.75::DOUBLE * bottleneck + 0.5::DOUBLE * fraction + {_one('all_met')} + 4 * {_one(_STRICT)} ELSE -4.0::DOUBLE END, 9) AS reward FROM {_SCORE} WHERE mode = 'edit'",
    "reward_channels": f"SELECT p_partkey, CAST(CASE WHEN mode = 'edit' THEN 11 ELSE 5 END AS INTEGER) AS n, round(CASE WHEN NOT valid THEN 0.0::DOUBLE ELSE {_CHANNELS} + CASE WHEN mode = 'edit' THEN {_CH_EDIT} ELSE 0 END END, 9) AS scalar FROM {_SCORE}",
    "losses": """
WITH e AS (SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), r AS (SELECT *, (k - 50) / 25 AS r, k % 2 AS a, CAST(event_id % 3 = 0 AS DOUBLE) AS c FROM e)
SELECT event_id, round(exp(-r) + r - 1, 9) AS kl, round(greatest(0, 0.5::DOUBLE + r - value / 100) * CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END, 9) AS hinge, round((value * a + (value + 1) * c) / greatest(a + c, 1), 9) AS masked,
CASE WHEN event_id * 8 % 13 = 0 THEN event_id * 8 // 13 END AS per_bucket, round(CASE WHEN k <> 50 THEN value / (k - 50) END, 9) AS ratio FROM r""",
    "alias_normalise": f"SELECT p_partkey, {_alias(SPELLINGS, lambda w: programs.PROPERTY_NAMES.get(_plain(w), ''))}[p_partkey % 8 + 1] AS property, {_alias(WORDS, lambda w: _dirs.get(_plain(w), ''))}[p_partkey % 8 + 1] AS direction, [true, false, true, true, false, false][p_partkey % 6 + 1] AS yes FROM part",
    "task_key_label": f"""
WITH t AS (SELECT p_partkey, {_LABEL} AS own, {_JSON} AS js, list_sort([p1 || ':' || d1, p2 || ':' || d2]) AS parts FROM {_TWO}),
k AS (SELECT *, array_to_string(parts, '+') IN ('HBA:decrease+LogP:increase', 'HBA:decrease+MW:decrease', 'HBA:decrease+SA:decrease', 'QED:increase+SA:decrease') AS registered FROM t)
SELECT p_partkey, CASE WHEN registered THEN array_to_string(parts, '+') ELSE own END AS label, registered, sha256(js) AS hash FROM k""",
    "control_programs": "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n, 'MW:around=' || regexp_replace(regexp_replace(printf('%.6f', round(p_retailprice / 3, 6)), '0+$', ''), '[.]$', '.0') || CASE WHEN p_size % 2 = 0 THEN '+QED:increase' ELSE '' END AS label FROM part",
    "strict_response_parse": """
WITH k AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN ' x' WHEN p_partkey % 5 = 0 THEN '/C=C\\F' WHEN p_partkey % 11 = 0 THEN '"' WHEN p_partkey % 13 = 0 THEN chr(10) WHEN p_partkey % 17 = 0 THEN chr(13) ELSE '' END AS middle FROM part),
p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'MODIFY' ELSE 'BUILD' END AS want, CASE WHEN p_partkey % 3 = 0 THEN 'BUILD' ELSE 'MODIFY' END AS plan,
             middle NOT IN ('"', chr(10)) AND p_partkey % 19 <> 0 AS whole, replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') || middle AS written FROM k)
SELECT p_partkey, whole AND plan = want AS strict_parse, whole AND plan = want AS valid, whole AND plan = want AS canonical, CASE WHEN whole AND plan = want THEN written ELSE '' END AS smiles, '{"plan":"' || want || '","smiles":"' || name || '"}' AS answer FROM p""",
    "last_tag_extract": "SELECT page_id, md5(trim(CASE WHEN len(m) > 0 THEN m[len(m)] ELSE string_split(html, chr(10))[1] END)) AS last_md5 FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<p>\\s*(.*?)\\s*</p>', 1) AS m FROM pages)",
    "clause_texts": f"SELECT p_partkey, ['raise size', 'raise size and lower price', 'raise size, lower price and keep brand'][p_size % 3 + 1] AS clauses, {_lst(TEMPLATES)}[p_size % 3 + 1] AS instruction, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS number, 'a=b' AS value FROM part",
    "message_contract_check": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) = 'user,assistant' AND bool_and(length(trim(text)) > 0) AS is_pair, conv_id % 3 <> 0 AND arg_min(role, turn) <> 'assistant' AS blind, count(*) AS turns FROM conversations GROUP BY conv_id",
    "prompt_messages": f"""SELECT p_partkey, '{{"conditions":' || {_JSON} || ',"source":"' || CASE WHEN p_size % 2 = 0 THEN '<EMPTY>' ELSE p_brand END || '"}}' AS content, CASE WHEN p_size % 2 = 0 THEN 'de_novo' ELSE 'edit' END AS mode, CAST(2 AS INTEGER) AS conditions FROM {_TWO}""",
    "token_jaccard": "WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) SELECT doc_id, round(len(list_intersect(w, m))::DOUBLE / (len(w) + len(m) - len(list_intersect(w, m))), 9) AS similarity, CAST(len(w) AS INTEGER) AS n FROM w, (SELECT ['the', 'of', 'de', 'la', 'und', 'to'] AS m)",
    "folded_slots": "SELECT CAST(('0x' || substr(md5(p_name), 1, 8))::UBIGINT % 64 AS BIGINT) AS slot, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY slot",
    "centroid_cosine_graph": f"""
WITH c AS {_CENTROID}, n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label), d AS (SELECT CAST(a.label AS VARCHAR) AS src, CAST(b.label AS VARCHAR) AS dst, sum(a.x * b.x) AS s, any_value(na.n) * any_value(nb.n) AS nn FROM c a JOIN c b ON a.i = b.i AND CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR) JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL)
SELECT src, dst, round(s / nn, 8) AS cosine FROM d""",
    "l2_normalise": "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / n, 8) AS first FROM n",
    "gradient_bisector": """
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), n AS (SELECT vec_id, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb, list_dot_product(a, b) AS ab FROM p),
c AS (SELECT *, ab / (na * nb) AS cosine FROM n) SELECT vec_id, round(cosine, 7) AS cosine, true AS common_descent, round(0.25::DOUBLE * (na + nb) * sqrt(2 + 2 * cosine), 6) AS merged_norm FROM c""",
    "route_vectors_binary": _route_sql(BINARY, False),
    "route_vectors_weighted": _route_sql(WEIGHTED, True),
    "label_mask_arrays": """
WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS f FROM conversations), p AS (SELECT conv_id, turn, least(5, len(f)) AS prefix, list_slice(CASE WHEN f[len(f)] = 0 THEN f ELSE list_append(f, 0) END, 1, 40) AS l FROM r)
SELECT conv_id, turn, CAST(prefix AS INTEGER) AS prefix, CAST(len(l) AS INTEGER) AS n, array_to_string(list_transform(l, lambda x, i: CASE WHEN i <= prefix THEN -100 ELSE x END), ',') AS labels, len(l) > prefix AS supervised FROM p""",
    "pad_to_batch": "WITH r AS (SELECT conv_id, turn, conv_id % 20 AS batch, list_slice(list_transform(string_split(text, ' '), lambda w: length(w)), 1, 12) AS f FROM conversations), m AS (SELECT *, max(len(f)) OVER (PARTITION BY batch) AS m FROM r) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(m - len(f)), lambda x: -100), f), ',') AS ids FROM m",
    "distinct_scoring": "SELECT p_partkey, length(p_name) / 2.0::DOUBLE AS score FROM part",
    "missing_oracles": f"SELECT DISTINCT property FROM (SELECT unnest([p1, p2]) AS property FROM {_TWO}) WHERE property NOT IN ('MW', 'QED')",
    "property_histogram": f"SELECT item, count(*) AS n FROM (SELECT unnest([p1, p2]) AS item FROM {_TWO}) GROUP BY item",
    "file_identity": "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_brand <> 'Brand#1' THEN p_brand END, p_name) AS presence, CASE WHEN p_size % 3 = 0 OR p_brand = 'Brand#1' THEN p_name ELSE p_brand END AS truthy FROM part",
}
QUERIES = {f.__name__: f for f in (
    condition_margins, softmin_bottleneck, soft_reward, hard_reward, reward_channels, losses, alias_normalise, task_key_label, control_programs, strict_response_parse, last_tag_extract, clause_texts, message_contract_check, prompt_messages,
    token_jaccard, folded_slots, centroid_cosine_graph, l2_normalise, gradient_bisector, spectral_layout, route_vectors_binary, route_vectors_weighted, label_mask_arrays, pad_to_batch, distinct_scoring, missing_oracles,
    property_histogram, file_identity,
)}
