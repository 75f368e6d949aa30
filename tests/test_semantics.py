"""Small hand-made frames for what is easily got wrong."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import keys, plugins, programs, scoring, sequences, vectors
from sieveworks.operators import compare, evaluation, integrity, schedule, selection


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_margins_at_their_edges(spark):
    around = lambda off: scoring.satisfied(scoring.margin(F.lit(200.0 + off), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(200.0), F.lit(500.0), F.lit(35.0)), F.lit(None).cast("string"))
    assert list(one(spark, around(34.9), around(35.0), around(35.1))) == [True, True, False]
    way = lambda d: scoring.satisfied(scoring.margin(F.lit(5.0), F.lit(5.0), F.lit(d), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)), F.lit(d))
    assert list(one(spark, way("increase"), way("decrease"), way("preserve"))) == [False, False, True]


def test_what_cannot_be_evaluated_stays_in_the_denominator(spark):
    none = F.lit(None).cast("double")
    row = one(spark, scoring.program_score(F.array(F.lit(1.0), none), F.array(F.lit(True), F.lit(None).cast("boolean"))).alias("s")).s
    assert row.fraction == 0.5 and not row.all_met and row.bottleneck == pytest.approx(0.5 * (math.tanh(4) + 1))
    assert one(spark, scoring.bottleneck(F.array(none))).asDict().popitem()[1] == 0.0


def test_means_skip_nulls_and_say_what_empty_gives(spark):
    rows = spark.createDataFrame([("a", 0.8), ("a", None), ("b", None)], "k string, x double")
    out = {r.k: r for r in rows.groupBy("k").agg(evaluation.mean_of("x").alias("n"), evaluation.mean_of("x", "zero").alias("z")).collect()}
    assert (out["a"].n, out["b"].n, out["b"].z) == (0.8, None, 0.0)
    with pytest.raises(Exception, match="no values"):
        rows.where("k = 'b'").agg(evaluation.mean_of("x", "error")).collect()


def test_pooled_differs_from_macro(spark):
    rows = spark.range(120).select(F.when(F.col("id") < 100, "2p").otherwise("6p").alias("bucket"), (F.col("id") < 100).alias("ok"))
    by = evaluation.bucket_metrics(rows, ["bucket"], ["ok"])
    buckets = spark.createDataFrame([("2p",), ("6p",)], "bucket string")
    assert evaluation.macro(by, buckets, ["ok_rate"]).first()[0] == 0.5
    assert evaluation.bucket_metrics(rows, [], ["ok"]).first().ok_rate == pytest.approx(100 / 120)
    more = spark.createDataFrame([("2p",), ("6p",), ("7p",)], "bucket string")
    assert evaluation.macro(by, more, ["ok_rate"], on_empty="zero").first()[0] == pytest.approx(1 / 3)
    assert evaluation.macro(by, more, ["ok_rate"], on_empty="null").first()[0] == 0.5
    with pytest.raises(Exception, match="no rows for 7p"):
        evaluation.macro(by, more, ["ok_rate"]).collect()


def test_ties_of_hashes_follow_the_order_given(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2)], "id string, ord int")
    key = keys.stable_key(1, F.col("id"))
    assert selection.smallest(rows, [], [key, "ord"], 1).first().ord == 1
    assert selection.smallest(rows, [], [key, F.desc("ord")], 1).first().ord == 2


def test_quotas_split_with_the_remainder_first(spark):
    assert [r.quota for r in selection.quota_table(spark, ["a", "b", "c"], 10).collect()] == [4, 3, 3]
    with pytest.raises(ValueError):
        selection.quota_table(spark, ["a", "b"], 1)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "bucket string, id int")
    with pytest.raises(ValueError, match="too few"):
        selection.by_quota(rows, selection.quota_table(spark, ["a", "b"], 3), ["id"], exact=True)


def test_cutoff_ties_keep_exactly_the_quota(spark):
    rows = spark.createDataFrame([("a", "00")] * 5, "bucket string, key string")
    assert selection.cutoffs(rows, "bucket", "key", 3).first().kept == 3


def test_greedy_assignment_equals_a_loop_and_depends_on_order(spark):
    rows = [(k, [1 + k % 2, 3], f"m{k}") for k in range(60)]
    df = spark.createDataFrame([(k, f, m, -k) for k, f, m in rows], "ord int, feasible array<int>, material string, back int")

    def loop(rows):
        counts, out = {1: 0, 2: 0, 3: 0}, {}
        for k, feasible, material in rows:
            b = min(feasible, key=lambda x: (counts[x], hashlib.sha256(f"{material}:bucket:{x}".encode()).hexdigest()))
            counts[b] += 1
            out[k] = b
        return out

    got = {r.ord: r.bucket for r in selection.greedy_buckets(df, "ord", "feasible", "material", [1, 2, 3]).collect()}
    back = {r.ord: r.bucket for r in selection.greedy_buckets(df, "back", "feasible", "material", [1, 2, 3]).collect()}
    assert got == loop(rows) and back == loop(rows[::-1]) and got != back


def test_zscores_clip_and_vanish_without_variance(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in [0] * 15 + [100]] + [("b", 1.0)] * 3, "g string, x double")
    out = [(r.g, r.z) for r in evaluation.with_zscore(rows, "x", ["g"], "z").select("g", "z").collect()]
    assert max(z for g, z in out if g == "a") == 3.0 and {z for g, z in out if g == "b"} == {0.0}


def test_support_of_groups(spark):
    rows = spark.createDataFrame([("none", False, 1.0), ("none", False, 2.0), ("some", True, 2.0), ("some", False, 2.0 + 1e-13), ("all", True, 1.0), ("all", True, 1.0)], "g string, strict boolean, r double")
    out = {r.g: r for r in evaluation.group_support(rows, ["g"], hard="r", soft="r").collect()}
    assert [out[k].mixed for k in ("none", "some", "all")] == [False, True, False]
    assert [out[k].hard_top_strict for k in ("none", "some", "all")] == [None, True, True]
    assert not out["all"].hard_informative


@pytest.mark.parametrize("change,decision", [({}, "PROCEED_TO_SMALL_ONLINE_RL_PILOT"), ({"strict_any": 0.9}, "DO_NOT_RUN_ONLINE_RL_SUPPORT_TOO_LOW"), ({"top_strict": 1.1}, "REPAIR_REWARD_BEFORE_ONLINE_RL"), ({"tasks": 11}, "BUILD_SUPPORT_BEFORE_ONLINE_RL")])
def test_support_gate_decisions(spark, change, decision):
    rows = [(f"t{t}", f"g{t}{k}", k == 0 and c == 0, 5.0 if c == 0 else 0.0) for t in range(10) for k in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "task_key string, g string, strict boolean, r double")
    summary = evaluation.support_summary(evaluation.group_support(df, ["g", "task_key"], hard="r", soft="r"))
    assert evaluation.support_gate(summary, thresholds=change).first().decision == decision


def test_authorisation_wants_the_same_thresholds():
    good = {"decision": "PROCEED_TO_SMALL_ONLINE_RL_PILOT", "failed_checks": [], "thresholds": dict(evaluation.SUPPORT_THRESHOLDS)}
    assert evaluation.is_authorised(good) and not evaluation.is_authorised(good | {"thresholds": {}}) and not evaluation.is_authorised(good | {"failed_checks": ["x"]})


def test_identity_policies(spark):
    df = spark.createDataFrame([("", "c")], "example_id string, condition_id string")
    assert df.select(keys.identity(["example_id", "condition_id"]), keys.identity(["example_id", "condition_id"], "truthy")).first()[:] == ("", "c")


def test_same_size_with_a_wrong_id_is_a_mismatch(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("z",)], "k string")
    assert not compare.identity_audit(a, b, "k").first().matches
    assert not compare.identity_audit(a, a.union(a), "k").first().matches
    with pytest.raises(Exception, match="do not match"):
        compare.paired(a.withColumn("v", F.lit(1)), b.withColumn("v", F.lit(1)), ["k"], ["v"]).collect()


def test_conflicting_goals_raise(spark):
    text = lambda s: programs.ordered(programs.from_json_program(F.lit(s)))
    same = one(spark, text('[{"property":"SA","goal":"decrease"},{"property":"MW","goal":{"around":3}},{"property":"SA","goal":"decrease"}]').alias("p")).p
    assert [(c.property, c.direction, c.around) for c in same] == [("MW", None, 3.0), ("SA", "decrease", None)]
    with pytest.raises(Exception, match="conflicting"):
        one(spark, text('[{"property":"MW","goal":"increase"},{"property":"MW","goal":"decrease"}]'))
    with pytest.raises(Exception, match="unsupported or missing"):
        one(spark, programs.from_instructions(F.lit('[{"property":"what","direction":"up"}]'), F.lit(""), F.lit("")))
    by_names = programs.from_instructions(F.lit(""), F.lit("SA, mw"), F.lit('{"SA":"lower","MW":"+"}'))
    assert [(c.property, c.direction) for c in one(spark, by_names.alias("p")).p] == [("MW", "increase"), ("SA", "decrease")]


def test_a_dash_names_no_direction(spark):
    assert one(spark, programs.direction_of(F.lit("-")), programs.direction_of(F.lit("↓")), programs.property_of(F.lit("GSK3β")))[:] == ("", "decrease", "GSK3B")


def test_responses_must_match_to_the_letter(spark):
    parse = lambda text, mode: one(spark, programs.parse_response(F.lit(text), F.lit(mode)).alias("r")).r
    assert parse('{"plan":"BUILD","smiles":"CC"}\n', "de_novo").valid
    assert not parse('{"plan":"BUILD","smiles":"CC"}', "edit").strict_parse
    assert not parse('{"plan": "BUILD","smiles":"CC"}', "de_novo").valid and not parse(None, "edit").valid


def test_a_prompt_must_not_leak(spark):
    program = F.array(programs.condition(F.lit("MW"), F.lit("increase")))
    with pytest.raises(Exception, match="forbidden"):
        one(spark, programs.prompt(F.lit("x"), program, "see target_smiles"))


def test_last_tag_and_fallback(spark):
    last = lambda t: one(spark, programs.last_tagged(F.lit(t))).asDict().popitem()[1]
    assert last("<SMILES> A </SMILES> <smiles>\nB\n</smiles>") == "B" and last("x %%% Response: C\nD") == "C"


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert df.agg(F.percentile("x", F.lit(0.25))).first()[0] == 1.75


def test_checkpoint_choice(spark):
    rows = spark.createDataFrame([(10, 0.02, 0.0, True), (20, 0.05, 0.1, False), (30, 0.03, 0.0, True)], "step int, a double, b double, safe boolean")
    assert compare.pick_checkpoint(rows, "step", "a", "b", ["safe"]).first().step == 30


def test_route_energy_is_the_rank(spark):
    df = spark.createDataFrame([(1, "edit", ["MW", "SA"]), (2, "de_novo", ["SA"])], "key int, mode string, properties array<string>")
    layout = {"rank": 16, "common_ranks": [0, 1], "property_ranks": {"MW": [2, 3], "SA": [4]}, "normalization": "rms_active"}
    for r in vectors.route_vectors(df, layout).collect():
        assert sum(x * x for x in r.route) == pytest.approx(16)
    with pytest.raises(Exception, match="no route for"):
        vectors.route_vectors(df.withColumn("properties", F.array(F.lit("QED"))), layout).collect()
    with pytest.raises(ValueError):
        vectors.check_layout(layout | {"common_ranks": [0, 0]})


def test_spectral_factors_rebuild_the_affinity(spark):
    df = spark.createDataFrame([("a:x", [1.0, 0.0]), ("a:y", [1.0, 0.1]), ("b:z", [-1.0, 0.0])], "node string, signature array<double>")
    layout, rows = vectors.spectral_layout(df, rank=6, common=2)
    weights = {(r.node, r.rank_index): r.weight for r in rows.collect()}
    assert layout["eigenvalues"][0] > 2.9 and weights["a:x", 2] > 0.9 and weights["b:z", 3] > 0.9 and weights["b:z", 2] == 0
    with pytest.raises(Exception):
        df.union(spark.createDataFrame([("c:w", [0.0, 0.0])], df.schema)).select(vectors.unit(F.col("signature"))).collect()


def test_interleave_leaves_the_tail(spark):
    df = spark.createDataFrame([("a", k) for k in range(3)] + [("b", k) for k in range(5)], "mode string, id int")
    got = "".join(r.mode for r in schedule.interleave(df, "mode", ["a", "b"], ["id"]).orderBy("turn", "turn_mode").collect())
    assert got == "abababbb"
    with pytest.raises(ValueError):
        schedule.interleave(df, "mode", ["a", "b"], ["id"], strict=True)


def test_proportional_order(spark):
    df = spark.createDataFrame([(b, k) for b, n in (("a", 3), ("b", 7), ("c", 2)) for k in range(n)], "bucket string, id int")
    got = [(r.bucket, r.pos) for r in schedule.proportional(df, "bucket", ["id"]).orderBy("merge_key", "bucket", "pos").collect()]
    want = sorted(((k + 0.5) / n, b, k) for b, n in (("a", 3), ("b", 7), ("c", 2)) for k in range(n))
    assert got == [(b, k) for _, b, k in want]


def test_labels_hide_the_prompt(spark):
    arr = lambda xs: F.array(*map(F.lit, xs))
    row = one(spark, sequences.masked_labels(arr([1, 2, 3, 4]), arr([1, 2, 9]), 3), sequences.common_prefix(arr([1, 2]), arr([1, 2, 3])), sequences.is_supervised(arr([-100, -100])))
    assert list(row) == [[-100, -100, 3], 2, False]


def test_overlaps_and_blindness(spark):
    named = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 3)], "name string, k int")
    assert {(r.left, r.right): r.n for r in integrity.overlaps(named, "name", "k").collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1}
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    assert one(spark, integrity.is_target_blind(m, F.lit('{"source":"s"}')), integrity.is_target_blind(m, F.lit('{"target":"s"}')), integrity.is_target_blind(m, F.lit("{}"), ["target"]))[:] == (True, False, False)


def test_containment_equals_direct_search(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "xone two three four five six seveny"), (3, "one two three"), (4, None), (5, "tiny")], "id int, text string")
    passages = spark.createDataFrame([("one two three four five six seven",), ("tin",), ("",), (None,)], "p string")
    assert {r.id for r in selection.containing(docs, passages, "id", "text", "p").collect()} == {1, 2, 5}


def test_plugins_score_distinct_texts_once(spark):
    domain = plugins.Domain()
    domain.register("len", lambda c: F.length(c), "test")
    df = spark.createDataFrame([("aa",), ("aa",), (None,)], "t string")
    assert sorted(str(r.x) for r in df.select(domain.score("len", F.col("t")).alias("x")).collect()) == ["2.0", "2.0", "None"]
    assert domain.score("none", F.col("t")) is not None and domain.provenance(spark).count() == 1
    assert plugins.score_once(df, "t", lambda c: F.length(c), "n").count() == 3


def test_containing_passages_of_all_lengths(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta", "the cat sat on a mat", "xalpha betax", "one two three four", "no match here", ""]
    passages = ["pha beta gamma delta epsilon zet", "at sat on", "pha bet", "three", "wo three fou", "eta theta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = selection.containing(docs, spark.createDataFrame([(p,) for p in passages], "p string"), "id", "text", "p")
    assert sorted(r.id for r in found.collect()) == [k for k, t in enumerate(texts) if any(p in t for p in passages)]


def test_containing_in_very_long_texts(spark):
    long = " ".join(f"w{k * 7919 % 99_991}" for k in range(100_000))
    inner = " ".join(long.split()[90_000:90_009])[1:-1]
    docs = spark.createDataFrame([(0, long), (1, "w" * 300_000), (2, "short text")], "id long, text string")
    passages = [inner, "w7 w7", "ort te", "x" * 40, long[-30:]]
    began = __import__("time").time()
    found = selection.containing(docs, spark.createDataFrame([(p,) for p in passages], "p string"), "id", "text", "p").collect()
    assert sorted(r.id for r in found) == [0, 2] and __import__("time").time() - began < 60


def test_answers_may_hold_anything_but_quotes_and_line_feeds(spark):
    texts = ['{"plan":"BUILD","smiles":"F/C=C\\F"}', '{"plan":"BUILD","smiles":"CC x"}', '{"plan":"MODIFY","smiles":"C"}', '{"plan":"BUILD","smiles":"C"C"}', '{"plan":"BUILD","smiles":"C\nC"}', '\n{"plan":"BUILD","smiles":"C"} ', '{"plan":"BUILD","smiles":""}', '{"plan": "BUILD","smiles":"C"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.p for r in df.select("k", programs.parse_response(F.col("t"), F.lit("de_novo")).alias("p")).collect()}
    assert [got[k].strict_parse for k in range(8)] == [True, True, False, False, False, True, False, False] and got[0].smiles == "F/C=C\\F"


def test_registered_labels_are_as_known(spark):
    from sieveworks.functions import programs

    cases = {
        (("LogP", "up"), ("HBA", "lower")): "HBA:decrease+LogP:increase", (("SA", "down"), ("MW", "down"), ("DRD2", "down")): "DRD2:decrease+MW:decrease+SA:decrease",
        (("QED", "down"), ("MW", "up"), ("HBA", "up")): "HBA:increase+MW:increase+QED:decrease", (("LogP", "up"), ("HBA", "up")): "LogP:increase+HBA:increase", (("RB", "lower"),): "RB:decrease",
    }
    import json

    rows = spark.createDataFrame([(json.dumps([{"property": p, "direction": d} for p, d in c]), w) for c, w in cases.items()], "tasks string, want string")
    none = F.lit(None).cast("string")
    got = rows.select("want", programs.task_label(programs.from_instructions(F.col("tasks"), none, none)).alias("label")).collect()
    assert all(r.label == r.want for r in got) and set(programs.SHARED_TASKS) < set(programs.REGISTERED_TASKS)
