"""Readers, writers and streams over small folders."""

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import tables
from sieveworks.streaming import logs

SCHEMA = "id string, n long"


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], SCHEMA)
    tables.write_json_lines(df, f"{tmp_path}/deep/x")
    assert sorted(map(tuple, tables.read_json_lines(spark, str(tmp_path), SCHEMA).collect())) == [("a", 2), ("b", 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/f.jsonl").write_text('{"id":"a","n":1}\n{"id":\n')
    with pytest.raises(Exception):
        tables.read_json_lines(spark, f"{tmp_path}/bad", SCHEMA).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/f.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        tables.read_json_lines(spark, f"{tmp_path}/empty", SCHEMA, allow_empty=False)


def test_objects_keep_their_place_and_others_raise(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","n":1}\n\n{"id":"y","n":2}\n')
    assert [(r.place, r.id) for r in tables.read_json_objects(spark, f"{tmp_path}/a.jsonl", SCHEMA).orderBy("place").collect()] == [(0, "x"), (2, "y")]
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="line 1"):
        tables.read_json_objects(spark, f"{tmp_path}/b.jsonl", SCHEMA).collect()


def test_csv_is_text_and_takes_all_columns(spark, tmp_path):
    a, b = spark.createDataFrame([("1", 'say "x"')], "a string, b string"), spark.createDataFrame([("2", "z")], "a string, c string")
    tables.write_csv([a, b], f"{tmp_path}/c")
    rows = tables.read_csv(spark, f"{tmp_path}/c")
    assert rows.columns == ["a", "b", "c"] and {tuple(r) for r in rows.collect()} == {("1", 'say "x"', None), ("2", None, "z")}
    (tmp_path / "x.csv").write_text("id,n\nq,5\n")
    (tmp_path / "y.jsonl").write_text('{"id":"w","n":6}\n')
    assert tables.read_any(spark, [f"{tmp_path}/y.jsonl", f"{tmp_path}/x.csv"], "id string, n string").count() == 2


def test_shards_digests_and_markers(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("shard"))
    assert tables.write_shards(df, f"{tmp_path}/s").select("sha256").distinct().count() == 3
    assert not tables.is_complete(spark, f"{tmp_path}/s")
    tables.mark_complete(spark, f"{tmp_path}/s")
    assert tables.is_complete(spark, f"{tmp_path}/s")
    tables.copy_table(spark, f"{tmp_path}/s/shard=0", f"{tmp_path}/copy")
    assert spark.read.text(f"{tmp_path}/copy").count() == 4


def test_places_and_reports(spark):
    df = tables.with_place(spark.range(0, 50, 1, 7))
    assert sorted(r.place for r in df.collect()) == list(range(50))
    assert [r.id for r in tables.lookup_places(df, [-1, 0]).orderBy("id").collect()] == [0, 49]
    assert "| 0.5000 |" in tables.markdown(spark.createDataFrame([(0.5,)], "x double"), "T")
    assert '"x": 1' in tables.manifest_text(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        tables.bucket_index(spark.createDataFrame([("a",)], "b string"), "b", ["a", "z"])


def test_logs_resume(spark, tmp_path):
    assert tables.read_log(spark, f"{tmp_path}/none", SCHEMA).count() == 0
    want, done = spark.createDataFrame([("a", 0), ("b", 1)], "id string, place long"), spark.createDataFrame([("a", 0)], "id string, place long")
    assert [r.id for r in logs.remaining(want, done, "id").collect()] == ["b"]
    assert logs.verified_prefix(want, done, "place", ["id"]).first()[:] == (1, True)
    assert not logs.verified_prefix(want, done.withColumn("id", F.lit("z")), "place", ["id"]).first().is_prefix


def test_streams_keep_the_first_k_and_totals(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    spark.createDataFrame([("a", 3), ("a", 1), ("b", 9)], SCHEMA).write.json(log)
    for more in ([], [("a", 2), ("b", 1)]):
        if more:
            spark.createDataFrame(more, SCHEMA).write.mode("append").json(log)
        logs.start(logs.log_stream(spark, log, SCHEMA), logs.top_k_sink(spark, out, "id", ["n"], 2), f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(logs.last_version(spark, out)).select("id", "n").collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 9)]
    q = logs.totals_stream(logs.log_stream(spark, log, SCHEMA), ["id"], ["n"]).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: (r.rows, r.n_total) for r in spark.table("totals").collect()} == {"a": (3, 6), "b": (2, 10)}
    q = logs.append_log(logs.first_seen_stream(logs.log_stream(spark, log, SCHEMA), "id"), f"{tmp_path}/seen", f"{tmp_path}/ck2")
    q.awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/seen").count() == 2
