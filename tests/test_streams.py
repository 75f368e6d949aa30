"""Step logs, checked writes and keyed state, with restarts and repeated batches."""

import time

import pytest
from pyspark.sql import functions as F

from sieveworks.streaming import keyed, steps

SCHEMA = "id long, bucket string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_step_is_appended_once(spark, tmp_path):
    log = steps.StepLog(spark, f"{tmp_path}/log", SCHEMA)
    assert log.newest() is None and log.read().count() == 0 and log.listing().count() == 0
    assert log.append(frame(spark, [(1, "a", 1), (2, "b", 2)]), 0, {"top": F.max("v")}, state={"next": 2})
    assert not log.append(frame(spark, [(9, "a", 9)]), 0) and log.append(frame(spark, []), 1) and log.append(frame(spark, [(3, "c", 3)]), 7)
    assert sorted(r.id for r in log.read().collect()) == [1, 2, 3] and [r.id for r in log.read(until=0).where("v > 1").collect()] == [2]
    assert [tuple(r) for r in log.listing().orderBy("step").collect()] == [(0, 2), (1, 0), (7, 1)]
    assert log.steps()[0]["metrics"] == {"rows": 2, "top": 2} and log.steps()[0]["state"] == {"next": 2} and log.newest()["step"] == 7
    sink = log.sink()
    sink(frame(spark, [(4, "d", 4)]), 8)
    sink(frame(spark, [(4, "d", 4)]), 8)
    assert log.read().count() == 4 and log.clean() == 0


def test_half_written_steps_are_never_listed(spark, tmp_path):
    log = steps.StepLog(spark, f"{tmp_path}/log", SCHEMA)
    log.append(frame(spark, [(1, "a", 1)]), 0)
    log.append(frame(spark, [(2, "a", 1)]), 1)
    # killed while writing the rows, and while writing the commit
    frame(spark, [(3, "a", 1)]).write.parquet(f"{tmp_path}/log/data/_attempt=000000000002-dead")
    (tmp_path / "log/drafts").mkdir(exist_ok=True)
    (tmp_path / "log/drafts/x.json").write_text('{"step": 2')
    with pytest.raises(Exception, match="broken"):
        log.append(frame(spark, [(5, "a", 1)]).withColumn("v", F.raise_error(F.lit("broken")).cast("long")), 3)
    assert [r["step"] for r in log.steps()] == [0, 1] and log.newest()["step"] == 1 and sorted(r.id for r in log.read().collect()) == [1, 2]
    assert log.clean() == 2 and log.read().count() == 2
    # a step that lost a file is not whole: resuming takes the one before
    folder = tmp_path / "log" / log.newest()["folder"]
    next(folder.glob("part-*")).unlink()
    assert log.newest()["step"] == 0


def test_checks_count_in_the_same_pass_and_refuse_the_commit(spark, tmp_path):
    rows = frame(spark, [(1, "a", 1), (2, "b", None), (3, "b", 5)])
    counted = spark.sparkContext.accumulator(0)
    reads = F.udf(lambda x: counted.add(1) or x, "long")
    metrics = {"b": F.count(F.when(F.col("bucket") == "b", 1)), "nulls": F.count(F.when(F.col("v").isNull(), 1))}
    found = steps.checked_write(rows.withColumn("id", reads("id")), f"{tmp_path}/ok", metrics, {"two b": lambda m: m["b"] == 2})
    assert found == {"rows": 3, "b": 2, "nulls": 1} and counted.value == 3 and spark.read.parquet(f"{tmp_path}/ok").count() == 3
    with pytest.raises(steps.Refused, match="no nulls") as e:
        steps.checked_write(rows, f"{tmp_path}/bad", metrics, {"two b": lambda m: m["b"] == 2, "no nulls": lambda m: m["nulls"] == 0})
    assert e.value.failed == ["no nulls"] and e.value.metrics["rows"] == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["ok"]
    with pytest.raises(FileExistsError):
        steps.checked_write(rows, f"{tmp_path}/ok", metrics, {})
    log = steps.StepLog(spark, f"{tmp_path}/log", SCHEMA)
    with pytest.raises(steps.Refused):
        log.append(rows, 0, metrics, {"no nulls": lambda m: m["nulls"] == 0})
    assert log.steps() == [] and log.clean() == 0


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


@pytest.mark.parametrize("cuts", [[0, 200], [0, 1, 60, 61, 200], [0, 100, 100, 200]])
def test_top_k_is_the_same_however_the_stream_is_cut(spark, tmp_path, cuts):
    keyed.with_rocksdb(spark)
    rows = [(k * 37 % 101, "abc"[k % 3] if k % 17 else None, k * 53 % 29 if k % 5 else None) for k in range(200)]
    log = steps.StepLog(spark, f"{tmp_path}/log", SCHEMA + ", change int")
    for a, b in zip(cuts, cuts[1:]):  # every piece is a new start from the checkpoint
        frame(spark, rows[a:b]).write.mode("append").parquet(f"{tmp_path}/in")
        keyed.run_available(keyed.top_k_changes(stream_of(spark, f"{tmp_path}/in"), "bucket", ["v"], 7), log.sink(), f"{tmp_path}/ck")
    want = []
    for bucket in (None, "a", "b", "c"):
        order = lambda r: ((r[2] is not None, r[2] or 0), (r[0] is not None, r[0]))
        want += sorted((r for r in rows if r[1] == bucket), key=order)[:7]
    assert sorted(map(str, (tuple(r) for r in keyed.current(log.read()).collect()))) == sorted(map(str, want))


def test_the_top_k_state_holds_k_rows_a_bucket(spark, tmp_path):
    keyed.with_rocksdb(spark)
    sizes = []
    for k in range(3):
        spark.range(2000).select((F.col("id") + 2000 * k).alias("id"), F.lit("a").alias("bucket"), (-F.col("id")).alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
        query = keyed.run_available(keyed.top_k_changes(stream_of(spark, f"{tmp_path}/in"), "bucket", ["v"], 10), lambda batch, n: batch.count() and None, f"{tmp_path}/ck", seconds=100)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 12, sizes


def test_first_seen_rows_with_bounded_state(spark, tmp_path):
    keyed.with_rocksdb(spark)
    schema = frame(spark, []).schema
    first = keyed.FirstSeen(spark, f"{tmp_path}/store", schema, "bucket")
    batches = [[(1, "a", 1), (2, "b", 1), (0, "a", 2), (3, None, 1)], [(4, "a", 1), (5, "c", 1), (6, None, 2)], [(7, "b", 0), (8, "d", 1), (9, "c", 1), (10, "d", 1)]]
    for rows in batches:
        frame(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.not_seen_lately(stream_of(spark, f"{tmp_path}/in"), "bucket", ["id"], 1)  # state forgets at once: the store must know
        keyed.run_available(stream, first.sink(), f"{tmp_path}/ck", seconds=100)
        time.sleep(0.05)
    assert sorted((r.id, r.bucket) for r in first.rows().collect()) == [(0, "a"), (2, "b"), (3, None), (5, "c"), (8, "d")]
    first.sink()(frame(spark, batches[0]), 0)  # a batch that is run again
    assert first.rows().count() == 5


def test_forgotten_keys_leave_the_state(spark, tmp_path):
    keyed.with_rocksdb(spark)
    sizes = []
    for k in range(4):
        spark.range(300).select("id", (F.col("id") + 300 * k).cast("string").alias("bucket"), F.lit(0).cast("long").alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
        query = keyed.run_available(keyed.not_seen_lately(stream_of(spark, f"{tmp_path}/in"), "bucket", ["id"], 1), lambda batch, n: batch.count() and None, f"{tmp_path}/ck", seconds=100)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(0.05)
    assert sizes[-1] <= 2 * sizes[0] < 300 * 4 * 2, sizes


def test_first_seen_store_has_a_file_for_each_bucket(spark, tmp_path):
    first = keyed.FirstSeen(spark, f"{tmp_path}/store", frame(spark, []).schema, "bucket")
    rows = spark.range(4000).select("id", F.col("id").cast("string").alias("bucket"), F.lit(0).cast("long").alias("v")).repartition(16)
    first.sink()(rows, 0)
    first.sink()(rows.withColumn("id", F.col("id") + 4000), 1)
    assert first.rows().count() == 4000
    assert len(list(tmp_path.glob("store/data/**/_bucket=*/*.parquet"))) <= keyed.STORE_BUCKETS
