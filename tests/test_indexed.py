"""Indexed shards: commits, lookups by range, and what a killed writer leaves."""

import os
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import indexed

SCHEMA = "id long, text string"


@pytest.fixture
def path(spark, tmp_path):
    rows = spark.range(0, 200, 1, 3).select("id", F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"), F.lit(1).alias("value"))
    indexed.write_indexed(rows.drop("value"), f"file://{tmp_path}/t", 3, ["id"])
    return f"file://{tmp_path}/t"


def local(path):
    return Path(path.removeprefix("file://"))


#: Shard-major: shard 0 has ids 0, 3, 6, ...
PLACES = [i for s in range(3) for i in range(200) if i % 3 == s]


def test_rows_lie_in_turn_over_the_shards(spark, path):
    got = sorted(map(tuple, indexed.read_indexed(spark, path, SCHEMA).select("place", "id").collect()))
    assert got == list(enumerate(PLACES))
    shards = indexed.manifest(path)
    assert [s.rows for s in shards] == [67, 67, 66]
    for s in shards:
        data, index = (local(path) / s.name).read_bytes(), (local(path) / f"{s.name}.idx").read_bytes()
        lines = data.split(b"\n")[:-1]
        assert [o for (o,) in struct.iter_unpack("<Q", index)] == [sum(len(x) + 1 for x in lines[:k]) for k in range(s.rows)] and s.size == len(data)
        assert indexed.hashlib.sha256(data).hexdigest() == s.sha256 and indexed.hashlib.sha256(index).hexdigest() == s.index_sha256


@pytest.mark.parametrize("places", [[0], [-1], [199, 0, 66, 67, 133, 134, -200], list(range(0, 200, 7)), list(range(200)), []])
def test_places_from_both_ends(spark, path, places):
    want = sorted({(p % 200, PLACES[p % 200]) for p in places})
    assert sorted((r.place, r.id) for r in indexed.read_indexed(spark, path, SCHEMA, places).collect()) == want
    wanted = spark.createDataFrame([(p,) for p in [*places, *places[:2], None]], "place long")
    assert sorted((r.place, r.id) for r in indexed.fetch(wanted, path, SCHEMA).collect()) == want


def test_places_outside_raise(spark, path):
    for p in (200, -201):
        with pytest.raises(Exception, match="outside"):
            indexed.read_indexed(spark, path, SCHEMA, [p]).collect()
        with pytest.raises(Exception, match="outside"):
            indexed.fetch(spark.createDataFrame([(p,)], "place long"), path, SCHEMA).collect()


def test_only_asked_ranges_are_read(spark, path, monkeypatch):
    # every other line is made unreadable: whoever reads it fails
    monkeypatch.setattr(indexed, "GAP", 0)
    shard = indexed.manifest(path)[1]
    file = local(path) / shard.name
    lines = file.read_bytes().split(b"\n")[:-1]
    file.write_bytes(b"\n".join(x if k in (5, 6, 60) else b"\xff" * len(x) for k, x in enumerate(lines)) + b"\n")
    got = list(indexed.lines_at(path, shard, [5, 6, 60]))
    assert got == [lines[k].decode() for k in (5, 6, 60)]
    with pytest.raises(UnicodeDecodeError):
        list(indexed.lines_at(path, shard, [5, 7]))
    assert list(indexed.ranges([0, 10, 20, 90], [10, 20, 30, 99])) == [(0, 30, [0, 1, 2]), (90, 99, [3])]
    assert len(indexed.read_indexed(spark, path, SCHEMA, [67 + 5, 67 + 60]).collect()) == 2


def test_filters_reach_the_source(spark, path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = indexed.read_indexed(spark, path, SCHEMA)
        assert sorted(r.place for r in got.where("place IN (3, 150, 999) AND id > 0").collect()) == [3, 150]
        assert sorted(r.place for r in got.where("place >= 60 AND place < 70").collect()) == list(range(60, 70))
        assert [r.id for r in got.where("place = 0").collect()] == [0] and got.where("place < 0").count() == 0
        reader = indexed._PushingReader(path, None)
        assert list(reader.pushFilters([indexed.In(("place",), (1, 199)), indexed.EqualTo(("id",), 3)])) == [indexed.EqualTo(("id",), 3)]
        assert [p.listed for p in reader.partitions()] == [(1,), (65,)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_appends_come_after_and_overwrites_replace(spark, path):
    more = spark.createDataFrame([(1000, "a"), (1001, None)], SCHEMA)
    indexed.write_indexed(more, path, 1, ["id"])
    assert [(r.id, r.text) for r in indexed.read_indexed(spark, path, SCHEMA, [-2, -1, 0]).orderBy("place").collect()] == [(0, "é"), (1000, "a"), (1001, None)]
    indexed.write_indexed(more, path, 2, ["id"], mode="overwrite")
    assert indexed.read_indexed(spark, path, SCHEMA).count() == 2
    assert indexed.vacuum(path) == 8 and indexed.read_indexed(spark, path, SCHEMA).count() == 2
    indexed.write_indexed(more.where("id < 0"), path, 2, ["id"], mode="overwrite")
    assert indexed.read_indexed(spark, path, SCHEMA).count() == 0 and indexed.fetch(spark.createDataFrame([], "place long"), path, SCHEMA).count() == 0


def test_a_failed_or_killed_writer_leaves_nothing_to_read(spark, path):
    before = indexed.manifest(path)
    bad = spark.range(0, 100, 1, 2).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("indexed_lines").mode("append").save(path)
    assert indexed.manifest(path) == before
    # killed before its commit: files without a manifest
    writer = indexed._Writer(path, False)
    os.makedirs(local(path) / writer.job)
    (local(path) / writer.job / "00000-x.jsonl").write_text("{}\n")
    assert indexed.manifest(path) == before and indexed.read_indexed(spark, path, SCHEMA).count() == 200
    assert indexed.vacuum(path) >= 1 and indexed.read_indexed(spark, path, SCHEMA).count() == 200
    with pytest.raises(Exception, match="one line"):
        spark.createDataFrame([("a\nb",)], "value string").write.format("indexed_lines").mode("append").save(path)
