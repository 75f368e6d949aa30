"""Keyed state in the state store: bounded top-k and first-seen rows over streams.

Both need Spark's RocksDB state store (``with_rocksdb``). State is checkpointed
with the stream: after a restart or a lost executor it goes on from the last batch.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .steps import StepLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task holds while it cuts buckets, beyond which it sends them on.
HELD = 100_000
#: Folders of the store of seen keys: a batch reads those of its own keys.
STORE_BUCKETS = 256


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _before(columns: Sequence[str]) -> Callable[[dict], tuple]:
    """Sort key of a row: nulls first."""
    return lambda row: tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in columns)


def _cut(rows: DataFrame, bucket: str, order: Sequence[str], k: int) -> DataFrame:
    """Rows less those that ``k`` rows of the same task and bucket come before: what is sent over the network, not the result."""
    key = _before(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[dict]] = {}
        n, schema = 0, None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                own = held.setdefault(row[bucket], [])
                own.append(row)
                n += 1
                if len(own) >= 4 * k:
                    n -= len(own)
                    own[:] = heapq.nsmallest(k, own, key)
                    n += len(own)
            if n > HELD:
                yield pa.RecordBatch.from_pylist([r for own in held.values() for r in heapq.nsmallest(k, own, key)], schema)
                held, n = {}, 0
        if n:
            yield pa.RecordBatch.from_pylist([r for own in held.values() for r in heapq.nsmallest(k, own, key)], schema)

    return rows.mapInArrow(cut, rows.schema)


class _TopK(StatefulProcessor):
    def __init__(self, schema: str, order: list[str], names: list[str], k: int):
        self.schema, self.order, self.names, self.k = schema, order, names, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [dict(zip(self.names, tuple(r))) for r in self.kept.get()] if self.kept.exists() else []
        order = _before(self.order)
        # never more than twice k rows at once
        now = heapq.nsmallest(self.k, [*before, *heapq.nsmallest(self.k, (r.asDict() for r in rows), order)], order)
        plain = lambda r: tuple(r[c] for c in self.names)
        self.kept.put([plain(r) for r in now])
        old, new = [plain(r) for r in before], [plain(r) for r in now]
        for r in list(new):
            if r in old:
                old.remove(r)
                new.remove(r)
        out = Row(*self.names, "change")
        for r, change in (*((r, -1) for r in old), *((r, 1) for r in new)):
            yield out(*r, change)


def top_k_changes(stream: DataFrame, bucket: str, order: Sequence[str], k: int) -> DataFrame:
    """What enters (1) and leaves (-1) each bucket's first ``k`` rows, as column ``change``.

    The state of a bucket is its ``k`` rows, whatever has passed. Rows that tie in ``order`` are
    put in order by their other columns, so the result does not depend on how
    the stream is cut into batches. Each task sends at most ``k`` rows of a
    bucket (and batch) to the state.
    """
    order = [*order, *(c for c in stream.columns if c not in order)]
    schema = T.StructType([*stream.schema.fields, T.StructField("change", T.IntegerType())])
    processor = _TopK(stream.schema.toDDL(), order, stream.columns, k)
    return _cut(stream, bucket, order, k).groupBy(bucket).transformWithState(processor, schema, "Update", "None")


def current(changes: DataFrame) -> DataFrame:
    """The rows that are in, from a log of changes; equal rows as often as they are."""
    names = [c for c in changes.columns if c != "change"]
    left = changes.groupBy(*names).agg(F.sum("change").alias("_left")).where("_left > 0")
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_left").cast("int")))).select(*names)


class _Recent(StatefulProcessor):
    """The keys of late of one bucket, as one value: a batch asks the store once a bucket, not five times a key."""

    def __init__(self, key: str, order: list[str], names: list[str], remember_ms: int):
        self.key, self.order, self.names, self.remember = key, order, names, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timer long, until binary")

    def _held(self, now: int) -> tuple[int | None, dict]:
        if not self.seen.exists():
            return None, {}
        timer, packed = self.seen.get()
        return timer, {k: until for k, until in pickle.loads(bytes(packed)).items() if until >= now}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        timer, held = self._held(now)
        before, until = _before(self.order), now + self.remember
        first: dict[object, dict] = {}
        came = set()
        for r in rows:
            row = r.asDict()
            k = row[self.key]
            came.add(k)
            if k not in held and (k not in first or before(row) < before(first[k])):
                first[k] = row
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.seen.update((until, pickle.dumps({**held, **dict.fromkeys(came, until)})))
        self.handle.registerTimer(until)
        out = Row(*self.names)
        for row in first.values():
            yield out(*(row[c] for c in self.names))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the timer is that of the bucket's last keys: none is younger
        self.seen.clear()
        return iter([])


def _bucket(key: str) -> Column:
    """The bucket of a key, for the state and for the folders of the store."""
    return F.pmod(F.xxhash64(key), F.lit(STORE_BUCKETS)).cast("int")


def not_seen_lately(stream: DataFrame, key: str, order: Sequence[str], remember_ms: int) -> DataFrame:
    """Each batch's first row of every key that did not come in the last ``remember_ms``.

    The state has one value for each of ``STORE_BUCKETS`` buckets, the keys of that time in it, not those of
    the stream; it goes when its timer fires. Rows that tie in ``order`` are put in order by their other columns.
    """
    order = [*order, *(c for c in stream.columns if c not in order)]
    dealt = stream.withColumn("_dealt", _bucket(key))
    return dealt.groupBy("_dealt").transformWithState(_Recent(key, order, stream.columns, remember_ms), stream.schema, "Update", "ProcessingTime")


class FirstSeen:
    """First-seen rows of a stream, exactly, with bounded state.

    Keys of late are answered by the state; the rest is looked up in the store, the
    rows found so far, which lies in folders by the hash of the key, so that a batch
    reads the folders of its own keys only. The store is a step log: a batch that is run
    again is compared with the steps before it and appended once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.key = key
        self.store = StepLog(spark, path, T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())]), ["_bucket"])

    def sink(self) -> Callable[[DataFrame, int], None]:
        def merge(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            bucketed = batch.withColumn("_bucket", _bucket(self.key))
            # the state is asked once; the store is asked for what it let through
            draft = StepLog(spark, f"{self.store.root}/passed", self.store.schema)
            draft.append(bucketed, number)
            passed = draft.read(number, number)
            buckets = [r[0] for r in passed.select("_bucket").distinct().collect()]  # at most STORE_BUCKETS numbers
            known = self.store.read(number - 1).where(F.col("_bucket").isin(buckets) if buckets else F.lit(False)).select(self.key)
            new = passed.join(known, passed[self.key].eqNullSafe(known[self.key]), "left_anti")
            # a bucket is written by one task: a file for each, not one for each task and bucket
            self.store.append(new.repartition("_bucket"), number)

        return merge

    def rows(self) -> DataFrame:
        """All rows that were the first of their key."""
        return self.store.read().drop("_bucket")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", seconds: int = 600) -> StreamingQuery:
    """Runs what is there through the sink and waits; raises what the stream raised.

    Batches without data are off: with timers in processing time Spark would run them without end.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # a query keeps the settings that it starts with
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination(seconds)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the stream took over {seconds} seconds")
    return query
