"""Indexed shards: lines of text with byte-offset sidecars, as a data source of Spark's Python API.

A table is a folder. Shards are files of lines, each with a sidecar of the
lines' byte offsets (little-endian 64-bit). ``MANIFEST`` lists the shards with
their rows, bytes and SHA-256; what it does not list does not exist. A task writes
its shard into a folder of the job's own; the commit lists all of them by renaming
one manifest into place, so a job is seen whole or not at all, and a killed
job leaves files that nobody reads and ``vacuum`` deletes.

A row's ``place`` counts from 0 over the shards in the manifest's order. Readers
look up the shard by bisection over the shards' first places, take the offsets
from the sidecar and read the asked ranges only:

- ``spark.read.format("indexed_lines").load(path)`` is the whole table; with option
  ``pushdown``, which ``read_indexed`` sets where
  ``spark.sql.python.filterPushdown.enabled`` is on, comparisons of ``place`` with
  values reach the source,
- option ``places``: a list like ``0,17,-1``; negative places count from the end,
  places outside the table raise, repeated ones count once,
- ``fetch``: the places are a column of a DataFrame of any size.

Paths are what ``pyarrow.fs`` opens (local or mounted folders, ``hdfs://``,
``s3://``, ``gs://``), on executors too.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan, WriterCommitMessage

from .tables import sorted_columns

MANIFEST = "_manifest.json"
#: Rows of a read task, and of an Arrow batch.
ROWS_PER_TASK, BATCH = 250_000, 4096
#: Ranges of a shard with at most this many bytes between them are read at once.
GAP = 1 << 16
#: Shard bytes that are read at once; a longer line is read whole.
READ = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    size: int
    sha256: str
    index_sha256: str


def manifest(path: str) -> list[Shard]:
    """The shards that the table consists of, none if there is no table."""
    store, folder = opened(path)
    name = posixpath.join(folder, MANIFEST)
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(name) as f:
        return [Shard(**s) for s in json.loads(f.read())["shards"]]


def _publish(path: str, shards: Sequence[Shard]) -> None:
    """Makes these the table's shards, at once."""
    store, folder = opened(path)
    draft = posixpath.join(folder, f"{MANIFEST}.{uuid.uuid4().hex}")
    with store.open_output_stream(draft) as f:
        f.write(json.dumps({"rows": sum(s.rows for s in shards), "shards": [vars(s) for s in shards]}, indent=1, sort_keys=True).encode())
    store.move(draft, posixpath.join(folder, MANIFEST))


def vacuum(path: str) -> int:
    """Deletes what no manifest lists; not while a job writes. Returns the number of files."""
    store, folder = opened(path)
    kept = {MANIFEST} | {name for s in manifest(path) for name in (s.name, f"{s.name}.idx")}
    gone = 0
    for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and posixpath.relpath(info.path, folder) not in kept:
            store.delete_file(info.path)
            gone += 1
    return gone


@dataclass
class _Written(WriterCommitMessage):
    part: int
    shard: Shard | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = opened(self.path)
        # each attempt has a file of its own; the commit lists one of them
        name = f"{self.job}/{part:05d}-{uuid.uuid4().hex[:8]}.jsonl"
        store.create_dir(posixpath.join(folder, self.job), recursive=True)
        data, index, at, rows = hashlib.sha256(), hashlib.sha256(), 0, 0
        with store.open_output_stream(posixpath.join(folder, name)) as lines, store.open_output_stream(posixpath.join(folder, f"{name}.idx")) as offsets:
            for batch in iterator:
                for text in batch.column(batch.schema.get_field_index("value")).to_pylist():
                    line = (text or "").encode("utf-8")
                    if b"\n" in line:
                        raise ValueError("a row of indexed lines must be one line")
                    where = struct.pack("<Q", at)
                    lines.write(line + b"\n")
                    offsets.write(where)
                    data.update(line + b"\n")
                    index.update(where)
                    at, rows = at + len(line) + 1, rows + 1
        return _Written(part, Shard(name, rows, at, data.hexdigest(), index.hexdigest()) if rows else None)

    def commit(self, messages) -> None:
        new = [m.shard for m in sorted((m for m in messages if m is not None), key=lambda m: m.part) if m.shard is not None]
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        _publish(self.path, new if self.overwrite else manifest(self.path) + new)

    def abort(self, messages) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(posixpath.join(folder, self.job)).type != fs.FileType.NotFound:
            store.delete_dir(posixpath.join(folder, self.job))


@dataclass
class Asked(InputPartition):
    """Places inside one shard: all of [start, end), or those listed."""

    shard: Shard
    first: int
    start: int
    end: int
    listed: tuple[int, ...] | None = None


def ranges(offsets: Sequence[int], ends: Sequence[int]) -> Iterator[tuple[int, int, list[int]]]:
    """Byte ranges that hold the asked lines, near ones as one, and which lines each holds."""
    held: list[int] = []
    for k in range(len(offsets)):
        if held and (offsets[k] - ends[held[-1]] > GAP or ends[k] - offsets[held[0]] > READ):
            yield offsets[held[0]], ends[held[-1]], held
            held = []
        held.append(k)
    if held:
        yield offsets[held[0]], ends[held[-1]], held


def lines_at(path: str, shard: Shard, places: Sequence[int]) -> Iterator[str]:
    """The lines of a shard at ascending places, by their offsets."""
    store, folder = opened(path)
    with store.open_input_file(posixpath.join(folder, f"{shard.name}.idx")) as index, store.open_input_file(posixpath.join(folder, shard.name)) as lines:
        for at in range(0, len(places), 1 << 16):
            some = places[at:at + (1 << 16)]
            dense = some[-1] - some[0] < 4 * len(some)
            # of dense places the whole stretch of offsets, else each place's own and the next one's
            got = struct.unpack(f"<{(n := min(some[-1] + 2, shard.rows) - some[0])}Q", index.read_at(8 * n, 8 * some[0])) if dense else None
            starts, ends = [], []
            for p in some:
                pair = got[p - some[0]:p - some[0] + 2] if dense else struct.unpack(f"<{min(2, shard.rows - p)}Q", index.read_at(8 * min(2, shard.rows - p), 8 * p))
                starts.append(pair[0])
                ends.append(pair[1] if len(pair) > 1 else shard.size)
            for begin, end, held in ranges(starts, ends):
                block = lines.read_at(end - begin, begin)
                for k in held:
                    yield block[starts[k] - begin:ends[k] - begin - 1].decode("utf-8")


class _Reader(DataSourceReader):
    def __init__(self, path: str, places: str | None):
        self.path, self.shards = path, manifest(path)
        self.firsts = [0]
        for s in self.shards:
            self.firsts.append(self.firsts[-1] + s.rows)
        self.listed = None if places is None else sorted({self._inside(int(p)) for p in places.split(",") if p.strip()})
        self.low, self.high = 0, self.firsts[-1]

    def _inside(self, place: int) -> int:
        own = place + self.firsts[-1] if place < 0 else place
        if not 0 <= own < self.firsts[-1]:
            raise IndexError(f"place {place} is outside the table of {self.firsts[-1]} rows")
        return own

    def partitions(self) -> list[Asked]:
        out = []
        for k, shard in enumerate(self.shards):
            first, end = self.firsts[k], self.firsts[k + 1]
            if self.listed is not None:
                own = [p - first for p in self.listed[bisect.bisect_left(self.listed, max(first, self.low)):bisect.bisect_left(self.listed, min(end, self.high))]]
                out += [Asked(shard, first, 0, 0, tuple(own[at:at + ROWS_PER_TASK])) for at in range(0, len(own), ROWS_PER_TASK)]
            else:
                low, high = max(0, self.low - first), min(shard.rows, self.high - first)
                out += [Asked(shard, first, at, min(at + ROWS_PER_TASK, high)) for at in range(low, high, ROWS_PER_TASK)]
        return out

    def read(self, partition: Asked | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty table
            return
        places = partition.listed if partition.listed is not None else range(partition.start, partition.end)
        yield from _batched(((partition.first + p, line) for p, line in zip(places, lines_at(self.path, partition.shard, places))), ["place", "value"])


class _PushingReader(_Reader):
    """Takes comparisons of ``place`` with values; Spark refuses such a reader where filter pushdown is off."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("place",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                found = {p for p in wanted if isinstance(p, int) and 0 <= p < self.firsts[-1]}
                self.listed = sorted(found if self.listed is None else found & set(self.listed))
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            else:
                yield f


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1])
        if len(held) >= BATCH or chars >= READ:
            yield _batch(held, names)
            held, chars = [], 0
    if held:
        yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=names)


class IndexedLines(DataSource):
    """``place long, value string``; options ``path``, ``places``, and ``pushdown`` where Spark's setting for it is on."""

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "place long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], self.options.get("places"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_indexed(rows: DataFrame, path: str, shards: int, order: Sequence[str], mode: str = "append") -> None:
    """Rows as JSON lines with sorted keys, dealt in turn to the shards by their place in order.

    ``mode`` is ``append`` or ``overwrite``; readers of the old table are not disturbed until ``vacuum``.
    """
    from ..operators.selection import global_place

    rows.sparkSession.dataSource.register(IndexedLines)
    place, shard, value = (_free(rows, name) for name in ("_place", "_shard", "value"))
    dealt = global_place(rows.select(F.to_json(F.struct(*sorted_columns(rows).columns), {"ignoreNullFields": "false"}).alias(value), *order), list(order), place)
    dealt = dealt.withColumn(shard, (F.col(place) % shards).cast("int")).select(F.col(value).alias("value"), place, shard)
    # a range of shard numbers is a partition: shards keep their order
    dealt.repartitionByRange(shards, shard).sortWithinPartitions(shard, place).select("value").write.format("indexed_lines").mode(mode).save(path)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_indexed(spark: SparkSession, path: str, schema: T.StructType | str, places: Sequence[int] | None = None) -> DataFrame:
    """``place`` and the lines' fields; all rows, or those at the places."""
    spark.dataSource.register(IndexedLines)
    reader = spark.read.format("indexed_lines").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if places is not None:
        reader = reader.option("places", ",".join(map(str, places)))
    return reader.load(path).select("place", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("place", "r.*")


def fetch(wanted: DataFrame, path: str, schema: T.StructType | str, place_col: str = "place") -> DataFrame:
    """The rows at the distinct places of a column, however many: ``place`` and the lines' fields.

    Places are dealt by stretches of their shard, so a task reads one stretch of
    one file in order. Negative places count from the end, null ones are left
    out, and places outside the table raise.
    """
    shards = manifest(path)
    firsts = [0]
    for s in shards:
        firsts.append(firsts[-1] + s.rows)
    total = firsts[-1]
    asked = wanted.select(F.col(place_col).cast("long").alias("place")).where("place IS NOT NULL")
    own = F.when(F.col("place") < 0, F.col("place") + total).otherwise(F.col("place"))
    inside = F.when((own >= 0) & (own < total), own).otherwise(F.raise_error(F.concat(F.lit("outside the table: place "), F.col("place").cast("string"))).cast("long"))
    tasks = max(1, -(-total // ROWS_PER_TASK))
    dealt = asked.select(inside.alias("place")).distinct().repartitionByRange(tasks, "place").sortWithinPartitions("place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            at = 0
            while at < len(places):
                k = bisect.bisect_right(firsts, places[at]) - 1
                to = bisect.bisect_left(places, firsts[k + 1], at)
                local = [p - firsts[k] for p in places[at:to]]
                yield from _batched(zip(places[at:to], lines_at(path, shards[k], local)), ["place", "value"])
                at = to

    lines = dealt.mapInArrow(read, "place long, value string")
    return lines.select("place", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("place", "r.*")
