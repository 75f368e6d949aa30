"""Readers and writers: JSON lines, CSV, documents, tables with places, manifests, markers and logs."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp("-shared")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, allow_empty: bool = True) -> DataFrame:
    """JSON lines under a fixed schema from files or folders of any depth; malformed lines raise, blank ones are skipped."""
    out = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(paths if isinstance(paths, str) else list(paths))
    if not allow_empty and out.isEmpty():
        raise ValueError(f"no rows in {paths}")
    return out


def read_json_objects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with their place; a line that is no object raises and is named."""
    rows = with_place(spark.read.text(path)).where(F.trim("value") != "")
    ok = F.trim("value").startswith("{")
    text = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no object in line "), (F.col("place") + 1).cast("string"))).cast("string"))
    return rows.select("place", F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("place", "r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every value is text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON document or array as rows."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Each file by its suffix: ``.jsonl`` as JSON lines, others as CSV; columns are matched by name."""
    frames = [read_json_lines(spark, p, schema) if p.endswith(".jsonl") else read_csv(spark, p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_place(df: DataFrame, place_col: str = "place") -> DataFrame:
    """Adds each row's place in its file's order.

    Partitions of a text scan follow the file; ids within them only grow, so
    counts of the partitions before give the place. One count per partition is
    all that meets in one task.
    """
    from pyspark.sql import Window as W

    rows = checkpointed(df.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", "_first", before.alias("_before")))
    return rows.join(starts, "_part").withColumn(place_col, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")


def lookup_places(table: DataFrame, places: Sequence[int], total: int | None = None, place_col: str = "place") -> DataFrame:
    """Rows at given places, from a stored table whose row groups the filter prunes; negative places count from the end."""
    if any(p < 0 for p in places):
        total = table.count() if total is None else total
        places = [p + total if p < 0 else p for p in places]
    return table.where(F.col(place_col).isin(*places))


def bucket_index(rows: DataFrame, bucket: str, expected: Sequence[str] | None = None) -> DataFrame:
    """Rows of each bucket; raises unless the buckets are exactly the expected ones."""
    out = rows.groupBy(bucket).agg(F.count("*").alias("rows"))
    if expected is not None:
        found = {r[bucket] for r in out.select(bucket).limit(len(expected) + 1).collect()}
        if found != set(expected):
            raise ValueError(f"buckets differ: {sorted(map(str, found ^ set(expected)))[:5]}")
    return out


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An append log, empty if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file: ``path, length, sha256``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with keys in order."""
    sorted_columns(df).write.mode(mode).json(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard", mode: str = "errorifexists") -> DataFrame:
    """JSON lines in one folder per shard, and the digests of the files written."""
    keys = sorted(c for c in df.columns if c != shard)
    df.select(*keys, shard).repartition(shard).write.mode(mode).partitionBy(shard).json(path)
    return file_digests(df.sparkSession, path).where(F.col("path").endswith(".json"))


def write_csv(frames: DataFrame | Sequence[DataFrame], path: str, header: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a fixed header, or the union of all columns in order of appearance."""
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.select(*(header or out.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def manifest_text(rows: DataFrame, limit: int = 10_000) -> str:
    """A small table as JSON text with sorted keys; raises above ``limit`` rows."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError("a manifest holds few rows")
    return json.dumps([r.asDict(True) for r in found], indent=2, sort_keys=True, default=str)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as a Markdown report; numbers with four digits."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError("a report holds few rows")
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in found]) + "\n"


def mark_complete(spark: SparkSession, folder: str, name: str = "_COMPLETE") -> None:
    """Leaves an empty marker in any file system Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder.rstrip('/')}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def is_complete(spark: SparkSession, folder: str, name: str = "_COMPLETE") -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder.rstrip('/')}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def copy_table(spark: SparkSession, source: str, target: str, fmt: str = "text", mode: str = "errorifexists") -> None:
    """A frozen input, line for line, under a new name."""
    spark.read.format(fmt).load(source).write.format(fmt).mode(mode).save(target)
