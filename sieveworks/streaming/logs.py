"""Append logs: resuming, incremental first-seen rows, running totals and bounded top-k over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def remaining(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests that the log lacks."""
    return requests.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def verified_prefix(requests: DataFrame, done: DataFrame, place: str, columns: Sequence[str]) -> DataFrame:
    """One row: how many places are done, whether they are the first ones and agree with the requests."""
    joined = requests.select(place, *columns).join(done.select(place, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_done")), place, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = F.count("_done")
    return joined.agg(n.alias("done"), ((n == 0) | ((F.max(F.when(F.col("_done"), F.col(place))) == n - 1) & F.coalesce(F.bool_and(F.when(F.col("_done"), same)), F.lit(True)))).alias("is_prefix"))


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of an append log as a stream."""
    return spark.readStream.schema(schema).json(path)


def totals_stream(log: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running counts and sums of a log stream (for complete or update mode)."""
    return log.groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(v).alias(f"{v}_total") for v in values))


def first_seen_stream(log: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before; with a time column the remembered keys are bounded by ``late``."""
    if time is None:
        return log.dropDuplicates([key])
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def top_k_sink(spark: SparkSession, table: str, bucket: str, order: Sequence[str], k: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps each bucket's first ``k`` rows in a stored table.

    The table is written under a new version for each batch, so a batch that is
    run again gives the same table.
    """
    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0 and (before := last_version(spark, table, number)) is not None:
            rows = spark.read.parquet(before).unionByName(batch)
        rank = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
        rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r").write.mode("overwrite").parquet(f"{table}/version={number}")

    return merge


def last_version(spark: SparkSession, table: str, before: int | None = None) -> str | None:
    """Path of the newest version (older than ``before``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    found = [n for n in found if before is None or n < before]
    return f"{table}/version={max(found)}" if found else None


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there now through the sink, resuming from the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to JSON files, each row once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
