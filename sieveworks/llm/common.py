"""Helpers that every corpus operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine, as in tests, a
    temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp("-shared")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the cluster's shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("table-"):
            files.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    jvm.System.gc()  # lets the driver's cleaner drop the shuffles that wrote it


def free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z only.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at exactly the
    six ASCII white-space bytes, so neither touches other characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def salt_of(columns: Iterable[str], salts: int):
    """A stable salt in [0, salts) from the given columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")
