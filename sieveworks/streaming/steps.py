"""Transactional step logs: rows of a step are seen whole and once, or not at all.

A step's rows are written to a folder of the attempt's own. While they are
written, Spark counts them and whatever metrics are asked (``Observation``), so
checks need no second scan; where one fails nothing is committed. The commit is one
small file, renamed into place without overwriting: of two attempts at a step
one wins, a step that is run again appends nothing, and what no commit names
does not exist for readers.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Attempts are folders of a partition column, so that several are read as one table.
ATTEMPT = "_attempt"


class Refused(ValueError):
    """Rows that fail a check; ``metrics`` has what was counted."""

    def __init__(self, failed: Sequence[str], metrics: Mapping):
        super().__init__(f"refused: {', '.join(failed)}; found {dict(metrics)}")
        self.failed, self.metrics = list(failed), dict(metrics)


class Files:
    """File operations of the driver, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def size(self, folder: str) -> int:
        """Bytes of the folder's files, -1 where there is none."""
        return self.fs.getContentSummary(self.path(folder)).getLength() if self.exists(folder) else -1

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def rename_new(self, source: str, target: str) -> bool:
        """Renames unless the target exists; whether it did."""
        hadoop = self.jvm.org.apache.hadoop.fs
        never = self.gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(self.path(source)), self.fs.makeQualified(self.path(target)), never)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


Rule = Callable[[Mapping], bool]


def routability(column: str, nodes: Sequence[str]) -> dict[str, Column]:
    """Metrics of a preflight: rows of each node that a layout routes, and rows that none does."""
    own = F.col(column)
    return {f"rows_{n}": F.count(F.when(own == n, 1)) for n in nodes} | {"unroutable": F.count(F.when(own.isNull() | ~own.isin(*nodes), 1))}


def counted_write(rows: DataFrame, path: str, metrics: Mapping[str, Column] | None = None, partition_by: Sequence[str] = ()) -> dict:
    """Writes Parquet and returns ``rows`` and the metrics, all from the one pass.

    Metrics are aggregates over the rows as they are written, on top of the
    plan: a task that is run again counts once.
    """
    seen = Observation(f"written-{uuid.uuid4().hex}")
    rows.observe(seen, F.count("*").alias("rows"), *(c.alias(name) for name, c in (metrics or {}).items())).write.partitionBy(*partition_by).parquet(path)
    return dict(seen.get)


def checked_write(rows: DataFrame, path: str, metrics: Mapping[str, Column], rules: Mapping[str, Rule]) -> dict:
    """Writes a table that appears only if every rule holds for the metrics; else raises ``Refused`` and leaves nothing."""
    files = Files(rows.sparkSession, path)
    if files.exists(path):
        raise FileExistsError(path)
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    try:
        found = counted_write(rows, draft, metrics)
        failed = [name for name, rule in rules.items() if not rule(found)]
        if failed:
            raise Refused(failed, found)
        if not files.rename_new(draft, path):
            raise FileExistsError(path)
        return found
    finally:
        files.delete(draft)


class StepLog:
    """Steps of rows under one folder: ``data/`` has attempts, ``commits/`` one file for each step that is whole."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str] = ()):
        self.spark, self.root, self.partition_by = spark, path.rstrip("/"), list(partition_by)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, path)

    def _commit(self, step: int) -> str:
        return f"{self.root}/commits/{step:012d}.json"

    def append(self, rows: DataFrame, step: int, metrics: Mapping[str, Column] | None = None, rules: Mapping[str, Rule] | None = None, state: Mapping | None = None) -> bool:
        """Appends a step; False, with nothing done, where it is there already. ``state`` is what resuming needs to know."""
        if self.files.exists(self._commit(step)):
            return False
        folder = f"data/{ATTEMPT}={step:012d}-{uuid.uuid4().hex[:12]}"
        place = f"{self.root}/{folder}"
        kept = False
        try:
            found = counted_write(rows.select(*self.schema.names), place, metrics, self.partition_by)
            failed = [name for name, rule in (rules or {}).items() if not rule(found)]
            if failed:
                raise Refused(failed, found)
            record = {"step": step, "folder": folder, "bytes": self.files.size(place), "metrics": found, "state": state}
            draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
            self.files.write(draft, json.dumps(record, sort_keys=True, default=str))
            self.files.fs.mkdirs(self.files.path(f"{self.root}/commits"))
            kept = self.files.rename_new(draft, self._commit(step))
            if not kept:
                self.files.delete(draft)
            return kept
        finally:
            if not kept:
                self.files.delete(place)

    def steps(self) -> list[dict]:
        """The records of whole steps, in order; a step whose files are not what was committed is not whole."""
        names = [n for n in self.files.names(f"{self.root}/commits") if re.fullmatch(r"\d{12}\.json", n)]
        found = [json.loads(self.files.read(f"{self.root}/commits/{n}")) for n in names]
        return [r for r in found if self.files.size(f"{self.root}/{r['folder']}") == r["bytes"]]

    def listing(self) -> DataFrame:
        """``step, rows`` of whole steps."""
        return self.spark.createDataFrame([(r["step"], r["metrics"]["rows"]) for r in self.steps()], "step long, rows long")

    def newest(self) -> dict | None:
        """The record to resume from."""
        found = self.steps()
        return found[-1] if found else None

    def read(self, until: int | None = None, since: int | None = None) -> DataFrame:
        """Rows of whole steps, from one and up to one."""
        inside = lambda step: (until is None or step <= until) and (since is None or step >= since)
        folders = [f"{self.root}/{r['folder']}" for r in self.steps() if inside(r["step"]) and r["metrics"]["rows"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField(ATTEMPT, T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*folders).select(*self.schema.names)

    def sink(self, metrics: Mapping[str, Column] | None = None, rules: Mapping[str, Rule] | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: each batch is a step, appended once however often it is run."""
        return lambda batch, number: self.append(batch, number, metrics, rules) and None

    def clean(self) -> int:
        """Deletes attempts and drafts that no commit names; not while a step is written. Returns their number."""
        named = {json.loads(self.files.read(f"{self.root}/commits/{n}"))["folder"] for n in self.files.names(f"{self.root}/commits") if n.endswith(".json")}
        gone = [f"data/{n}" for n in self.files.names(f"{self.root}/data") if f"data/{n}" not in named] + [f"drafts/{n}" for n in self.files.names(f"{self.root}/drafts")]
        for name in gone:
            self.files.delete(f"{self.root}/{name}")
        return len(gone)
