"""A cache of scores that outlives a run: costly scorers see a text once, in whatever run it first comes.

The cache is a table in folders by the hash of the text. A run reads the folders of its
own texts, scores what they lack, and writes those folders anew with the run's
number as last use; a version file, renamed into place, names the folder of each
hash that counts. So a run is in the cache whole or not at all, and a run that is
repeated changes nothing. Each hash keeps its ``capacity / BUCKETS`` entries of latest use.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import new_folder
from ..streaming.steps import ATTEMPT, Files, counted_write

BUCKETS = 64
SCHEMA = "text string, score double, last_use long"


class ScoreCache:
    """Scores of one scorer under one folder; ``capacity`` is the number of entries it may keep."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = 200_000):
        self.spark, self.root, self.each = spark, path.rstrip("/"), max(1, -(-capacity // BUCKETS))
        self.files = Files(spark, path)

    def version(self) -> dict:
        """The newest version: ``run``, and ``folders`` by hash."""
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.root}/versions/{names[-1]}")) if names else {"run": 0, "folders": {}}

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """``text, score, last_use, _bucket`` of all entries or those of some hashes."""
        schema = T.StructType([*T.StructType.fromDDL(SCHEMA).fields, T.StructField("_bucket", T.IntegerType()), T.StructField(ATTEMPT, T.StringType())])
        found = [f"{self.root}/data/{folder}/_bucket={b}" for b, folder in self.version()["folders"].items() if buckets is None or int(b) in buckets]
        if not found:
            return self.spark.createDataFrame([], schema).drop(ATTEMPT)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*found).drop(ATTEMPT)

    def score(self, rows: DataFrame, column: str, scorer: Callable[[Column], Column], name: str = "score") -> tuple[DataFrame, dict]:
        """The rows with their scores, and how many distinct texts were ``wanted`` and ``scored`` anew.

        A null text has no score. A text that the scorer gives no score is kept as such and not tried again.
        """
        run = self.version()["run"] + 1
        bucket = F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int")
        wanted = rows.select(F.col(column).cast("string").alias("text")).where("text IS NOT NULL").distinct().withColumn("_bucket", bucket)
        buckets = [r[0] for r in wanted.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
        kept = self.entries(buckets)
        cached = kept.select("text", F.col("score").alias("_known"), F.lit(True).alias("_hit"))
        found = wanted.join(cached, "text", "left")
        # hits and misses apart: the scorer sees misses only, and once
        hits = found.where("_hit").select("text", F.col("_known").alias("score"), "_bucket")
        misses = found.where("_hit IS NULL").select("text", scorer(F.col("text")).cast("double").alias("score"), "_bucket")
        path = new_folder(self.spark, "scored")
        counts = counted_write(hits.withColumn("_new", F.lit(0)).unionByName(misses.withColumn("_new", F.lit(1))), path, {"scored": F.sum("_new")})
        scored = self.spark.read.parquet(path).drop("_new")
        if counts["rows"]:
            used = scored.withColumn("last_use", F.lit(run).cast("long"))
            others = kept.join(scored.select("text"), "text", "left_anti").select("text", "score", "_bucket", "last_use")
            rank = F.row_number().over(W.partitionBy("_bucket").orderBy(F.desc("last_use"), F.xxhash64("text"), "text"))
            entries = used.unionByName(others).withColumn("_r", rank).where(F.col("_r") <= self.each).drop("_r")
            folder = f"{ATTEMPT}={run:08d}-{uuid.uuid4().hex[:12]}"
            entries.write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
            folders = self.version()["folders"] | {str(b): folder for b in buckets}
            draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
            self.files.write(draft, json.dumps({"run": run, "folders": folders}))
            self.files.fs.mkdirs(self.files.path(f"{self.root}/versions"))
            if not self.files.rename_new(draft, f"{self.root}/versions/{run:08d}.json"):
                self.files.delete(f"{self.root}/data/{folder}")  # another run was faster; its version stands
        out = rows.join(scored.select(F.col("text").alias("_text"), F.col("score").alias(name)), rows[column].cast("string") == F.col("_text"), "left").drop("_text")
        return out, {"wanted": counts["rows"], "scored": counts["scored"] or 0}
