"""Pinned models: an artifact in a safe format, known by its digest, sent with the job and loaded once a worker.

An artifact is a NumPy archive that is read without pickling: ``slots`` of a
folded count fingerprint have ``weights``, and with a ``bias`` a logistic score.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models of this worker by their digest.
_loaded: dict[str, "Linear"] = {}


class WrongDigest(ValueError):
    """The artifact is not the one that was pinned."""


def digest_of(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


@dataclass
class Linear:
    """A logistic score of counts of characters or pairs, folded to slots."""

    weights: np.ndarray
    bias: float
    width: int

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, bias=np.float64(self.bias), width=np.int64(self.width))
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> "Linear":
        with np.load(io.BytesIO(content), allow_pickle=False) as found:  # refuses pickled objects
            model = cls(np.array(found["weights"], np.float64), float(found["bias"]), int(found["width"]))
        if model.weights.ndim != 1 or not np.isfinite(model.weights).all() or not np.isfinite(model.bias) or model.width < 1:
            raise ValueError("the artifact holds no finite linear model")
        return model

    def grams(self, text: str) -> list[str]:
        return [text[k:k + self.width] for k in range(len(text) - self.width + 1)]

    def __call__(self, texts: list[str | None]) -> list[float | None]:
        size = len(self.weights)
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            slots = [int(hashlib.md5(g.encode("utf-8")).hexdigest()[:8], 16) % size for g in self.grams(text)]
            out.append(float(1 / (1 + np.exp(-np.clip(self.weights[slots].sum() + self.bias, -700, 700)))))
        return out


def _on_worker(name: str, digest: str) -> Linear:
    """The worker's model: the file is read, checked and loaded once."""
    if digest not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            content = f.read()
        if digest_of(content) != digest:
            raise WrongDigest(f"{name} has digest {digest_of(content)}, pinned is {digest}")
        _loaded[digest] = Linear.load(content)
    return _loaded[digest]


@dataclass(frozen=True)
class Pinned:
    """A property's scorer from a file: ``path`` is what Spark's ``addFile`` takes, ``digest`` its SHA-256."""

    prop: str
    path: str
    digest: str

    def scorer(self, spark: SparkSession) -> Callable[[Column], Column]:
        """Checks the file, sends it with the job, and returns the column function; raises before any row is read."""
        if not re.fullmatch("[0-9a-f]{64}", self.digest):
            raise WrongDigest(f"no SHA-256: {self.digest!r}")
        found = spark.read.format("binaryFile").load(self.path).select("content").first()
        if found is None or digest_of(bytes(found[0])) != self.digest:
            raise WrongDigest(f"{self.path} is not the pinned artifact {self.digest}")
        Linear.load(bytes(found[0]))
        spark.sparkContext.addFile(self.path)
        name, digest = os.path.basename(self.path), self.digest

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _on_worker(name, digest)
            for batch in batches:
                yield pd.Series(model(batch.where(batch.notna(), None).tolist()), dtype="float64")

        return score

    def provenance(self, spark: SparkSession) -> DataFrame:
        """``property, source, sha256``."""
        return spark.createDataFrame([(self.prop, os.path.basename(self.path), self.digest)], "property string, source string, sha256 string")


def publish(spark: SparkSession, model: Linear, folder: str, prop: str) -> Pinned:
    """Writes an artifact under a name of its own and pins it."""
    from ..streaming.steps import Files

    content = model.save()
    path = f"{folder.rstrip('/')}/{prop.lower()}-{uuid.uuid4().hex[:8]}.npz"
    files = Files(spark, path)
    stream = files.fs.create(files.path(path), False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return Pinned(prop, path, digest_of(content))
