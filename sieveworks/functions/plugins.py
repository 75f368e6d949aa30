"""Domain plug-ins: canonical form, properties and similarity of the texts that programs are about.

The engine knows no chemistry. A domain registers Column functions (built-in
expressions or pandas UDFs); the defaults work on any text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors


def plain_canonical(text: Column) -> Column:
    """Trimmed text; the empty string for null."""
    return F.trim(F.coalesce(text, F.lit("")))


def character_pairs(text: Column) -> Column:
    """The set of adjacent character pairs."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


@dataclass
class Domain:
    """What a domain offers; ``sources`` says where each property's scorer comes from."""

    canonical: Callable[[Column], Column] = plain_canonical
    similarity: Callable[[Column, Column], Column] = lambda a, b: vectors.set_similarity(character_pairs(a), character_pairs(b))
    properties: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, scorer: Callable[[Column], Column], source: str = "built in") -> None:
        self.properties[name] = scorer
        self.sources[name] = source

    def score(self, name: str, text: Column) -> Column:
        """A property's finite value, or null where it has no scorer."""
        from .scoring import finite

        return finite(self.properties[name](text)) if name in self.properties else F.lit(None).cast("double")

    def provenance(self, spark) -> DataFrame:
        """``property, source`` of every scorer."""
        return spark.createDataFrame(sorted(self.sources.items()), "property string, source string")


def score_once(rows: DataFrame, column: str, scorer: Callable[[Column], Column], name: str) -> DataFrame:
    """Scores every distinct text once and joins the scores back: for costly scorers over repeated texts."""
    distinct = rows.select(column).distinct().withColumn(name, scorer(F.col(column)))
    return rows.join(distinct, column, "left")


def model_scorer(load: Callable[[], Callable], return_type: str = "double") -> Callable[[Column], Column]:
    """A scorer whose model every worker loads once. Load only files you trust."""
    @F.pandas_udf(return_type)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return score
