"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before it kept. Stages but the last
return the columns of ``documents``. Null and repeated rows: a document without
an id is known by a hash of its text; equal rows count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import decontaminate, language_id, line_dedup, near_dup, packing
from sieveworks.llm.common import free, stored, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents with a language; rejects texts without letters and those that fit no learned language.

    Documents without a language get the predicted one. Where no document has a
    language nothing is learned, and nothing fits.
    """
    own = free(docs, "_language")
    judged = language_id.judged(docs, language_id.fit(docs), "text", own).where(F.col(own)["fits"])
    return judged.withColumn("lang", F.coalesce("lang", F.col(own)["lang_pred"])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that occur earlier; documents of which nothing is left go."""
    added = tuple(free(docs, name) for name in ("_lines", "_repeated", "_near"))
    out = line_dedup.dedup_lines(docs, added=added)
    cut = F.col(added[1]) + F.col(added[2]) > 0
    out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~cut | (F.trim("text") != "")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (5-word shingles, 0.8)."""
    row = free(docs, "_row")
    keyed = docs.withColumn(row, near_dup.row_key("doc_id", "text"))
    kept = near_dup.near_duplicates(keyed, size=5, percent=80, id_col=row).where("kept").select(row).distinct()
    return keyed.join(kept, row, "left_semi").dropDuplicates([row, "text"]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to edits."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents' pieces in sequences of at most 2048 ids."""
    return packing.pack(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the tokenizer: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
