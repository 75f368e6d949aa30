"""The library's registered queries and their SQL equivalents."""

from __future__ import annotations

from . import artifacts, evaluation, gates, programs, records, selection, storage

FLAGSHIP = "balanced_clean_selection"
MODULES = (selection, evaluation, programs, records, storage, artifacts, gates)


def queries() -> dict:
    """Name to callable(spark, sf_dir)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in m.SQL.items()}
