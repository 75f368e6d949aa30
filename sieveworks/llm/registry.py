"""All queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, hard_negatives, html_extract, language_id, line_dedup, lm_score, near_dup, neighbours, packing, secret_scan, spelling, url_filter

MODULES = (html_extract, packing, line_dedup, neighbours, decontaminate, language_id, lm_score, secret_scan, url_filter, near_dup, chat_format, hard_negatives, spelling)


def queries() -> dict:
    """Name to callable(spark, sf_dir)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
