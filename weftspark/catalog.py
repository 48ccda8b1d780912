"""All registered queries of the core library, with their SQL."""

from __future__ import annotations

from weftspark import queries_documents, queries_files, queries_io, queries_layout, queries_memory, queries_placement, queries_terms, queries_text  # noqa: F401  (they register)
from weftspark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
