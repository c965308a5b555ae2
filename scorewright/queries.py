"""All evaluation queries and their SQL."""

from __future__ import annotations

from .plans import citations, descriptive, files, gates, language, preferences, ranks, records, reports, texts, training, vectors  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
