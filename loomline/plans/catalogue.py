"""All registered queries over the fixture tables."""

from __future__ import annotations

from . import admission, enrichment, extraction, fields, linkage, monitoring, operations, pages, payloads, products, records, selection, streams, trees, urls  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
