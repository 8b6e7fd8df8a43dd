"""The registered queries of the library's own operators."""

from __future__ import annotations

from vectrill.plans import registry, store_queries, text_queries, vector_queries  # noqa: F401  (they register themselves)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
