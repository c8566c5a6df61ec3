"""All queries of the library that a caller can run by name, with SQL twins."""

from __future__ import annotations

from .plans import details, further, indexes, registry, relational, research, trees  # noqa: F401  (plans register themselves)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
