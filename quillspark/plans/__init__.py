"""Named queries over the driver's tables, with their SQL forms."""

from __future__ import annotations

from quillspark.plans import analysis, bundles, checks, compare, images, invariants, more, records, registry, strokes, tables, training


def all_queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    return dict(registry.SQL)


__all__ = ["all_queries", "all_sql", "analysis", "bundles", "checks", "compare", "images", "invariants", "more", "records", "registry", "strokes", "tables", "training"]
