"""Registered queries: each pairs a Spark query over the given tables with the SQL that checks it."""

from __future__ import annotations

from caudal.catalog.registry import REGISTRY


def load() -> dict:
    """Import every catalog module once and return the registry."""
    from caudal.catalog import (  # noqa: F401
        compare, exploring, learning, loading, nowcasting, panels, scoring, tracking, validation,
    )

    return REGISTRY
