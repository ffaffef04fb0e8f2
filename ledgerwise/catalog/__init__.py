"""Registered queries: every operator bound to the test tables, with its SQL twin."""

from __future__ import annotations

from ledgerwise.catalog import (  # noqa: F401
    aggregate_queries,
    filter_queries,
    join_queries,
    metric_queries,
    model_queries,
    order_queries,
    scalar_queries,
    source_queries,
    text_queries,
)
from ledgerwise.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
