"""Loads every module that registers queries."""

from layerlens.plans import (  # noqa: F401
    metric_queries,
    pooling_queries,
    probe_queries,
    source_queries,
    text_queries,
)
from layerlens.plans.registry import QUERIES  # noqa: F401
