"""Registered queries, one module per survey section."""

from __future__ import annotations

import importlib

from scoreloom.plans.catalog import CATALOG, Query

_MODULES = (
    "rollout_queries",
    "metric_queries",
    "join_queries",
    "sampling_queries",
    "prep_queries",
    "score_queries",
    "packing_queries",
    "corpus_queries",
    "source_queries",
    "stream_queries",
)


def load_catalog() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"scoreloom.plans.{module}")
    return CATALOG
