"""Named queries; ``load`` imports every module that registers some."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import CORE, Registry

MODULES = ("pipeline_queries", "run_queries", "event_queries", "partition_queries", "graph_queries", "table_queries", "control_queries", "condition_queries", "stream_queries", "asset_queries")


def load() -> Registry:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    return CORE
