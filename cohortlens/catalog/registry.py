"""Imports every catalog module, so that its queries register, and hands out the two maps."""

from __future__ import annotations

import importlib

from . import tables

MODULES = (
    "metric_queries",
    "detect_queries",
    "evidence_queries",
    "whatif_queries",
    "quality_queries",
    "profile_queries",
    "decision_queries",
    "source_queries",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries():
    _load()
    return dict(tables.QUERIES)


def oracle_sql():
    _load()
    return dict(tables.ORACLES)
