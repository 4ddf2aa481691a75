"""Registered queries, each beside its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("pit", "joins", "aggregates", "windows", "audit", "text", "identity", "simulation", "statistics", "sources", "scans", "identity_rules", "supporting", "filings")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
