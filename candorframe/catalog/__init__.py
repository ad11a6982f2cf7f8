"""Registered queries: one per operator, each with the DuckDB text that must give the same rows where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil

from candorframe.catalog.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m != "registry":
        importlib.import_module(f"candorframe.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
