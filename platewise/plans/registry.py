"""Queries over the reference operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "fields", "flows", "images", "observations", "records", "results", "searches", "sky")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"platewise.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
