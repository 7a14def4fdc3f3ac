"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

MODULES = ("decontaminate", "embeddings", "language", "licenses", "minhash", "mixture", "negatives", "phrases", "substrings", "surrogates", "tokens", "warc", "windows")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"platewise.llm.queries_{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
