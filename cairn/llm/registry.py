"""The corpus queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: The modules of the operators, each with QUERIES and ORACLES.
MODULES = ("jaccard", "bpe", "language", "private", "fingerprint", "toxicity", "mixing", "license", "quality", "embeddings", "infill", "codes", "search")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"cairn.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
