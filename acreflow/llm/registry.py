"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_bpe", "q_counts", "q_decontaminate", "q_importance", "q_licenses", "q_media", "q_mixing", "q_periodic", "q_pii", "q_quality", "q_secrets", "q_simhash", "q_urls")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"acreflow.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
