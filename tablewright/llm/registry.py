"""Queries of this package, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ["embedding_caps", "secret_index", "url_rules", "page_wrappers", "signature_join", "toxic_lexicon", "wavelet", "transducer", "decontaminate", "token_counts", "conversations", "divergence", "packing"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load():
    """Import every operator module and return (queries, oracle SQL)."""
    for name in MODULES:
        import_module(f"tablewright.llm.{name}")
    return QUERIES, ORACLES
