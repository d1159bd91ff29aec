"""Queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "retrieval_queries", "store_queries", "stream_queries", "request_queries")


def load():
    """(queries, oracles) of all modules."""
    from .registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(QUERIES), dict(ORACLES)
