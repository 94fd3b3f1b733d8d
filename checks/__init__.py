"""Queries over the test tables, each next to the SQL that must give the same rows."""

from __future__ import annotations


def all_queries():
    import importlib

    for part in ("cells", "shapes", "events", "whole", "stores"):
        importlib.import_module(f"checks.{part}")
    from checks.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
