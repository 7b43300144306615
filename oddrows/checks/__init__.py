"""Registered queries: importing the modules fills the registry."""

from __future__ import annotations

import importlib

from oddrows.checks.base import QUERIES, SQL

MODULES = ("tables", "features", "profile", "joins", "sampling", "metrics", "neighbors", "models", "studies")


def _load():
    for name in MODULES:
        importlib.import_module(f"oddrows.checks.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
