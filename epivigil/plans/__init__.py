"""Registered queries, grouped as in the operator inventory."""

import importlib

from .registry import QUERIES, SQL

_MODULES = ["sources", "scalars", "weeks", "panels", "cases", "forecasting", "scoring", "states", "warning", "calibrating", "asof", "space", "streams"]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}_queries")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
