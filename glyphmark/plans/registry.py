"""All queries of the evaluation engine and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


for _module in ("evaluation", "scalars", "checks", "selection", "inputs", "guards"):
    importlib.import_module(f"glyphmark.plans.{_module}")
