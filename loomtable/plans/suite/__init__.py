"""Registered queries: each runs an operator over whole tables, with the SQL
that states the same result where SQL can."""

from __future__ import annotations

import importlib

from loomtable.plans.suite.base import QUERIES, SQL

MODULES = ("columns", "tables", "joins", "grouping", "windows", "quality", "statistics",
           "business", "prices", "signals",
           "disclosures", "concepts", "capacity")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"loomtable.plans.suite.{m}")
    return QUERIES, SQL
