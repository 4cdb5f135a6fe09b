"""Name -> callable registry; the extension surface of the library.

An operator takes one or more DataFrames plus keyword specs and returns a
DataFrame.  ``@operator("name")`` adds a user's own function next to ours.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

_OPERATORS: dict[str, Callable] = {}

_MODULES = (
    "loomtable.operators.columns", "loomtable.operators.derive",
    "loomtable.operators.cleaning", "loomtable.operators.filters",
    "loomtable.operators.joins", "loomtable.operators.lookups",
    "loomtable.operators.links", "loomtable.operators.grouping",
    "loomtable.operators.ordering", "loomtable.operators.windows",
    "loomtable.operators.profile", "loomtable.operators.quality",
    "loomtable.operators.statistics", "loomtable.operators.models",
    "loomtable.operators.forecast", "loomtable.operators.business",
    "loomtable.operators.bars", "loomtable.operators.signals",
    "loomtable.operators.decisions", "loomtable.operators.concepts",
    "loomtable.operators.recall", "loomtable.operators.reconcile",
    "loomtable.operators.retrieval",
    "loomtable.operators.capacity", "loomtable.operators.masking",
    "loomtable.operators.reports", "loomtable.plans.multi_table",
    "loomtable.sources.tables", "loomtable.sources.exports",
    "loomtable.sources.prices", "loomtable.sources.statements",
    "loomtable.sources.disclosures", "loomtable.sources.news",
    "loomtable.sources.versions",
)


def operator(name: str) -> Callable[[Callable], Callable]:
    def register(fn: Callable) -> Callable:
        if name in _OPERATORS and _OPERATORS[name] is not fn:
            raise ValueError(f"operator {name!r} is registered twice")
        _OPERATORS[name] = fn
        return fn

    return register


def _load_all() -> None:
    for module in _MODULES:
        importlib.import_module(module)


def get_operator(name: str) -> Callable:
    _load_all()
    if name not in _OPERATORS:
        raise ValueError(f"unknown operator: {name!r}")
    return _OPERATORS[name]


def list_operators() -> list[str]:
    _load_all()
    return sorted(_OPERATORS)
