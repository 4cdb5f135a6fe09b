"""Rule conditions as boolean columns.

A condition is ``{"column", "operator", "value"}`` with operator equals, gt,
gte, lt or lte; a group is ``{"mode": "all"|"any", "conditions": [...]}``.
Numeric comparison reads text as a number; unreadable text is simply false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns, need_some
from loomtable.functions.values import number_of, text_of

_COMPARE = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def condition(df: DataFrame, spec: dict) -> Column:
    if "conditions" in spec:
        parts = [condition(df, c) for c in spec["conditions"]]
        need_some(parts, "condition")
        joiner = {"all": Column.__and__, "any": Column.__or__}.get(spec["mode"])
        if joiner is None:
            raise ValueError(f"unknown group mode {spec['mode']!r}")
        return reduce(joiner, parts)
    need_columns(df, [spec["column"]])
    op, value = spec["operator"], spec["value"]
    if op == "equals":
        test = text_of(df, spec["column"]) == F.lit(str(value))
    elif op in _COMPARE:
        test = _COMPARE[op](number_of(df, spec["column"]), F.lit(float(value)))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(test, F.lit(False))
