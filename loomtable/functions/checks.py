"""Plan-time checks.  They read only the schema, so no job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def need_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(map(repr, missing))}")


def need_some(items, what: str) -> None:
    if not items:
        raise ValueError(f"at least one {what} is needed")


def need_distinct(names: Iterable[str], what: str) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise ValueError(f"{what} {n!r} is given twice")
        seen.add(n)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), NUMERIC_TYPES)


def need_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    need_columns(df, names)
    for n in names:
        if not is_numeric(df, n):
            raise ValueError(f"column {n!r} is not numeric")


def fresh_name(taken: Iterable[str], stem: str) -> str:
    taken, name = set(taken), stem
    while name in taken:
        name += "_"
    return name
