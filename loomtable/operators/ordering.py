"""Sorting, top rows, distinct rows, key deduplication and appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import fresh_name, need_columns, need_distinct, need_some
from loomtable.functions.values import text_of
from loomtable.operators.windows import order_names, sort_columns
from loomtable.registry import operator


@operator("sort_rows")
def sort_rows(df: DataFrame, sorts: list[dict]) -> DataFrame:
    """Nulls come first in both directions."""
    need_some(sorts, "sort column")
    need_columns(df, order_names(sorts))
    return df.orderBy(*sort_columns(sorts))


@operator("top_n")
def top_n(df: DataFrame, sorts: list[dict], n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be positive")
    return sort_rows(df, sorts).limit(n)


def keep_one_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row of each key.  The rank filter is applied before the shuffle as
    well, so each task sends one row per key however many copies it holds."""
    rank = fresh_name(df.columns, "__rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def _reverse(order_by: list) -> list[dict]:
    plain = [{"column": o} if isinstance(o, str) else dict(o) for o in order_by]
    return [{**o, "descending": not o.get("descending", False)} for o in plain]


@operator("distinct_rows")
def distinct_rows(df: DataFrame, subset: list[str] | None = None, keep: str = "first",
                  row_order: list | None = None) -> DataFrame:
    """One row per distinct value of ``subset`` (whole rows without one).
    ``row_order`` is the unique order that says which row is first."""
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep {keep!r}")
    if not subset:
        return df.dropDuplicates()
    need_columns(df, subset)
    need_distinct(subset, "subset column")
    need_some(row_order, "row order column")
    need_columns(df, order_names(row_order))
    order = row_order if keep == "first" else _reverse(row_order)
    return keep_one_per_key(df, [F.col(f"`{c}`") for c in subset], sort_columns(order))


@operator("deduplicate_by_key")
def deduplicate_by_key(df: DataFrame, keys: list[str], order_by: list[dict] | None = None,
                       keep: str = "first", row_order: list | None = None,
                       compare_as_text: bool = True) -> DataFrame:
    """Order columns compare as text with null lowest; ``row_order`` breaks ties."""
    need_some(keys, "key")
    need_columns(df, keys)
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep {keep!r}")
    specs = [{**o, "text": compare_as_text} for o in (order_by or [])]
    specs += [{"column": n} if isinstance(n, str) else n for n in (row_order or [])]
    need_some(specs, "order column")
    need_columns(df, [o["column"] for o in specs])
    order = []
    for o in specs:
        c = text_of(df, o["column"]) if o.get("text") else F.col(f"`{o['column']}`")
        down = (o.get("direction") == "desc" or o.get("descending", False)) != (keep == "last")
        order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return keep_one_per_key(df, [F.col(f"`{k}`") for k in keys], order)


@operator("append_tables")
def append_tables(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Same column set; the bottom table is aligned by name."""
    if set(top.columns) != set(bottom.columns):
        raise ValueError("the tables do not have the same columns")
    return top.unionByName(bottom)
