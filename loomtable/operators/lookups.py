"""Values brought in from a lookup table with unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtable.functions.checks import dtype_of, need_columns, need_distinct, need_some
from loomtable.functions.values import is_blank, strip, text_of
from loomtable.registry import operator


def _keys(df: DataFrame, names: list[str], stem: str) -> dict[str, Column]:
    return {f"__{stem}{i}": F.when(~is_blank(df, n), strip(text_of(df, n)))
            for i, n in enumerate(names)}


def _unique_lookup(lookup: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key; a second row of a key fails the job."""
    made = _keys(lookup, keys, "lk")
    rows = lookup.select(*[c.alias(n) for n, c in made.items()],
                         *[F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(columns)])
    rows = rows.filter(reduce(Column.__and__, [F.col(n).isNotNull() for n in made]))
    one = rows.groupBy(*made).agg(F.count(F.lit(1)).alias("__n"),
                                  *[F.first(f"__v{i}").alias(f"__v{i}") for i in range(len(columns))])
    shown = F.concat_ws(" + ", *[F.col(n) for n in made])
    checked = F.when(F.col("__n") > 1, F.raise_error(
        F.concat(F.lit("lookup key is not unique: "), shown)).cast("boolean")).otherwise(F.lit(True))
    return one.select(*made, checked.alias("__found"), *[f"__v{i}" for i in range(len(columns))])


def _with_lookup(base, lookup, base_keys, lookup_keys, columns) -> DataFrame:
    need_some(base_keys, "base key")
    need_some(lookup_keys, "lookup key")
    if len(base_keys) != len(lookup_keys):
        raise ValueError("base and lookup need the same number of keys")
    need_columns(base, base_keys, "base table")
    need_columns(lookup, [*lookup_keys, *columns], "lookup table")
    made = _keys(base, base_keys, "bk")
    rhs = _unique_lookup(lookup, lookup_keys, columns)
    on = reduce(Column.__and__, [F.col(f"__bk{i}") == F.col(f"__lk{i}") for i in range(len(base_keys))])
    return base.withColumns(made).join(rhs, on, "left")


@operator("lookup_values")
def lookup_values(base: DataFrame, lookup: DataFrame, base_keys: list[str],
                  lookup_keys: list[str], selects: list[dict]) -> DataFrame:
    """Adds columns, keeps the row count; a text value that is not found is empty."""
    need_some(selects, "lookup column")
    names = [s.get("output_column") or s["lookup_column"] for s in selects]
    need_distinct([*base.columns, *names], "output column")
    columns = [s["lookup_column"] for s in selects]
    joined = _with_lookup(base, lookup, base_keys, lookup_keys, columns)
    out = []
    for i, (column, name) in enumerate(zip(columns, names)):
        v = F.when(F.col("__found"), F.col(f"__v{i}"))
        if isinstance(dtype_of(lookup, column), T.StringType):
            v = F.coalesce(v, F.lit(""))
        out.append(v.alias(name))
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], *out)


@operator("fill_missing_from_lookup")
def fill_missing_from_lookup(base: DataFrame, lookup: DataFrame, base_keys: list[str],
                             lookup_keys: list[str], fills: list[dict]) -> DataFrame:
    """Only blank or null base cells take the lookup value."""
    need_some(fills, "fill")
    targets = [f["base_column"] for f in fills]
    need_distinct(targets, "fill target")
    need_columns(base, targets, "base table")
    joined = _with_lookup(base, lookup, base_keys, lookup_keys, [f["lookup_column"] for f in fills])
    place = {t: i for i, t in enumerate(targets)}
    out = []
    for c in base.columns:
        own = F.col(f"`{c}`")
        if c in place:
            found = F.when(F.col("__found"), F.col(f"__v{place[c]}")).cast(dtype_of(base, c))
            own = F.when(is_blank(base, c), F.coalesce(found, own)).otherwise(own)
        out.append(own.alias(c))
    return joined.select(*out)
