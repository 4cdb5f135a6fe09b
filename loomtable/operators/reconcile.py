"""Pairing the records of two sources, and filling a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import strip
from loomtable.operators.windows import number_rows
from loomtable.registry import operator


def plain_title(c: Column) -> Column:
    """Title for comparison: white space collapsed, case folded."""
    return F.replace(F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")),
                     F.lit("ß"), F.lit("ss"))


@operator("reconcile_sources")
def reconcile_sources(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                      left_order: list | None = None, right_order: list | None = None,
                      block_rows: int | None = None) -> DataFrame:
    """The k-th record of a key on the left meets the k-th on the right.

    Numbering makes (key, k) unique on both sides, so a key with very many
    copies spreads over all tasks of the join.
    """
    need_columns(left, [*keys, left_id], "left source")
    need_columns(right, [*keys, right_id], "right source")
    made = [f"__k{i}" for i in range(len(keys))]

    def side(df, id_column, order, alias):
        rows = df.select(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(m)
                           for k, m in zip(keys, made)],
                         *{o if isinstance(o, str) else o["column"] for o in order} | {id_column})
        return number_rows(rows, made, order, "__n", block_rows).select(
            *made, "__n", F.col(f"`{id_column}`").alias(alias))

    lhs = side(left, left_id, left_order or [left_id], "left_id")
    rhs = side(right, right_id, right_order or [right_id], "right_id")
    out = lhs.join(rhs, [*made, "__n"], "full")
    status = (F.when(F.col("left_id").isNull(), "right_only")
              .when(F.col("right_id").isNull(), "left_only").otherwise("matched"))
    return out.select(*[F.col(m).alias(k) for m, k in zip(made, keys)],
                      F.col("__n").alias("occurrence"), "left_id", "right_id", status.alias("status"))


NOT_TRADED = "N/A: Not a trading day (weekend or holiday)"


@operator("calendar_values")
def calendar_values(series: DataFrame, key: str, day: str, value: str, end: str, look_back_days: int) -> DataFrame:
    """Every calendar day of the window for every key, with a note where there is no value."""
    need_columns(series, [key, day, value])
    last = F.lit(end).cast("date")
    inside = series.select(key, F.col(day).cast("date").alias(day), value)
    days = (inside.select(key).distinct()
            .select(key, F.explode(F.sequence(F.date_sub(last, look_back_days), last)).alias(day)))
    window = inside.filter(F.col(day).between(F.date_sub(last, look_back_days), last))
    return days.join(window, [key, day], "left").select(
        key, day, value, F.when(F.col(value).isNull(), NOT_TRADED).alias("note"))
