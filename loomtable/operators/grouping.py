"""Grouped aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtable.functions.checks import need_columns, need_distinct, need_numeric, need_some
from loomtable.functions.values import text_of
from loomtable.registry import operator

AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg,
              "min": F.min, "max": F.max}
@operator("group_and_aggregate")
def group_and_aggregate(df: DataFrame, group_by: list[str], aggregations: list[dict]) -> DataFrame:
    """One hash aggregate for all columns; sorted by the keys, null is a group.
    ``count`` counts the rows of the group."""
    need_some(group_by, "group column")
    need_some(aggregations, "aggregation")
    need_columns(df, [*group_by, *[a["column"] for a in aggregations]])
    columns = []
    for a in aggregations:
        if a["operator"] not in AGGREGATES:
            raise ValueError(f"unknown aggregate {a['operator']!r}")
        if a["operator"] in ("sum", "mean"):
            need_numeric(df, [a["column"]])
        columns.append(AGGREGATES[a["operator"]](F.col(f"`{a['column']}`"))
                       .alias(f"{a['column']}_{a['operator']}"))
    need_distinct([*group_by, *[f"{a['column']}_{a['operator']}" for a in aggregations]], "output column")
    return (df.groupBy(*[F.col(f"`{c}`") for c in group_by]).agg(*columns)
            .orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in group_by]))


@operator("pivot_table")
def pivot_table(df: DataFrame, rows: list[str], columns: list[str], values: list[str],
                aggregation: str, headers: list[str] | None = None, max_headers: int = 10_000) -> DataFrame:
    """Sum, mean or count of one column; absent cells are null.

    Column keys are joined with `` | `` and sorted.  Pass ``headers`` when they are known: that saves the job that finds
    them.  More than ``max_headers`` keys are an error; ``pivot_cells`` takes any number.
    """
    keyed, cell = _pivot_cells(df, rows, columns, values, aggregation)
    keys = [f"__r{i}" for i in range(len(rows))]
    if headers is None:
        headers = sorted(r[0] for r in keyed.select("__p").distinct().limit(max_headers + 1).collect())
        if len(headers) > max_headers:
            raise ValueError(f"more than {max_headers} headers; use pivot_cells")
    out = keyed.groupBy(*keys).pivot("__p", headers).agg(cell)
    return (out.select(*[F.col(k).alias(r) for k, r in zip(keys, rows)],
                       *[F.col(f"`{h}`") for h in headers]).orderBy(*rows))


@operator("pivot_cells")
def pivot_cells(df: DataFrame, rows: list[str], columns: list[str], values: list[str], aggregation: str) -> DataFrame:
    """The same cells in long form, for any number of headers: the row columns, header and value."""
    keyed, cell = _pivot_cells(df, rows, columns, values, aggregation)
    keys = [f"__r{i}" for i in range(len(rows))]
    return keyed.groupBy(*keys, "__p").agg(cell.alias("value")).select(
        *[F.col(k).alias(r) for k, r in zip(keys, rows)], F.col("__p").alias("header"), "value")


def _pivot_cells(df: DataFrame, rows: list[str], columns: list[str], values: list[str], aggregation: str):
    for what, given in (("row column", rows), ("pivot column", columns), ("value column", values)):
        need_some(given, what)
    if len(values) > 1:
        raise ValueError("one value column at a time")
    need_columns(df, [*rows, *columns, *values])
    if aggregation not in ("sum", "mean", "count"):
        raise ValueError(f"unknown pivot aggregate {aggregation!r}")
    if aggregation != "count":
        need_numeric(df, values)
    blank = lambda c: F.coalesce(text_of(df, c), F.lit(""))
    keyed = df.select(*[blank(c).alias(f"__r{i}") for i, c in enumerate(rows)],
                      F.concat_ws(" | ", *[blank(c) for c in columns]).alias("__p"),
                      F.col(f"`{values[0]}`").alias("__v"))
    cell = {"sum": F.sum(F.col("__v").cast("double")), "mean": F.avg(F.col("__v").cast("double")),
            "count": F.count("__v")}[aggregation]
    return keyed, cell
