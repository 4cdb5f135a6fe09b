"""Projection, renaming, casting, layout and display of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtable.functions.checks import need_columns, need_distinct, need_some
from loomtable.functions.values import trimmed_number
from loomtable.registry import operator

# Cast targets and the labels of column types.
CAST_TARGETS = {"string": "string", "int64": "bigint", "float64": "double", "boolean": "boolean"}
TYPE_LABELS = {T.StringType: "string", T.LongType: "int64", T.IntegerType: "int32",
               T.ShortType: "int16", T.ByteType: "int8", T.DoubleType: "float64",
               T.FloatType: "float32", T.BooleanType: "boolean"}


@operator("select_columns")
def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    need_some(columns, "column")
    need_columns(df, columns)
    need_distinct(columns, "column")
    return df.select(*[F.col(f"`{c}`") for c in columns])


@operator("rename_columns")
def rename_columns(df: DataFrame, mappings: list[dict]) -> DataFrame:
    need_some(mappings, "mapping")
    sources = [m["from"] for m in mappings]
    need_columns(df, sources)
    need_distinct(sources, "source column")
    renamed = {m["from"]: m["to"] for m in mappings}
    need_distinct([renamed.get(c, c) for c in df.columns], "output column")
    return df.withColumnsRenamed(renamed)


@operator("cast_column_types")
def cast_column_types(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Strict: Spark's ANSI cast fails the job on the first bad value."""
    need_some(specs, "cast")
    need_columns(df, [s["column"] for s in specs])
    out: dict[str, Column] = {}
    for s in specs:
        if s["target_type"] not in CAST_TARGETS:
            raise ValueError(f"unknown target type {s['target_type']!r}")
        out[s["column"]] = F.col(f"`{s['column']}`").cast(CAST_TARGETS[s["target_type"]])
    return df.withColumns(out)


def type_label(dt: T.DataType) -> str:
    return TYPE_LABELS.get(type(dt), "unknown")


@operator("summarize_column_types")
def summarize_column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type label."""
    rows = [(i, f.name, type_label(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


@operator("format_table_for_export")
def format_table_for_export(df: DataFrame, column_order: list[str] | None = None,
                            rename_mappings: list[dict] | None = None,
                            drop_unspecified_columns: bool = False) -> DataFrame:
    order = list(column_order or [])
    need_distinct(order, "column")
    need_columns(df, order)
    if not drop_unspecified_columns or not order:
        order += [c for c in df.columns if c not in order]
    out = select_columns(df, order)
    return rename_columns(out, rename_mappings) if rename_mappings else out


@operator("preview_table")
def preview_table(df: DataFrame, limit: int = 5) -> DataFrame:
    """First rows as display text: null is empty, numbers keep at most six decimals."""
    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = trimmed_number(c, 6)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.limit(limit).select(*[shown(f) for f in df.schema.fields])


@operator("display_numbers")
def display_numbers(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Text columns for a report: currency, percent, integer or two_decimals."""
    need_columns(df, formats)
    out: dict[str, Column] = {}
    for name, kind in formats.items():
        v = F.col(f"`{name}`").cast("double")
        if kind == "currency":
            sign = F.when(v < 0, "-").otherwise("")
            out[name] = F.concat(sign, F.lit("¥"), F.format_number(F.abs(v), 2))
        elif kind == "percent":
            out[name] = F.concat(F.format_string("%.2f", v * 100), F.lit("%"))
        elif kind == "integer":
            out[name] = F.format_string("%.0f", v)
        elif kind == "two_decimals":
            out[name] = F.format_string("%.2f", v)
        else:
            raise ValueError(f"unknown number format {kind!r}")
        out[name] = F.when(v.isNotNull(), out[name])
    return df.withColumns(out)


@operator("round_prices")
def round_prices(df: DataFrame, columns: list[str], time_column: str | None = None) -> DataFrame:
    """Prices to two decimals; the time column loses its zone."""
    need_columns(df, columns)
    out = {c: F.round(F.col(f"`{c}`"), 2) for c in columns}
    if time_column:
        need_columns(df, [time_column])
        out[time_column] = F.col(f"`{time_column}`").cast("timestamp_ntz")
    return df.withColumns(out)
