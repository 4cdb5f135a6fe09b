"""Row filters, row flags and line matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import fresh_name, need_columns, need_some
from loomtable.functions.predicates import condition
from loomtable.functions.values import is_blank, number_of, text_of
from loomtable.registry import operator


@operator("filter_rows")
def filter_rows(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """AND of conditions.  ``equals`` compares a typed literal with the typed
    column where the types agree (so the test reaches the scan) and text otherwise."""
    need_some(conditions, "condition")
    tests = []
    for c in conditions:
        if "conditions" in c or c.get("operator", "equals") != "equals":
            tests.append(condition(df, c))
            continue
        need_columns(df, [c["column"]])
        value = c["value"]
        if isinstance(value, str):
            tests.append(text_of(df, c["column"]) == value)
        else:
            tests.append(F.col(f"`{c['column']}`") == F.lit(value))
    return df.filter(reduce(Column.__and__, tests))


@operator("flag_rows")
def flag_rows(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Boolean columns of seven kinds: negative, null, duplicate, high_value,
    percent_low, between, composite_duplicate.

    Duplicates are counted per key first and joined back, so a key that holds
    most of the rows is combined map-side and its rows stay spread out.
    """
    need_some(rules, "rule")
    original = df
    for r in rules:
        kind, out = r["kind"], r["output_column"]
        columns = r["columns"] if kind == "composite_duplicate" else [r["column"]]
        need_columns(original, columns)
        if kind in ("duplicate", "composite_duplicate"):
            df = _flag_duplicates(df, original, columns, out)
            continue
        v = number_of(original, columns[0])
        if kind == "negative":
            test = v < 0
        elif kind == "null":
            test = is_blank(original, columns[0])
        elif kind == "high_value":
            test = v > r["threshold"]
        elif kind == "percent_low":
            test = v < r["threshold"]
        elif kind == "between":
            test = (v >= r["min"]) & (v <= r["max"])
        else:
            raise ValueError(f"unknown flag {kind!r}")
        df = df.withColumn(out, F.coalesce(test, F.lit(False)))
    return df


def _flag_duplicates(df: DataFrame, original: DataFrame, columns: list[str], out: str) -> DataFrame:
    keys = [fresh_name(df.columns, f"__k{i}") for i in range(len(columns))]
    keyed = {k: text_of(original, c) for k, c in zip(keys, columns)}
    usable = reduce(Column.__and__, [~is_blank(original, c) for c in columns])
    repeated = (original.filter(usable).select(*[v.alias(k) for k, v in keyed.items()])
                .groupBy(*keys).count().filter("count > 1").select(*keys)
                .withColumn(out, F.lit(True)))
    return (df.withColumns(keyed).join(repeated, keys, "left").drop(*keys)
            .withColumn(out, F.coalesce(F.col(f"`{out}`"), F.lit(False))))


@operator("count_matching_lines")
def count_matching_lines(df: DataFrame, text_column: str, needles: list[str],
                         keys: list[str]) -> DataFrame:
    """Non-empty lines of each text that hold any needle, summed per key."""
    need_some(needles, "needle")
    need_columns(df, [text_column, *keys])
    lines = F.split(F.col(f"`{text_column}`"), "\n")
    hit = lambda line: reduce(Column.__or__, [line.contains(n) for n in needles])
    matched = F.size(F.filter(lines, hit))
    return (df.groupBy(*keys).agg(F.sum(F.when(matched > 0, matched).otherwise(0))
                                  .cast("bigint").alias("matched_lines")))
