"""Rule-made columns: labels, buckets, scores and text templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns, need_some
from loomtable.functions.predicates import condition
from loomtable.functions.values import any_date, number_of, text_of
from loomtable.registry import operator


def _first_match(pairs: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def _in_range(value: Column, low, high) -> Column:
    test = value.isNotNull()
    if low is not None:
        test &= value >= low
    if high is not None:
        test &= value < high
    return F.coalesce(test, F.lit(False))


def _day(text: str | None):
    return None if text is None else any_date(F.lit(text))


def template_column(df: DataFrame, template: str) -> Column:
    """``"{a}-{b}"`` -> concat; an unclosed brace stays as it is."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{([^}]*)\}", template)):
        if i % 2:
            need_columns(df, [piece])
            parts.append(F.coalesce(text_of(df, piece), F.lit("null")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


@operator("derive_columns")
def derive_columns(df: DataFrame, derivations: list[dict]) -> DataFrame:
    """Kinds: case_when, bucketize, score_rules, date_bucketize, template."""
    need_some(derivations, "derivation")
    for d in derivations:
        kind = d["kind"]
        if kind == "case_when":
            c = _first_match([(condition(df, r["when"]), r["value"]) for r in d["rules"]],
                             d["else_value"])
        elif kind == "bucketize":
            need_columns(df, [d["source_column"]])
            df = df.withColumn("__v", number_of(df, d["source_column"]))
            v = F.col("__v")
            c = _first_match([(_in_range(v, b.get("min_inclusive"), b.get("max_exclusive")),
                               b["label"]) for b in d["buckets"]], d["else_value"])
        elif kind == "score_rules":
            c = F.lit(int(d.get("default_score", 0))).cast("bigint")
            for r in d["rules"]:
                c = c + F.when(condition(df, r["when"]), int(r["score"])).otherwise(0)
        elif kind == "date_bucketize":
            need_columns(df, [d["source_column"]])
            df = df.withColumn("__v", any_date(text_of(df, d["source_column"])))
            v = F.col("__v")
            c = _first_match([(_in_range(v, _day(b.get("start_inclusive")),
                                         _day(b.get("end_exclusive"))), b["label"])
                              for b in d["buckets"]], d["else_value"])
        elif kind == "template":
            c = template_column(df, d["template"])
        else:
            raise ValueError(f"unknown derivation {kind!r}")
        df = df.withColumn(d["output_column"], c).drop("__v")
    return df
