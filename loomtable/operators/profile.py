"""Column summaries: one row per column, made in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomtable.functions.checks import dtype_of, is_numeric, need_columns
from loomtable.functions.quantiles import quantile_rows
from loomtable.functions.values import is_placeholder, text_of
from loomtable.operators.columns import type_label
from loomtable.registry import operator


def column_kind(df: DataFrame, name: str) -> str:
    if isinstance(dtype_of(df, name), T.BooleanType):
        return "boolean"
    return "numeric" if is_numeric(df, name) else "string"


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) of the text columns, placeholders left out."""
    cells = [F.when(~is_placeholder(df, c), F.struct(F.lit(c).alias("column_name"),
                                                     text_of(df, c).alias("value")))
             for c in columns]
    # placeholders go after the explode: array_compact would leave the generated code
    return (df.select(F.explode(F.array(*cells)).alias("x")).filter("x is not null").select("x.*")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(counts: DataFrame, top_k: int) -> DataFrame:
    """Distinct count and the most frequent values per column."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    best = (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
            .groupBy("column_name")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                             lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
                 .alias("top_values")))
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return distinct.join(best, "column_name")


_EMPTY_TOP = "array<struct<value:string,count:bigint>>"


@operator("summarize_table")
def summarize_table(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    names = list(columns or df.columns)
    need_columns(df, names)
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(names):
        kind, v = column_kind(df, c), F.col(f"`{c}`")
        missing = is_placeholder(df, c) if kind == "string" else v.isNull()
        aggs.append(F.count(F.when(missing, 1)).alias(f"__m{i}"))
        if kind == "numeric":
            x = v.cast("double")
            aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}"), F.avg(x).alias(f"__av{i}"),
                     F.sum(x).alias(f"__su{i}"), F.count(F.when(F.abs(x) <= 2.220446049250313e-16, 1))
                     .alias(f"__z{i}")]
        elif kind == "boolean":
            aggs += [F.count(F.when(v, 1)).alias(f"__t{i}"), F.count(F.when(~v, 1)).alias(f"__f{i}")]
    none = F.lit(None)
    rows = []
    for i, c in enumerate(names):
        kind = column_kind(df, c)
        number = (lambda stem: F.col(f"__{stem}{i}")) if kind == "numeric" else (lambda _: none.cast("double"))
        flag = (lambda stem: F.col(f"__{stem}{i}")) if kind == "boolean" else (lambda _: none.cast("bigint"))
        n = F.col("__rows") - F.col(f"__m{i}")
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"),
            F.lit(type_label(dtype_of(df, c))).alias("dtype"), F.lit(kind).alias("summary_kind"),
            n.alias("count"), F.col(f"__m{i}").alias("null_count"),
            F.when(F.col("__rows") > 0, F.col(f"__m{i}") / F.col("__rows")).alias("missing_rate"),
            number("lo").alias("min_number"), number("hi").alias("max_number"),
            number("av").alias("mean"), number("su").alias("sum"),
            (F.when(n > 0, F.col(f"__z{i}") / n).otherwise(0.0) if kind == "numeric"
             else none.cast("double")).alias("zero_ratio"),
            flag("t").alias("true_count"), flag("f").alias("false_count")))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    texts = [c for c in names if column_kind(df, c) == "string"]
    if not texts:
        return out.withColumns({"distinct_count": none.cast("bigint"),
                                "top_values": F.array().cast(_EMPTY_TOP)})
    best = top_values(value_counts(df, texts), max(top_k, 1))
    is_text = F.col("summary_kind") == "string"
    return (out.join(best, "column_name", "left")
            .withColumn("distinct_count", F.when(is_text, F.coalesce("distinct_count", F.lit(0))))
            .withColumn("top_values", F.slice(F.coalesce("top_values", F.array().cast(_EMPTY_TOP)),
                                              1, top_k)))


@operator("stat_summary")
def stat_summary(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """Column summaries plus quartiles, zero ratio, top share and true ratio."""
    names = list(columns or df.columns)
    out = summarize_table(df, names, max(top_k, 1))
    numeric = [c for c in names if column_kind(df, c) == "numeric"]
    if numeric:
        q = quantile_rows(df, numeric, [0.25, 0.5, 0.75])
        q = q.select("column_name", *[F.col("quantiles")[i].alias(n)
                                      for i, n in enumerate(("q1", "median", "q3"))])
        out = out.join(q, "column_name", "left")
    else:
        out = out.withColumns({n: F.lit(None).cast("double") for n in ("q1", "median", "q3")})
    share = lambda part: F.when(F.col("count") > 0, part / F.col("count"))
    return (out.withColumn("top_share", share(F.get("top_values", F.lit(0))["count"]))
            .withColumn("true_ratio", share(F.col("true_count"))))


@operator("stat_key_points")
def stat_key_points(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """At most three points, text columns first, then numbers, then flags."""
    s = stat_summary(df, columns, top_k)
    point = (F.when(F.col("top_share") >= 0.50, "concentrated")
             .when((F.col("median") > 0) & (F.col("mean") >= F.col("median") * 1.5), "long_tail")
             .when((F.col("summary_kind") == "numeric") & (F.col("zero_ratio") >= 0.50), "many_zeros")
             .when(F.col("true_ratio") >= 0.80, "mostly_true")
             .when(F.col("true_ratio") <= 0.20, "mostly_false"))
    stage = (F.when(F.col("summary_kind") == "string", 0)
             .when(F.col("summary_kind") == "numeric", 1).otherwise(2))
    return (s.select("column_name", point.alias("point"), stage.alias("stage"), "position",
                     F.get("top_values", F.lit(0))["value"].alias("top_value"))
            .filter("point is not null").orderBy("stage", "position").limit(3)
            .select("column_name", "point",
                    F.when(F.col("point") == "concentrated", F.col("top_value")).alias("value")))


@operator("table_overview")
def table_overview(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    kinds = [column_kind(df, c) for c in names]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(names)).alias("column_count"),
        *[F.lit(kinds.count(k)).alias(f"{n}_columns")
          for k, n in (("numeric", "numeric"), ("string", "categorical"), ("boolean", "boolean"))])
