"""Correlation, outliers, distribution, trend and the combined diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns, need_numeric, need_some
from loomtable.functions.quantiles import quantile_rows
from loomtable.registry import operator

TINY = 1e-12


def _number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _fail(problem: Column, kind: str) -> Column:
    return F.raise_error(problem).cast(kind)


def _correlations(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature_column, coefficient, paired_row_count, problem), one pass for all pairs."""
    need_some(features, "feature column")
    need_numeric(df, [target, *features])
    aggs = []
    for i, f in enumerate(features):
        both = _number(target).isNotNull() & _number(f).isNotNull()
        x, y = F.when(both, _number(target)), F.when(both, _number(f))
        aggs += [F.count(x).alias(f"n{i}"), F.var_pop(x).alias(f"vx{i}"), F.var_pop(y).alias(f"vy{i}"),
                 F.covar_pop(x, y).alias(f"c{i}")]
    rows = []
    for i, f in enumerate(features):
        n, scale = F.col(f"n{i}"), F.col(f"n{i}") * F.col(f"n{i}")
        problem = (F.when(n < 2, F.lit(f"column {f}: fewer than 2 paired rows"))
                   .when(scale * F.col(f"vx{i}") <= TINY, F.lit(f"column {target} is constant"))
                   .when(scale * F.col(f"vy{i}") <= TINY, F.lit(f"column {f} is constant")))
        r = F.col(f"c{i}") / F.nullif(F.sqrt(F.col(f"vx{i}") * F.col(f"vy{i}")), F.lit(0.0))
        rows.append(F.struct(F.lit(f).alias("feature_column"),
                             F.when(problem.isNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
                             .alias("coefficient"), n.alias("paired_row_count"), problem.alias("problem")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


@operator("correlation_analysis")
def correlation_analysis(df: DataFrame, target_column: str, feature_columns: list[str]) -> DataFrame:
    """Pearson coefficients, strongest positive first."""
    out = _correlations(df, target_column, feature_columns)
    checked = F.when(F.col("problem").isNotNull(), _fail(F.col("problem"), "double")).otherwise(F.col("coefficient"))
    return (out.select("feature_column", checked.alias("coefficient"), "paired_row_count")
            .orderBy(F.desc("coefficient"), "feature_column"))


def _bounds(df: DataFrame, columns: list[str], method: str) -> dict[str, tuple]:
    """Per column (low, high, mean, stddev); one row of statistics reaches the driver."""
    need_some(columns, "column")
    need_numeric(df, columns)
    stats = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(_number(c)).alias(f"n{i}"), F.avg(_number(c)).alias(f"m{i}"),
        F.stddev_pop(_number(c)).alias(f"s{i}"))]).first()
    empty = [c for i, c in enumerate(columns) if stats[f"n{i}"] == 0]
    if empty:
        raise ValueError(f"column {empty[0]!r} has no values")
    if method == "zscore":
        return {c: (None, None, stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(columns)}
    if method != "iqr":
        raise ValueError(f"unknown method {method!r}")
    out = {}
    for r in quantile_rows(df, columns, [0.25, 0.75]).collect():
        q1, q3 = r["quantiles"]
        out[r["column_name"]] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), None, None)
    return out


def _is_outlier(c: str, bound: tuple) -> Column:
    low, high, mean, sd = bound
    v = _number(c)
    if low is not None:
        test = (v < low) | (v > high)
    elif abs(sd) <= TINY:
        test = F.lit(False)
    else:
        test = F.abs((v - mean) / sd) > 3.0
    return F.coalesce(test, F.lit(False))


@operator("outlier_detection")
def outlier_detection(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """The table with a boolean ``<column>__is_outlier`` per column."""
    bounds = _bounds(df, columns, method)
    return df.withColumns({f"{c}__is_outlier": _is_outlier(c, bounds[c]) for c in columns})


@operator("outlier_summary")
def outlier_summary(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    bounds = _bounds(df, columns, method)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(_is_outlier(c, bounds[c]), 1)).alias(f"o{i}")
                                                     for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(method).alias("method"),
                     F.col(f"o{i}").alias("outlier_count"), (F.col(f"o{i}") / F.col("n")).alias("outlier_ratio"),
                     *[F.lit(v).cast("double").alias(n) for v, n in
                       zip(bounds[c], ("lower_bound", "upper_bound", "mean", "stddev"))])
            for i, c in enumerate(columns)]
    return counted.select(F.inline(F.array(*rows)))


@operator("distribution_summary")
def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    need_numeric(df, [column])
    v = _number(column)
    q = quantile_rows(df, [column], [0.25, 0.5, 0.75])
    flat = F.stddev_pop(v) <= TINY
    stats = df.agg(F.lit(column).alias("column_name"), F.count(F.lit(1)).alias("row_count"),
                   F.count(v).alias("non_null_count"), F.min(v).alias("min"), F.max(v).alias("max"),
                   F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
                   F.when(flat, 0.0).otherwise(F.skewness(v)).alias("skewness"))
    return (stats.withColumn("quantiles", q.select("quantiles").scalar())
            .withColumns({n: F.col("quantiles")[i] for i, n in enumerate(("q1", "median", "q3"))})
            .withColumn("null_count", F.col("row_count") - F.col("non_null_count")).drop("quantiles"))


@operator("distribution_analysis")
def distribution_analysis(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram; the largest value falls in the last bin and empty bins stay."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    need_numeric(df, [column])
    v = _number(column)
    edge = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    if not edge["n"]:
        raise ValueError(f"column {column!r} has no values")
    lo, hi, n = edge["lo"], edge["hi"], edge["n"]
    flat = abs(hi - lo) <= TINY
    width = 1.0 if flat else (hi - lo) / bins
    index = F.lit(0) if flat else F.when(F.abs(v - hi) <= TINY, bins - 1).otherwise(
        F.least(F.floor((v - lo) / width), F.lit(bins - 1)))
    counts = (df.filter(v.isNotNull()).groupBy(index.cast("bigint").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    b = F.col("bin")
    return all_bins.join(counts, "bin", "left").select(
        "bin", (lo + width * b).alias("lower_bound"),
        F.when(b == bins - 1, F.lit(hi)).otherwise(lo + width * (b + 1)).alias("upper_bound"),
        F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) / n).alias("ratio"))


def direction(change: Column) -> Column:
    return F.when(change > TINY, "upward").when(change < -TINY, "downward").otherwise("flat")


@operator("trend_analysis")
def trend_analysis(df: DataFrame, time_column: str, value_column: str, row_id: list[str] | None = None,
                   keys: list[str] | None = None) -> DataFrame:
    """First against last value by time text, for every key.  Among equal times
    the first row (by ``row_id``) starts and the last row ends."""
    need_columns(df, [time_column, *(row_id or []), *(keys or [])])
    need_numeric(df, [value_column])
    keys = list(keys or [])
    time = F.col(f"`{time_column}`").cast("string")
    rows = df.select(*keys, time.alias("__t"), _number(value_column).alias("__v"),
                     F.struct(time.alias("t"), *[F.col(f"`{c}`") for c in row_id or []]).alias("__o"))
    rows = rows.filter(F.col("__t").isNotNull() & F.col("__v").isNotNull())
    ends = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"), F.min("__t").alias("start_time"), F.max("__t").alias("end_time"),
        F.min_by("__v", "__o").alias("start_value"), F.max_by("__v", "__o").alias("end_value"))
    change = F.col("end_value") - F.col("start_value")
    short = F.col("point_count") < 2
    if not keys:
        problem = F.lit(f"fewer than 2 points in {time_column}, {value_column}")
        change = F.when(short, _fail(problem, "double")).otherwise(change)
    else:
        change = F.when(~short, change)
    return (ends.withColumn("absolute_change", change)
            .withColumn("change_rate", F.when(F.abs("start_value") <= TINY, 0.0)
                        .otherwise(F.col("absolute_change") / F.col("start_value")))
            .withColumn("direction", F.when(F.col("absolute_change").isNotNull(), direction(F.col("absolute_change")))))


# ---- combined diagnostics ----

REPORT_SCHEMA = ("section string, status string, finding string, column_name string, number double, "
                 "share double, note string")
# Sections in report order.
SECTIONS = ("correlation", "outlier", "distribution", "trend")


def _correlation_findings(df, spec):
    rows = _correlations(df, spec["target_column"], spec["feature_columns"]).collect()
    bad = [r["problem"] for r in rows if r["problem"]]
    if bad:
        raise ValueError(bad[0])
    rows = sorted(rows, key=lambda r: (-r["coefficient"], r["feature_column"]))
    up = [r for r in rows if r["coefficient"] >= 0][:1]
    down = sorted((r for r in rows if r["coefficient"] < 0), key=lambda r: (r["coefficient"], r["feature_column"]))[:1]
    return ([("strongest_positive", r["feature_column"], r["coefficient"], None) for r in up]
            + [("strongest_negative", r["feature_column"], r["coefficient"], None) for r in down])


def _outlier_findings(df, spec):
    rows = outlier_summary(df, spec["columns"], spec.get("method", "iqr")).collect()
    worst = max(enumerate(rows), key=lambda p: (p[1]["outlier_count"], p[0]))[1]
    if not worst["outlier_count"]:
        return [("no_outliers", None, None, None)]
    return [("most_outliers", worst["column_name"], float(worst["outlier_count"]), worst["outlier_ratio"])]


def _distribution_findings(df, spec):
    if spec.get("bins", 10) < 1:
        raise ValueError("at least one bin is needed")
    s = distribution_summary(df, spec["column"]).first()
    if not s["non_null_count"]:
        raise ValueError(f"column {spec['column']!r} has no values")
    shape = "right_skewed" if s["skewness"] > 1 else "left_skewed" if s["skewness"] < -1 else "even"
    return [(shape, spec["column"], s["median"], None)]


def _trend_findings(df, spec):
    s = trend_analysis(df.withColumn("__all", F.lit(1)), spec["time_column"], spec["value_column"],
                       spec.get("row_id"), ["__all"]).first()
    if s is None or s["point_count"] < 2:
        raise ValueError("fewer than 2 points")
    return [(s["direction"], spec["value_column"], s["absolute_change"], s["change_rate"])]


_BUILDERS = {"correlation": _correlation_findings, "outlier": _outlier_findings,
             "distribution": _distribution_findings, "trend": _trend_findings}


@operator("diagnostics_report")
def diagnostics_report(df: DataFrame, **sections: dict) -> DataFrame:
    """Findings of up to four sections.  A section that cannot be computed
    becomes an ``unavailable`` row; the ``report`` row says ok, degraded or
    unavailable.  Only single-row statistics reach the driver."""
    need_some([s for s in sections.values() if s], "section")
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    rows, good, bad = [], 0, 0
    for name in SECTIONS:
        if not sections.get(name):
            continue
        try:
            found = _BUILDERS[name](df, sections[name])
        except ValueError as problem:
            bad += 1
            rows.append((name, "unavailable", None, None, None, None, str(problem)))
        else:
            good += 1
            rows += [(name, "ok", *f, None) for f in found]
    status = "unavailable" if not good else "degraded" if bad else "ok"
    rows.append(("report", status, None, None, float(good), good / (good + bad), None))
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
