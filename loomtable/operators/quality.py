"""Table quality findings, business observations and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import (date_from_text, day_period, is_blank, looks_like_amount_name,
                                        looks_like_date_name, looks_like_identifier_name,
                                        looks_like_time_name, strip, text_of, time_of_day,
                                        two_decimal_number, year_month)
from loomtable.operators.profile import column_kind, stat_summary
from loomtable.registry import operator

# Finding codes in order of priority, with their severity.
FINDINGS = (("all_missing", "high"), ("duplicate_rows", "high"), ("duplicate_candidate_key", "high"),
            ("blank_candidate_key", "high"), ("high_missing_rate", "high"),
            ("outlier_suspected", "medium"), ("high_zero_ratio", "medium"),
            ("high_category_imbalance", "medium"), ("single_value_column", "medium"))
BLOCKING = ("all_missing", "high_missing_rate", "duplicate_rows", "duplicate_candidate_key",
            "blank_candidate_key")
RISKY = ("all_missing", "duplicate_rows", "duplicate_candidate_key", "blank_candidate_key")


@operator("count_duplicate_rows")
def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row."""
    return (df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_row_count")))


@operator("inspect_candidate_keys")
def inspect_candidate_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Blank cells and repeated values of each key-like column."""
    names = columns if columns is not None else [c for c in df.columns if looks_like_identifier_name(c)]
    need_columns(df, names)
    cells = [F.struct(F.lit(c).alias("column_name"),
                      F.when(~is_blank(df, c), strip(text_of(df, c))).alias("value")) for c in names]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, blank_count bigint, duplicate_value_count bigint")
    counts = (df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("blank_count"),
        F.count(F.when(F.col("value").isNotNull() & (F.col("n") > 1), 1)).alias("duplicate_value_count"))


def _finding(code: str, test):
    return F.when(test, F.lit(code))


@operator("analyze_table")
def analyze_table(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """Findings, most urgent first: code, severity, scope, column_name, priority."""
    s = stat_summary(df, columns, max(top_k, 1))
    gone = F.coalesce(F.col("missing_rate") == 1.0, F.lit(False))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    of_column = F.array_compact(F.array(
        _finding("all_missing", gone),
        _finding("high_missing_rate", ~gone & (F.col("missing_rate") >= 0.30)),
        _finding("high_category_imbalance", ~gone & (F.col("top_share") >= 0.80)),
        _finding("single_value_column", ~gone & (F.col("distinct_count") == 1)),
        _finding("high_zero_ratio", (F.col("summary_kind") == "numeric") & (F.col("zero_ratio") >= 0.80)),
        _finding("outlier_suspected", (F.col("count") >= 4) & (
            (F.col("min_number") < F.col("q1") - spread) | (F.col("max_number") > F.col("q3") + spread)))))
    found = s.select("column_name", F.explode(of_column).alias("code"))
    keys = inspect_candidate_keys(df)
    found = found.unionByName(keys.select("column_name", F.explode(F.array_compact(F.array(
        _finding("duplicate_candidate_key", F.col("duplicate_value_count") > 0),
        _finding("blank_candidate_key", F.col("blank_count") > 0)))).alias("code")))
    found = found.unionByName(count_duplicate_rows(df).filter("duplicate_row_count > 0")
                              .select(F.lit(None).cast("string").alias("column_name"),
                                      F.lit("duplicate_rows").alias("code")))
    codes = [c for c, _ in FINDINGS]
    severity = F.create_map(*[F.lit(x) for pair in FINDINGS for x in pair])
    return (found.withColumn("priority", F.array_position(F.array(*[F.lit(c) for c in codes]),
                                                          F.col("code")).cast("int") - 1)
            .withColumn("severity", severity[F.col("code")])
            .withColumn("scope", F.when(F.col("column_name").isNull(), "table").otherwise("column"))
            .orderBy("priority", F.asc_nulls_first("column_name"), "code"))


@operator("table_health")
def table_health(findings: DataFrame) -> DataFrame:
    level = (F.when(F.count(F.when(F.col("code").isin(*RISKY), 1)) > 0, "risky")
             .when(F.count(F.lit(1)) == 0, "good").otherwise("warning"))
    return (findings.agg(level.alias("level"), F.count(F.lit(1)).alias("finding_count"))
            .withColumn("score", F.when(F.col("level") == "risky", 0.35)
                        .when(F.col("level") == "good", 1.0).otherwise(0.7)))


@operator("display_findings")
def display_findings(findings: DataFrame) -> DataFrame:
    """The most urgent finding of each column."""
    w = Window.partitionBy("column_name").orderBy("priority", "code")
    return findings.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


@operator("business_observations")
def business_observations(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """First ``top_k`` observations: type, column, a label, a number and a share."""
    names = list(columns or df.columns)
    s = stat_summary(df, names, max(top_k, 1))
    skewed = (F.abs(F.col("mean") - F.col("median")) /
              F.when(F.col("max_number") > F.col("min_number"), F.col("max_number") - F.col("min_number"))) >= 0.15
    skewed = F.coalesce(skewed, F.lit(False))
    top = F.get("top_values", F.lit(0))
    amount = F.col("column_name").isin(*[c for c in names if looks_like_amount_name(c)] or [""])
    span = two_decimal_number(F.col("min_number")), two_decimal_number(F.col("max_number"))

    def seen(stage, kind, test, label, number, share, order=F.lit(0.0), part=0):
        return F.when(test, F.struct(
            F.lit(stage).alias("stage"), order.cast("double").alias("rank"), F.col("position").alias("position"),
            F.lit(part).alias("part"), kind.alias("observation_type"), F.col("column_name").alias("column_name"),
            label.cast("string").alias("label"), number.cast("double").alias("number"),
            share.cast("double").alias("share")))

    none, numeric = F.lit(None), F.col("summary_kind") == "numeric"
    has_number = numeric & F.col("min_number").isNotNull()
    parts = [
        seen(0, F.lit("top_category"), top.isNotNull(), top["value"], none, F.col("top_share")),
        seen(1, F.lit("numeric_range"), has_number, F.concat(span[0], F.lit(" - "), span[1]), none, none),
        seen(2, F.lit("dominant_dimension"), F.col("top_share") >= 0.80, top["value"], none, F.col("top_share")),
        seen(3, F.when(skewed, "median_center").otherwise("numeric_center"), has_number, none,
             F.when(skewed, F.col("median")).otherwise(F.col("mean")), none,
             F.col("min_number") - F.col("max_number")),
        seen(6, F.lit("amount_typical_band"), has_number & amount,
             F.concat(two_decimal_number(F.col("q1")), F.lit(" - "), two_decimal_number(F.col("q3"))), none, none),
        seen(6, F.lit("amount_negative_presence"), has_number & amount & (F.col("min_number") < 0),
             none, none, none, part=1),
        seen(6, F.lit("amount_skew_hint"), has_number & amount & skewed, none, none, none, part=2)]
    out = s.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")
    place = {c: i for i, c in enumerate(names)}
    texts = [c for c in names if column_kind(df, c) == "string"]
    dated = [c for c in texts if looks_like_date_name(c)]
    timed = [c for c in texts if looks_like_time_name(c)]
    if dated:
        out = out.unionByName(_date_observations(df, dated, place))
    if timed:
        out = out.unionByName(_time_observations(df, timed, place))
    return (out.orderBy("stage", "rank", "position", "part").limit(max(top_k, 1))
            .select("observation_type", "column_name", "label", "number", "share"))


def _counts_by(df: DataFrame, columns: list[str], value, extra=None) -> DataFrame:
    """(column_name, value, n, ...) over the non-blank cells of text columns."""
    cells = [F.when(~is_blank(df, c), F.struct(F.lit(c).alias("column_name"),
                                               strip(text_of(df, c)).alias("cell"))) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("x")).filter("x is not null").select("x.*")
    return rows.withColumn("value", value(F.col("cell")))


def _stage_rows(df, place, stage, part, kind, label, share):
    position = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])
    return df.select(F.lit(stage).alias("stage"), F.lit(0.0).alias("rank"),
                     position[F.col("column_name")].alias("position"), F.lit(part).alias("part"),
                     F.lit(kind).alias("observation_type"), "column_name",
                     label.cast("string").alias("label"), F.lit(None).cast("double").alias("number"),
                     share.cast("double").alias("share"))


def _date_observations(df, columns, place):
    by_month = (_counts_by(df, columns, date_from_text)
                .groupBy("column_name", year_month(F.col("value")).alias("month"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    real = F.col("month").isNotNull()
    best = by_month.groupBy("column_name").agg(
        F.sum("n").alias("cells"), F.sum(F.when(real, F.col("n"))).alias("parsed"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.when(real, F.struct("n", "month"))).alias("peak"))
    best = best.filter(F.col("parsed") / F.col("cells") >= 0.60)
    share = F.col("peak.n") / F.col("parsed")
    return (_stage_rows(best, place, 4, 0, "date_range",
                        F.concat_ws(" - ", F.col("lo").cast("string"), F.col("hi").cast("string")),
                        F.lit(None))
            .unionByName(_stage_rows(best.filter(share >= 0.60), place, 4, 1, "date_concentration",
                                     F.col("peak.month"), share)))


def _time_observations(df, columns, place):
    hour = lambda cell: F.hour(time_of_day(cell))
    by_hour = _counts_by(df, columns, hour).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    by_part = (by_hour.withColumn("period", F.when(F.col("value").isNotNull(), day_period(F.col("value"))))
               .groupBy("column_name", "period")
               .agg(F.sum("n").alias("n"),
                    F.sum(F.when(F.col("value").between(9, 18), F.col("n")).otherwise(0)).alias("work")))
    real = F.col("period").isNotNull()
    best = by_part.groupBy("column_name").agg(
        F.sum("n").alias("cells"), F.sum(F.when(real, F.col("n"))).alias("parsed"),
        F.sum(F.when(real, F.col("work"))).alias("work"), F.max(F.when(real, F.struct("n", "period"))).alias("peak"))
    best = best.filter(F.col("parsed") / F.col("cells") >= 0.60)
    share, work = F.col("peak.n") / F.col("parsed"), F.col("work") / F.col("parsed")
    return (_stage_rows(best.filter(share >= 0.50), place, 5, 0, "time_peak_period", F.col("peak.period"), share)
            .unionByName(_stage_rows(best.filter(work >= 0.80), place, 5, 1, "time_business_hour_pattern",
                                     F.lit(None), work)))


@operator("decision_assistant")
def decision_assistant(df: DataFrame, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """Rows of three kinds: blocking_risk, priority_action, next_tool."""
    names = list(columns or df.columns)
    findings = analyze_table(df, names, top_k).select("code", "column_name", "priority")
    facts = findings.agg(
        F.count(F.when(F.col("code").isin(*BLOCKING), 1)).alias("blocking"),
        F.count(F.when(F.col("code").isin("high_zero_ratio", "outlier_suspected",
                                          "high_category_imbalance"), 1)).alias("odd"))
    kinds = [column_kind(df, c) for c in names]
    numeric, text, flag = (kinds.count(k) for k in ("numeric", "string", "boolean"))
    blocked, odd = F.col("blocking") > 0, F.col("odd") > 0
    wait = F.when(blocked, "wait").otherwise("ready")

    def row(kind, seq, name, status, test=F.lit(True)):
        return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(seq).alias("seq"),
                                     F.lit(name).alias("name"), F.lit(None).cast("string").alias("column_name"),
                                     status.alias("status")))

    rows = [row("priority_action", 1, "fix_quality_risks", F.lit("high"), blocked),
            row("priority_action", 2, "check_distributions", F.when(blocked, "medium").otherwise("high"), odd),
            row("priority_action", 3, "start_modelling", F.lit("medium"), ~blocked & ~odd)]
    if numeric >= 2:
        rows += [row("next_tool", 1, "cluster_kmeans", wait), row("next_tool", 2, "linear_regression", wait)]
    if numeric >= 1 and text + flag >= 1:
        rows.append(row("next_tool", 3, "logistic_regression", wait))
    if numeric >= 1 and text >= 1:
        rows.append(row("next_tool", 4, "group_and_aggregate", F.lit("ready")))
    advice = facts.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
    risks = findings.filter(F.col("code").isin(*BLOCKING)).select(
        F.lit("blocking_risk").alias("kind"), F.col("priority").alias("seq"), F.col("code").alias("name"),
        "column_name", F.lit("high").alias("status"))
    return risks.unionByName(advice).orderBy("kind", "seq", F.asc_nulls_first("column_name"))
