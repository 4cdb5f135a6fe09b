"""Result tables of the capacity and diagnostics reports, ready for a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.registry import operator

C = F.col


def _pairs(df: DataFrame, keys: list[str], pairs: dict[str, Column]) -> DataFrame:
    """Long table: keys, metric, value (a dash where there is none)."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"),
                               F.coalesce(c.cast("string"), F.lit("-")).alias("value"))
                      for i, (n, c) in enumerate(pairs.items())])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def _four(c: Column) -> Column:
    return F.format_string("%.4f", c)


@operator("capacity_report_tables")
def capacity_report_tables(assessed: DataFrame) -> dict[str, DataFrame]:
    """conclusion, resources, evidence and actions of assessed services."""
    need_columns(assessed, ["service", "evidence_level", "missing_inputs"])
    history = F.size("history_metrics")
    conclusion = _pairs(assessed, ["service"], {
        "evidence_level": C("evidence_level"), "capacity_status": C("capacity_status"),
        "current_instance_count": C("current_instance_count"),
        "recommended_instance_count": C("recommended_instance_count"), "limiting_resource": C("limiting_resource"),
        "trend_metrics": F.when(history > 0, history)})
    resource = lambda n: F.when(C(f"{n}_required").isNotNull(), F.struct(
        F.lit(n).alias("resource"), _four(C(n)).alias("current_utilization"),
        _four(C(f"{n}_demand")).alias("projected_demand"), _four(C(f"{n}_penalty")).alias("saturation_penalty"),
        C(f"{n}_required").alias("required_instances"),
        F.when(C(f"{n}_required") > C("current_instance_count"), "insufficient").otherwise("sufficient").alias("status")))
    resources = assessed.select("service", F.explode(F.array_compact(F.array(resource("cpu"), resource("memory"))))
                                .alias("x")).select("service", "x.*")
    trend = lambda n: F.when(C(f"{n}_direction").isNotNull(), F.concat_ws(
        " / ", C(f"{n}_direction"), _four(C(f"{n}_change_rate"))))
    evidence = _pairs(assessed, ["service"], {
        **{n: C(n) for n in ("service_tier", "peak_pattern", "failure_impact", "redundancy_mode", "scaling_step",
                             "instance_source")},
        "history": F.when(history > 0, F.array_join("history_metrics", ", ")),
        **{f"{n}_trend": trend(n) for n in ("cpu", "memory", "workload")}})
    todo = F.when(F.size("missing_inputs") > 0, F.transform("missing_inputs", lambda m: F.struct(
        F.lit("missing_input").alias("action"), m.alias("detail")))).otherwise(
        F.array(F.struct(F.lit("missing_input").alias("action"), F.lit("none").alias("detail"))))
    step = (F.when(C("capacity_status") == "insufficient", "scale_out").when(C("capacity_status") == "unknown", "collect_inputs")
            .otherwise("keep_watching"))
    next_step = F.array(F.struct(F.lit("next_step").alias("action"), step.alias("detail")))
    actions = assessed.select("service", F.explode(F.concat(todo, next_step)).alias("x")).select("service", "x.*")
    return {"conclusion": conclusion, "resources": resources, "evidence": evidence, "actions": actions}


@operator("diagnostics_report_tables")
def diagnostics_report_tables(report: DataFrame, name: str = "diagnostics") -> dict[str, DataFrame]:
    """summary, overview, correlation_outlier and distribution_trend of a report."""
    need_columns(report, ["section", "status", "finding", "column_name", "number", "share"])
    sections = report.filter("section <> 'report'")
    overview = sections.groupBy("section").agg(F.first("status").alias("status"),
                                               F.count("finding").alias("finding_count"), F.max("note").alias("note"))
    total = report.filter("section = 'report'")
    level = F.when(C("status") == "ok", "normal").when(C("status") == "degraded", "attention").otherwise("high")
    summary = _pairs(total, [], {
        "report_name": F.lit(name), "report_status": C("status"), "risk_level": level,
        "ready_for_decision": C("status") == "ok", "available_section_count": C("number").cast("bigint")})

    def detail(names):
        rows = sections.filter(C("section").isin(*names))
        value = F.when(C("status") != "ok", "unavailable").otherwise(F.concat_ws(
            " / ", _four(C("number")), F.when(C("share").isNotNull(), F.format_string("%.2f%%", C("share") * 100))))
        metric = F.when(C("status") != "ok", "status").otherwise(F.concat_ws(":", "finding", "column_name"))
        return rows.select("section", metric.alias("metric"), value.alias("value"))

    return {"summary": summary, "overview": overview, "correlation_outlier": detail(("correlation", "outlier")),
            "distribution_trend": detail(("distribution", "trend"))}
