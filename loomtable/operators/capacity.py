"""Capacity of services from their metrics and what is known about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import number_of, parse_loose_number, resolve_column, strip, text_of
from loomtable.operators.statistics import direction
from loomtable.registry import operator

C = F.col
# Names a metric column may go by.
ALIASES = {
    "instances": ("instances", "instance_count", "replicas", "pods", "pod_count", "node_count"),
    "cpu": ("cpu_usage", "cpu_utilization", "cpu", "cpu_ratio"),
    "memory": ("memory_usage", "memory_utilization", "memory", "mem_usage", "mem_ratio"),
    "workload": ("workload", "workload_qps", "qps", "rps", "tps", "traffic", "requests", "throughput"),
    "time": ("ts", "time", "timestamp", "datetime", "date")}
METRICS = ("instances", "cpu", "memory", "workload")
# Columns of the two kinds of service profile, and demand factors.
SCENARIO = ("service_tier", "peak_pattern", "failure_impact")
DEPLOYMENT = ("redundancy_mode", "scaling_step", "max_instance_count", "current_instance_count")
FACTORS = {"service_tier": {"core": 1.10, "important": 1.05}, "peak_pattern": {"burst": 1.10, "seasonal": 1.05},
           "failure_impact": {"high": 1.05, "critical": 1.08}}


def metric_columns(columns: list[str], explicit: dict[str, str] | None = None) -> dict[str, str | None]:
    return {k: resolve_column(columns, list(a), (explicit or {}).get(k)) for k, a in ALIASES.items()}


@operator("latest_metrics")
def latest_metrics(metrics: DataFrame, service: str, row_id: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """Per service the last row with a reading (rows with cpu or memory first),
    and the trend of each metric over time."""
    need_columns(metrics, [service, row_id])
    names = metric_columns([c for c in metrics.columns if c not in (service, row_id)], explicit)
    number = {m: parse_loose_number(text_of(metrics, names[m])) if names[m] else F.lit(None).cast("double")
              for m in METRICS}
    time = F.lit(None).cast("string")
    if names["time"]:
        t = strip(text_of(metrics, names["time"]))
        time = F.when(t != "", t)
    plain = {m: number_of(metrics, names[m]) if names[m] else F.lit(None).cast("double") for m in METRICS[1:]}
    rows = metrics.select(C(service).alias("service"), C(row_id).alias("__row"), time.alias("__t"),
                          *[c.alias(m) for m, c in number.items()], *[c.alias(f"__{m}") for m, c in plain.items()])
    resource = C("cpu").isNotNull() | C("memory").isNotNull()
    signal = resource | C("instances").isNotNull() | C("workload").isNotNull()
    when = F.coalesce(C("__t"), F.format_string("%020d", C("__row").cast("bigint")))
    order = F.when(signal, F.struct(resource.cast("int").alias("a"), when.alias("b"), C("__row").alias("c")))
    aggs = [F.max_by(F.struct(*METRICS), order).alias("now"), F.count("__t").alias("timed_rows")]
    for m in METRICS[1:]:
        at = F.when(C("__t").isNotNull() & C(f"__{m}").isNotNull(), F.struct(C("__t").alias("t"), C("__row").alias("r")))
        aggs += [F.count(at).alias(f"{m}_points"), F.min_by(f"__{m}", at).alias(f"{m}_start"),
                 F.max_by(f"__{m}", at).alias(f"{m}_end")]
    out = rows.groupBy("service").agg(*aggs).select("*", *[C(f"now.{m}").alias(m) for m in METRICS]).drop("now")
    for m in METRICS[1:]:
        change, start, enough = C(f"{m}_end") - C(f"{m}_start"), C(f"{m}_start"), C(f"{m}_points") >= 2
        out = out.withColumns({
            f"{m}_direction": F.when(enough, direction(change)),
            f"{m}_change_rate": F.when(enough, F.when(F.abs(start) <= 1e-12, 0.0)
                                       .otherwise(change / F.nullif(start, F.lit(0.0))))})
    return out


def _factor(column: str) -> Column:
    out = None
    for value, factor in FACTORS[column].items():
        out = F.when(C(column) == value, factor) if out is None else out.when(C(column) == value, factor)
    return out.otherwise(1.0)


def _resource(name: str, target: float, demand: Column, n_plus_one: Column) -> dict[str, Column]:
    goal = 0.70 if target <= 0 else target
    rise = F.pow(F.least(F.greatest(C(f"{name}_change_rate"), F.lit(0.0)), F.lit(2.0)), F.lit(1.10)) * 0.25
    history = F.when(C(f"{name}_direction") == "upward", 1.0 + rise).otherwise(1.0)
    ratio = F.greatest(C(name), F.lit(0.0)) / max(goal, 0.05)
    penalty = F.when(ratio <= 1.0, ratio).otherwise(F.pow(ratio, F.lit(1.35)))
    ready = C(name).isNotNull() & (C("current_instances") > 0)
    need = F.greatest(F.ceil(C("current_instances") * C(f"{name}_demand") * C(f"{name}_penalty")), F.lit(1))
    need = need + F.when(n_plus_one, 1).otherwise(0)
    step = F.greatest(C("scaling_step"), F.lit(1))
    need = F.ceil(need / step) * step
    need = F.when(C("max_instance_count").isNull(), need).otherwise(
        F.least(need, F.greatest(C("max_instance_count"), F.lit(1))))
    return {f"{name}_demand": F.when(ready, demand * history), f"{name}_penalty": F.when(ready, penalty),
            f"{name}_required": F.when(ready, need).cast("bigint")}


@operator("capacity_assessment")
def capacity_assessment(metrics: DataFrame, service: str, row_id: str, profiles: DataFrame | None = None,
                        inventory: DataFrame | None = None, explicit: dict[str, str] | None = None,
                        target_cpu: float = 0.70, target_memory: float = 0.75, growth_rate: float = 0.0,
                        peak_multiplier: float = 1.0, require_n_plus_one: bool = False) -> DataFrame:
    """One row per service: instances needed for each resource, the limiting
    one, status, evidence level and the inputs that are missing.

    ``profiles`` (service, and any of the scenario and deployment columns) and
    ``inventory`` (service, discovered_instance_count, ...) are optional facts.
    """
    now = latest_metrics(metrics, service, row_id, explicit)
    names = metric_columns([c for c in metrics.columns if c not in (service, row_id)], explicit)
    wanted = {**{c: "string" for c in (*SCENARIO, "redundancy_mode")},
              **{c: "bigint" for c in DEPLOYMENT[1:]}}
    given = [c for c in wanted if profiles is not None and c in profiles.columns]
    if given:
        now = now.join(profiles.select("service", *[C(c).cast(wanted[c]).alias(c) for c in given]), "service", "left")
    now = now.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in given})
    if inventory is not None:
        now = now.join(inventory.select("service", C("discovered_instance_count").cast("bigint").alias("discovered"),
                                        F.lit(True).alias("has_inventory")), "service", "left")
    else:
        now = now.withColumns({"discovered": F.lit(None).cast("bigint"), "has_inventory": F.lit(False)})
    any_of = lambda columns: reduce(Column.__or__, [C(c).isNotNull() for c in columns])
    now = now.withColumns({
        "has_scenario": any_of(SCENARIO), "has_deployment": any_of(DEPLOYMENT),
        "has_inventory": F.coalesce("has_inventory", F.lit(False)),
        "instance_source": F.when(C("instances").isNotNull(), "sheet_metric")
        .when(C("current_instance_count").isNotNull(), "deployment_profile")
        .when(C("discovered").isNotNull(), "inventory_evidence"),
        "current_instances": F.coalesce("instances", C("current_instance_count").cast("double"),
                                        C("discovered").cast("double"))})
    mode = F.coalesce("redundancy_mode", F.lit("n_plus_one" if require_n_plus_one else "none"))
    now = now.withColumns({"redundancy_mode": mode, "scaling_step": F.coalesce("scaling_step", F.lit(1)),
                           "service_tier": F.coalesce("service_tier", F.lit("standard")),
                           "peak_pattern": F.coalesce("peak_pattern", F.lit("steady")),
                           "failure_impact": F.coalesce("failure_impact", F.lit("medium"))})
    demand = F.lit(max(peak_multiplier, 0.20) * max(1.0 + growth_rate, 0.20)) * reduce(
        Column.__mul__, [_factor(c) for c in SCENARIO])
    spare = F.lit(require_n_plus_one) | (C("redundancy_mode") == "n_plus_one")
    for name, target in (("cpu", target_cpu), ("memory", target_memory)):
        made = _resource(name, target, demand, spare)
        required = made.pop(f"{name}_required")
        now = now.withColumns(made).withColumn(f"{name}_required", required)
    history = [F.when(C(f"{m}_direction").isNotNull(), m) for m in METRICS[1:]]
    current = F.when(C("current_instances").isNotNull(),
                     F.greatest(F.round("current_instances"), F.lit(0))).cast("bigint")
    code = lambda test, name: F.when(test, name)
    missing = F.array_compact(F.array(
        code(C("current_instances").isNull(), "instance_count"), code(C("cpu").isNull(), "cpu"),
        code(C("memory").isNull(), "memory"), code(C("workload").isNull(), "workload"),
        code(~C("has_scenario"), "scenario_profile"),
        code(~C("has_deployment") & ~C("has_inventory"), "deployment_or_inventory"),
        code(F.lit(names["time"] is None) | (C("timed_rows") == 0), "time")))
    out = now.withColumns({
        "current_instance_count": current,
        "recommended_instance_count": F.greatest("cpu_required", "memory_required"),
        "limiting_resource": F.when(C("memory_required") >= F.coalesce("cpu_required", F.lit(0)), "memory")
        .when(C("cpu_required").isNotNull(), "cpu"),
        "missing_inputs": missing, "history_metrics": F.array_compact(F.array(*history))})
    unknown = C("current_instance_count").isNull() | C("recommended_instance_count").isNull()
    few = (C("cpu").isNotNull().cast("int") + C("memory").isNotNull().cast("int")) < 2
    context = C("has_scenario") | C("has_deployment") | C("has_inventory")
    partial = (C("instance_source") != "sheet_metric") | few | ((F.size("missing_inputs") > 0) & context)
    return out.withColumns({
        "capacity_status": F.when(unknown, "unknown").when(
            C("recommended_instance_count") > C("current_instance_count"), "insufficient").otherwise("sufficient"),
        "evidence_level": F.when(unknown, "guidance_only").when(partial, "partial").otherwise("quantified")}).select(
        "service", "evidence_level", "capacity_status", "current_instance_count", "recommended_instance_count",
        "limiting_resource", "instance_source", "cpu", "cpu_demand", "cpu_penalty", "cpu_required", "memory",
        "memory_demand", "memory_penalty", "memory_required", "workload", "service_tier", "peak_pattern",
        "failure_impact", "redundancy_mode", "scaling_step", "missing_inputs", "history_metrics",
        *[f"{m}_{x}" for m in METRICS[1:] for x in ("direction", "change_rate")])


@operator("parse_inventory")
def parse_inventory(outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Collected command outputs (keys, command, output) -> one row of facts per host."""
    keys = list(keys or ["host"])
    need_columns(outputs, [*keys, "command", "output"])
    of = lambda command: F.max(F.when(C("command") == command, C("output")))
    lines = lambda c, n: F.array_join(F.slice(F.split(c, "\r?\n"), 1, n), "\n")
    per = outputs.groupBy(*keys).agg(of("hostname").alias("h"), of("nproc").alias("n"), of("free -m").alias("f"),
                                     of("ps -ef").alias("p"), of("top -b -n 1").alias("t"))
    first = lambda c: strip(F.element_at(F.split(c, "\r?\n"), 1))
    whole = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
    return per.select(*keys, F.when(first(C("h")) != "", first(C("h"))).alias("hostname"),
                      whole(first(C("n"))).alias("cpu_core_count"),
                      whole(F.regexp_extract("f", r"(?m)^\s*Mem:\s+(\S+)", 1)).alias("memory_total_mb"),
                      lines(C("p"), 12).alias("process_excerpt"), lines(C("t"), 20).alias("top_excerpt"))


@operator("matched_processes")
def matched_processes(outputs: DataFrame, needles: list[str], keys: list[str]) -> DataFrame:
    """Matching process lines per key; none found counts as unknown."""
    from loomtable.operators.filters import count_matching_lines
    rows = count_matching_lines(outputs.filter(C("command") == "ps -ef"), "output", needles, keys)
    return rows.select(*keys, F.when(C("matched_lines") > 0, C("matched_lines")).alias("discovered_instance_count"))


@operator("capacity_assessment_from_inventory")
def capacity_from_inventory(metrics: DataFrame, service: str, row_id: str, outputs: DataFrame, needles: list[str],
                            **options) -> DataFrame:
    """Capacity with instance counts taken from collected process lists.
    ``outputs`` holds service, host, command and output."""
    found = matched_processes(outputs, needles, ["service"])
    return capacity_assessment(metrics, service, row_id, inventory=found, **options)
