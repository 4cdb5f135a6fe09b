"""Putting many tables together: append alike ones, then join the best pairs.

The loop runs on the driver over *tables*; the links of all pairs of tables are found
together, and those of a joined table with the rest once it is written.  A plan is a list of steps; ``execute`` runs them behind limits
on unmatched rows and duplicate keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomtable.operators.joins import join_preflight, join_tables
from loomtable.operators.links import ranked_links
from loomtable.operators.ordering import append_tables
from loomtable.registry import operator
from loomtable.session import cut_lineage

STEP_SCHEMA = ("step_id string, action string, input_refs string, result_ref string, "
               "execution_status string, preflight_step_id string, bindings string, confidence string, "
               "left_on string, right_on string, match_row_count bigint")
RUN_SCHEMA = ("step_id string, action string, status string, result_ref string, breaches string")
# Limits used when joins are confirmed automatically.
DEFAULT_LIMITS = {"max_left_unmatched_rows": 10, "max_right_unmatched_rows": 10,
                  "max_left_duplicate_keys": 5, "max_right_duplicate_keys": 5}
_COUNT_OF = {"max_left_unmatched_rows": "left_unmatched_row_count",
             "max_right_unmatched_rows": "right_unmatched_row_count",
             "max_left_duplicate_keys": "left_duplicate_key_count",
             "max_right_duplicate_keys": "right_duplicate_key_count"}


@dataclass
class TablePlan:
    steps: list[dict] = field(default_factory=list)
    unresolved_refs: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
        rows = [tuple(",".join(v) if isinstance(v := s.get(n), list) else v for n in names)
                for s in self.steps]
        return spark.createDataFrame(rows, STEP_SCHEMA)


@dataclass
class PlanRun:
    execution_status: str
    steps: list[dict]
    limits: dict
    stopped_at_step_id: str | None = None
    stop_reason: str | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    latest_result_ref: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(s.get(n) for n in names) for s in self.steps], RUN_SCHEMA)


def _status(refs: list[str], made: set[str], is_join: bool) -> str:
    waits = any(r in made for r in refs)
    if is_join:
        return ("needs_preflight_confirmation_and_result_bindings" if waits
                else "needs_preflight_confirmation")
    return "needs_result_bindings" if waits else "ready"


def plan_tables(tables: dict[str, DataFrame], max_link_candidates: int = 3) -> TablePlan:
    if len(tables) < 2:
        raise ValueError("a plan needs at least two tables")
    plan, made = TablePlan(), set()

    def add(action, refs, suffix, **more) -> str:
        step = f"step_{len(plan.steps) + 1}"
        plan.steps.append({
            "step_id": step, "action": action, "input_refs": refs, "result_ref": f"{step}_{suffix}",
            "execution_status": _status(refs, made, action == "join_tables"),
            "bindings": [r for r in refs if r in made], **more})
        return step

    groups: dict[tuple, list[tuple[str, DataFrame]]] = {}
    for ref, df in tables.items():
        groups.setdefault(tuple(sorted(df.columns)), []).append((ref, df))
    nodes: list[tuple[str, DataFrame]] = []
    for group in groups.values():
        ref, df = group[0]
        for other, more in group[1:]:
            step = add("append_tables", [ref, other], "result", confidence="high")
            ref, df = f"{step}_result", append_tables(df, more)
            made.add(ref)
        nodes.append((ref, df))

    links: dict[tuple[str, str], dict] = {}

    def find_links(known: dict[str, DataFrame], pairs: list[tuple[str, str]]) -> None:
        """The best link of every pair of tables, all counted in one job."""
        found = ranked_links(known, pairs, 1) if pairs else None
        for row in found.collect() if found is not None else []:
            links[(row["left_table"], row["right_table"])] = row.asDict()

    find_links(dict(nodes), [(a[0], b[0]) for i, a in enumerate(nodes) for b in nodes[i + 1:]])

    while True:
        best = None
        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                link = links.get((nodes[i][0], nodes[j][0]))
                if link is None:
                    continue
                score = (2 if link["confidence"] == "high" else 1, link["match_row_count"])
                if best is None or score > best[0]:
                    best = (score, i, j, link)
        if best is None:
            break
        _, i, j, link = best
        right, left = nodes.pop(j), nodes.pop(i)
        shared = {"confidence": link["confidence"], "left_on": link["left_column"],
                  "right_on": link["right_column"], "match_row_count": link["match_row_count"]}
        refs = [left[0], right[0]]
        check = add("join_preflight", refs, "preflight", **shared)
        step = add("join_tables", refs, "result", preflight_step_id=check, **shared)
        made.add(f"{step}_result")
        # later steps read the written rows instead of joining again
        nodes.append((f"{step}_result", cut_lineage(
            join_tables(left[1], right[1], link["left_column"], link["right_column"]))))
        find_links(dict(nodes), [(ref, f"{step}_result") for ref, _ in nodes[:-1]])
    plan.unresolved_refs = [ref for ref, _ in nodes]
    return plan


@operator("suggest_multi_table_plan")
def suggest_multi_table_plan(tables: dict[str, DataFrame], max_link_candidates: int = 3) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return plan_tables(tables, max_link_candidates).frame(spark)


def execute(tables: dict[str, DataFrame], plan: TablePlan | None = None, auto_confirm_join: bool = False,
            dry_run: bool = False, max_steps: int | None = None, stop_after_step_id: str | None = None,
            max_link_candidates: int = 3, **limits) -> PlanRun:
    """Runs the steps in order.  Stops before a join that is not confirmed, when
    a preflight count passes its limit, at a missing input, and at step limits."""
    if max_steps is not None and (isinstance(max_steps, bool) or not isinstance(max_steps, int)):
        raise ValueError("max_steps must be integer")
    unknown = set(limits) - set(DEFAULT_LIMITS)
    if unknown:
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    plan = plan or plan_tables(tables, max_link_candidates)
    guard = {k: limits.get(k, v if auto_confirm_join else None) for k, v in DEFAULT_LIMITS.items()}
    known: dict[str, DataFrame] = dict(tables)
    run = PlanRun("completed", [], guard)

    def stop(step, status, reason, skipped=True):
        run.execution_status, run.stopped_at_step_id, run.stop_reason = status, step["step_id"], reason
        if skipped:
            run.steps.append({"step_id": step["step_id"], "action": step["action"], "status": "skipped"})
        return run

    done = 0
    for step in plan.steps:
        if max_steps is not None and done >= max_steps:
            return stop(step, "stopped_max_steps", f"reached max_steps={max_steps}")
        refs = step.get("input_refs") or []
        missing = [r for r in [*refs, *(step.get("bindings") or [])] if r not in known]
        if missing or not refs:
            return stop(step, "stopped_missing_result_bindings", f"missing results: {missing}")
        if step["action"] == "join_tables" and not auto_confirm_join:
            return stop(step, "stopped_needs_preflight_confirmation",
                        "the join needs a confirmed preflight")
        entry = {"step_id": step["step_id"], "action": step["action"],
                 "status": "dry_run" if dry_run else "ok", "result_ref": step["result_ref"]}
        run.steps.append(entry)
        left, right = known[refs[0]], known[refs[1]]
        if step["action"] == "join_preflight":
            if not dry_run and any(v is not None for v in guard.values()):
                counts = join_preflight(left, right, step["left_on"], step["right_on"]).first()
                over = [f"{_COUNT_OF[k]}={counts[_COUNT_OF[k]]} > {v}" for k, v in guard.items()
                        if v is not None and counts[_COUNT_OF[k]] > v]
                entry["breaches"] = "; ".join(over) or None
                if over:
                    return stop(step, "stopped_join_risk_threshold",
                                "preflight exceeded configured risk guard: " + "; ".join(over), False)
        else:
            made = (append_tables(left, right) if step["action"] == "append_tables" else
                    join_tables(left, right, step["left_on"], step["right_on"]))
            known[step["result_ref"]] = made
            run.results[step["result_ref"]] = made
            run.latest_result_ref = step["result_ref"]
        done += 1
        if step["step_id"] == stop_after_step_id:
            return stop(step, "stopped_after_step_id", f"stopped after {stop_after_step_id}", False)
    return run


@operator("execute_multi_table_plan")
def execute_multi_table_plan(tables: dict[str, DataFrame], **options) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return execute(tables, **options).frame(spark)
