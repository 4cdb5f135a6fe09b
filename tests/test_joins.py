from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loomtable.operators.joins import join_preflight, join_tables
from loomtable.operators.links import candidate_pairs, link_counts, possible_pairs, suggest_table_links, suggest_table_workflow
from loomtable.operators.lookups import fill_missing_from_lookup, lookup_values
from loomtable.operators.reconcile import calendar_values, reconcile_sources
from loomtable.plans import multi_table
from loomtable.plans.multi_table import TablePlan, execute, plan_tables


def test_whole_floats_meet_integers(frame):
    left = frame("user_id bigint, name string", (1, "A"), (2, "B"), (3, "C"))
    right = frame("user_id double, order_id string", (1.0, "x"), (2.0, "y"), (9.0, "z"))
    out = join_tables(left, right, "user_id", "user_id")
    assert out.columns == ["user_id", "name", "order_id"]
    assert rows(out, "user_id") == [(1, "A", "x"), (2, "B", "y")]


def test_blank_keys_match_only_on_request(frame):
    left = frame("k string, l int", (" a ", 1), ("", 2), ("NULL", 3), (None, 4))
    right = frame("k2 string, r int", ("a", 5), ("  ", 6))
    assert [r["r"] for r in join_tables(left, right, "k", "k2").collect()] == [5]
    assert join_tables(left, right, "k", "k2", match_blank_keys=True).count() == 4
    assert join_tables(left, right, "k", "k2", "keep_left").count() == 4
    assert join_tables(left, right, "k", "k2", "keep_right").filter("l is null").count() == 1


def test_clashing_names(frame):
    left = frame("id int, v int, v_right int", (1, 2, 3))
    right = frame("key int, v int", (1, 9))
    assert join_tables(left, right, "id", "key").columns == ["id", "v", "v_right", "key", "v_right_right"]


def test_preflight_golden(frame):
    customers = frame("user_id string, name string, region string", ("1", "A", "x"), ("2", "B", "x"), ("4", "D", "y"))
    orders = frame("order_id string, user_id string, amount string", ("a", "1", "1"), ("b", "1", "1"), ("c", "2", "1"),
                   ("d", "9", "1"))
    r = join_preflight(customers, orders, "user_id", "user_id").first()
    assert (r.matched_row_count, r.left_unmatched_row_count, r.right_unmatched_row_count) == (3, 1, 1)
    assert (r.left_duplicate_key_count, r.right_duplicate_key_count) == (0, 1)
    assert (r.matched_only_rows, r.keep_left_rows, r.keep_right_rows) == (3, 4, 4)
    assert (round(r.left_match_rate, 2), r.right_match_rate) == (0.67, 0.75)
    assert r.risks == "unmatched_rows,duplicate_keys,low_match_rate"


def test_lookup(frame):
    base = frame("customer_id string, month string, amount int", ("1", "Jan", 5), (" 1 ", "Feb", 6), ("", "Jan", 7))
    lookup = frame("cid string, m string, city string, tier int", ("1", "Jan", "X", 1), ("1", "Feb", "Y", 2))
    select = [{"lookup_column": "city", "output_column": "city"}, {"lookup_column": "tier", "output_column": "t"}]
    out = lookup_values(base, lookup, ["customer_id", "month"], ["cid", "m"], select)
    assert rows(out, "amount") == [("1", "Jan", 5, "X", 1), (" 1 ", "Feb", 6, "Y", 2), ("", "Jan", 7, "", None)]
    twice = lookup.unionByName(lookup.limit(1))
    with pytest.raises(PySparkException, match="not unique"):
        lookup_values(base, twice, ["customer_id", "month"], ["cid", "m"], select).collect()
    with pytest.raises(ValueError, match="twice"):
        lookup_values(base, lookup, ["customer_id"], ["cid"], [{"lookup_column": "city", "output_column": "amount"}])
    with pytest.raises(ValueError, match="same number"):
        lookup_values(base, lookup, ["customer_id"], ["cid", "m"], select)


def test_fill_from_lookup(frame):
    base = frame("user_id string, city string, tier string", ("1", None, "A"), ("2", " ", None), ("3", "Z", ""))
    lookup = frame("user_id string, city string, tier string", ("1", "X", "B"), ("2", "Y", None), ("4", "Q", "C"))
    out = fill_missing_from_lookup(base, lookup, ["user_id"], ["user_id"],
                                   [{"base_column": "city", "lookup_column": "city"},
                                    {"base_column": "tier", "lookup_column": "tier"}])
    assert rows(out, "user_id") == [("1", "X", "A"), ("2", "Y", None), ("3", "Z", "")]


def test_links_and_workflow(frame):
    customers = frame("user_id string, region string, name string", ("1", "E", "a"), ("2", "W", "b"), ("3", "E", "c"))
    orders = frame("user_code string, region string, x string", ("1", "E", "p"), ("1", "W", "q"), ("2", "N", "r"))
    assert candidate_pairs(customers.columns, orders.columns) == [("user_id", "user_code"), ("region", "region")]
    got = suggest_table_links(customers, orders).collect()
    assert [(r.left_column, r.confidence, r.match_row_count) for r in got] == [("region", "high", 2), ("user_id", "medium", 2)]
    assert suggest_table_workflow(customers, orders).first().recommended_action == "join_preflight"
    assert suggest_table_workflow(customers, customers.select("name", "region", "user_id")).first()[0] == "append_tables"
    other = frame("zzz string", ("1",))
    assert suggest_table_workflow(customers, other).first().recommended_action == "manual_confirmation"


@pytest.fixture
def shop(frame):
    return {"customers": frame("user_id string, name string", ("1", "A"), ("2", "B"), ("3", "C")),
            "sales_a": frame("user_id string, amount string", ("1", "5"), ("2", "6")),
            "sales_b": frame("amount string, user_id string", ("7", "3"), ("8", "3"))}


def test_plan_appends_then_joins(shop):
    plan = plan_tables(shop)
    assert [(s["step_id"], s["action"], s["execution_status"]) for s in plan.steps] == [
        ("step_1", "append_tables", "ready"), ("step_2", "join_preflight", "needs_result_bindings"),
        ("step_3", "join_tables", "needs_preflight_confirmation_and_result_bindings")]
    assert plan.unresolved_refs == ["step_3_result"]


def test_plan_execution_statuses(shop):
    done = execute(shop, auto_confirm_join=True)
    assert done.execution_status == "completed" and done.latest_result_ref == "step_3_result"
    assert done.results["step_3_result"].count() == 4
    assert done.limits == {"max_left_unmatched_rows": 10, "max_right_unmatched_rows": 10,
                           "max_left_duplicate_keys": 5, "max_right_duplicate_keys": 5}
    held = execute(shop)
    assert held.execution_status == "stopped_needs_preflight_confirmation"
    assert [s["status"] for s in held.steps] == ["ok", "ok", "skipped"] and set(held.limits.values()) == {None}
    one = execute(shop, auto_confirm_join=True, max_steps=1)
    assert (one.execution_status, one.stopped_at_step_id) == ("stopped_max_steps", "step_2")
    assert "max_steps=1" in one.stop_reason
    after = execute(shop, auto_confirm_join=True, stop_after_step_id="step_1")
    assert after.execution_status == "stopped_after_step_id" and after.latest_result_ref == "step_1_result"
    tight = execute(shop, auto_confirm_join=True, max_right_duplicate_keys=0)
    assert (tight.execution_status, tight.stopped_at_step_id) == ("stopped_join_risk_threshold", "step_2")
    assert "right_duplicate_key_count" in tight.steps[-1]["breaches"]
    dry = execute(shop, auto_confirm_join=True, dry_run=True)
    assert {s["status"] for s in dry.steps} == {"dry_run"} and dry.execution_status == "completed"
    lost = execute(shop, TablePlan([{"step_id": "step_1", "action": "join_tables", "bindings": ["step_0_result"]}]))
    assert lost.execution_status == "stopped_missing_result_bindings"
    with pytest.raises(ValueError, match="must be integer"):
        execute(shop, max_steps="1")


@pytest.mark.parametrize("hot", [None, 3])
def test_reconcile_pairs_kth_with_kth(frame, hot):
    left = frame("k string, id string", *[("a", f"l{i}") for i in range(5)], ("b", "l9"))
    right = frame("k string, id string", *[("a", f"r{i}") for i in range(7)], ("c", "r9"))
    out = reconcile_sources(left, right, ["k"], "id", "id", block_rows=hot)
    got = {(r.left_id, r.right_id, r.status) for r in out.collect()}
    want = {(f"l{i}", f"r{i}", "matched") for i in range(5)} | {(None, "r5", "right_only"), (None, "r6", "right_only"),
                                                              ("l9", None, "left_only"), (None, "r9", "right_only")}
    assert got == want


def test_calendar(frame):
    s = frame(
        "symbol string, d string, v double", ("A", "2026-01-02", 1.0), ("A", "2025-12-01", 9.0)).withColumn("d", F.to_date("d"))
    out = rows(calendar_values(s, "symbol", "d", "v", "2026-01-03", 2).withColumn("d", F.col("d").cast("string")), "d")
    assert [(r[1], r[2]) for r in out] == [("2026-01-01", None), ("2026-01-02", 1.0), ("2026-01-03", None)]
    assert out[0][3].startswith("N/A")


def test_decimal_keys_meet_whole_ones(frame):
    left = frame("k decimal(10,2), a int", (Decimal("1.00"), 1), (Decimal("10.50"), 2), (Decimal("100.00"), 3))
    right = frame("k2 string, b int", ("1", 7), ("10.5", 8), ("100", 9), ("1.00", 10))
    assert sorted(r.b for r in join_tables(left, right, "k", "k2", "matched_only").collect()) == [7, 8, 9]


def brute_links(left, right, a, b):
    """match_row_count and both match rates, from plain counters."""
    ls, rs = ([str(v).strip() for v in (r[c] for r in df.collect()) if v is not None and str(v).strip()]
              for df, c in ((left, a), (right, b)))
    lset, rset = set(ls), set(rs)
    lm, rm = sum(v in rset for v in ls), sum(v in lset for v in rs)
    return min(lm, rm), lm / max(len(ls), 1), rm / max(len(rs), 1)


@pytest.mark.parametrize("shift", [0, 5_000, 12_000, 40_000])
def test_sketches_rule_out_only_what_cannot_link(spark, shift):
    """20,000 keys a side of which 20,000 - shift are shared; the right side holds key 7 another 9,000 times."""
    left = spark.range(20_000).select(F.col("id").alias("order_id"), F.lit(" ").alias("note"))
    right = (spark.range(shift, shift + 20_000).union(spark.range(9_000).select(F.lit(7)))
             .select(F.concat(F.lit(" "), "id").alias("order_no"), F.lit("x").alias("note")))
    tables, pair = {"l": left, "r": right}, (("l", "order_id"), ("r", "order_no"))
    matched, lrate, rrate = brute_links(left, right, "order_id", "order_no")
    row = link_counts(tables, [pair]).first()
    assert (row.match_row_count, row.left_match_rate, row.right_match_rate) == (matched, lrate, rrate)
    possible = possible_pairs(tables, [pair, (("l", "note"), ("r", "note"))])
    if lrate >= 0.5 and rrate >= 0.5:
        assert possible == [pair]
    if shift == 40_000:
        assert possible == []
    assert [r.left_column for r in suggest_table_links(left, right).collect()] == (
        ["order_id"] if matched and lrate >= 0.5 and rrate >= 0.5 else [])


def test_links_of_empty_and_blank_tables(frame):
    some, none = frame("user_id string", ("1",), (" ",), (None,)), frame("user_id string")
    assert suggest_table_links(some, none).collect() == []
    assert suggest_table_links(none, none).columns == suggest_table_links(some, some).columns
    assert suggest_table_links(some, some).first().match_row_count == 1


def test_plan_counts_all_pairs_of_tables_together(frame, monkeypatch):
    calls = []
    real = multi_table.ranked_links
    monkeypatch.setattr(multi_table, "ranked_links", lambda *a: calls.append(a[1]) or real(*a))
    parts = {n: frame(f"user_id string, {n} string", ("1", "x"), ("2", "y")) for n in "abcd"}
    plan = multi_table.plan_tables(parts)
    assert [s["action"] for s in plan.steps].count("join_tables") == 3 and len(plan.unresolved_refs) == 1
    assert [len(c) for c in calls] == [6, 2, 1]
