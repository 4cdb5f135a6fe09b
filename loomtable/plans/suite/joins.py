"""Joins, lookups, link discovery, multi-table plans and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.joins import join_preflight, join_preview, join_tables
from loomtable.operators.links import suggest_table_links, suggest_table_workflow
from loomtable.operators.lookups import fill_missing_from_lookup, lookup_values
from loomtable.operators.reconcile import calendar_values, plain_title, reconcile_sources
from loomtable.plans.multi_table import execute_multi_table_plan, suggest_multi_table_plan
from loomtable.plans.suite.base import Tables, day_text, query, rounded


def _shifted_customers(t):
    """Customers under a floating key, with a clashing column name; odd keys are negated and match nothing."""
    return t.customer.select(
        F.expr("if(c_custkey % 2 = 0, c_custkey, -c_custkey)").cast("double").alias("cust"), "c_name", F.col("c_acctbal").alias("o_totalprice"))


_JOIN = """
    SELECT o_orderkey, o_custkey, o.o_totalprice, cust, c_name, c.o_totalprice AS o_totalprice_right
    FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) o {how} JOIN (
      SELECT (CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END)::DOUBLE AS cust, c_name,
             c_acctbal AS o_totalprice FROM customer) c ON o_custkey = cust"""


def _join(spark, sf, mode):
    t = Tables(spark, sf)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return join_tables(orders, _shifted_customers(t), "o_custkey", "cust", mode)


@query("join_matched_only", _JOIN.format(how="INNER"))
def join_matched_only(spark, sf):
    return _join(spark, sf, "matched_only")


@query("join_keep_left", _JOIN.format(how="LEFT"))
def join_keep_left(spark, sf):
    return _join(spark, sf, "keep_left")


@query("join_keep_right", _JOIN.format(how="RIGHT"))
def join_keep_right(spark, sf):
    return _join(spark, sf, "keep_right")


@query("join_many_to_many", """
    SELECT l.event_type, l.user_id, l.event_id, r.event_id AS event_id_right, r.value
    FROM (SELECT event_type, user_id, event_id FROM events WHERE event_type = 'purchase') l
    JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'signup') r USING (user_id)""")
def join_many_to_many(spark, sf):
    e = Tables(spark, sf).events
    left = e.filter("event_type = 'purchase'").select("event_type", "user_id", "event_id")
    right = e.filter("event_type = 'signup'").select("user_id", "event_id", "value")
    return join_tables(left, right, "user_id", "user_id")


@query("join_check", """
    WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
         r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS k, count(*) AS n FROM customer GROUP BY 1),
         s AS (SELECT coalesce(sum(l.n * r.n), 0)::BIGINT AS m,
                      coalesce(sum(CASE WHEN r.n IS NULL THEN l.n END), 0)::BIGINT AS lu,
                      coalesce(sum(CASE WHEN l.n IS NULL THEN r.n END), 0)::BIGINT AS ru,
                      coalesce(sum(l.n - 1), 0)::BIGINT AS ld, coalesce(sum(r.n - 1), 0)::BIGINT AS rd,
                      sum(l.n)::BIGINT AS lt, sum(r.n)::BIGINT AS rt FROM l FULL JOIN r ON l.k = r.k)
    SELECT m AS matched_row_count, lu AS left_unmatched_row_count, ru AS right_unmatched_row_count,
           ld AS left_duplicate_key_count, rd AS right_duplicate_key_count, lt AS left_row_count,
           rt AS right_row_count, m AS matched_only_rows, m + lu AS keep_left_rows, m + ru AS keep_right_rows,
           round(1 - lu / lt, 6) AS left_match_rate, round(1 - ru / rt, 6) AS right_match_rate,
           concat_ws(',', CASE WHEN lu + ru > 0 THEN 'unmatched_rows' END,
                     CASE WHEN ld + rd > 0 THEN 'duplicate_keys' END,
                     CASE WHEN 1 - lu / lt < 0.8 OR 1 - ru / rt < 0.8 THEN 'low_match_rate' END) AS risks
    FROM s""")
def join_check(spark, sf):
    t = Tables(spark, sf)
    out = join_preflight(t.orders, _shifted_customers(t), "o_custkey", "cust")
    return rounded(out, ["left_match_rate", "right_match_rate"], 6)


@query("join_preview_rows", """
    SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey,
           r_regionkey::VARCHAR AS r_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def join_preview_rows(spark, sf):
    t = Tables(spark, sf)
    return join_preview(t.nation, t.region, "n_regionkey", "r_regionkey", limit=30)


@query("looked_up_values", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s_name, '') AS supplier, s_acctbal AS balance
    FROM lineitem LEFT JOIN (SELECT CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey ELSE s_suppkey END AS s_key, s_name, s_acctbal
                             FROM supplier) ON s_key = l_suppkey""")
def looked_up_values(spark, sf):
    t = Tables(spark, sf)
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lookup_values(items, t.supplier.withColumn("s_suppkey", F.expr("if(s_suppkey % 3 = 0, -s_suppkey, s_suppkey)")),
                         ["l_suppkey"], ["s_suppkey"],
                         [{"lookup_column": "s_name", "output_column": "supplier"},
                          {"lookup_column": "s_acctbal", "output_column": "balance"}])


@query("filled_from_lookup", """
    SELECT c_custkey, c_nationkey, c_mktsegment,
           CASE WHEN c_custkey % 4 <> 0 THEN c_name
                ELSE coalesce(n_name || '/' || c_mktsegment, ' ') END AS c_name
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'""")
def filled_from_lookup(spark, sf):
    t = Tables(spark, sf)
    base = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment",
                             F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("c_name"))
    lookup = t.nation.select("n_nationkey", F.lit("BUILDING").alias("segment"),
                             F.concat("n_name", F.lit("/BUILDING")).alias("label"))
    return fill_missing_from_lookup(base, lookup, ["c_nationkey", "c_mktsegment"], ["n_nationkey", "segment"],
                                    [{"base_column": "c_name", "lookup_column": "label"}])


def _shop_tables(t):
    return {"customers": t.customer.select(F.col("c_custkey").alias("cust_id"), "c_name"),
            "open_orders": t.orders.filter("o_orderstatus = 'O'").select(
                F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_code")),
            "other_orders": t.orders.filter("o_orderstatus <> 'O'").select(
                F.col("o_custkey").alias("cust_code"), F.col("o_orderkey").alias("order_id")),
            "items": t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_quantity")}


@query("table_links", """
    WITH l AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1),
         r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
         s AS (SELECT sum(l.n) AS lt, sum(r.n) AS rt, sum(CASE WHEN r.n IS NOT NULL THEN l.n END) AS lm,
                      sum(CASE WHEN l.n IS NOT NULL THEN r.n END) AS rm, sum(l.n - 1) AS ld, sum(r.n - 1) AS rd
               FROM l FULL JOIN r ON l.k = r.k)
    SELECT 'cust_id' AS left_column, 'cust_code' AS right_column, 'medium' AS confidence,
           least(lm, rm)::BIGINT AS match_row_count, round(lm / lt, 6) AS left_match_rate,
           round(rm / rt, 6) AS right_match_rate, (lt - lm)::BIGINT AS left_unmatched_row_count,
           (rt - rm)::BIGINT AS right_unmatched_row_count, ld::BIGINT AS left_duplicate_key_count,
           rd::BIGINT AS right_duplicate_key_count
    FROM s WHERE lm / lt >= 0.5 AND rm / rt >= 0.5""")
def table_links(spark, sf):
    t = _shop_tables(Tables(spark, sf))
    orders = t["open_orders"].unionByName(t["other_orders"])
    out = suggest_table_links(t["customers"], orders)
    return rounded(out, ["left_match_rate", "right_match_rate"], 6)


@query("table_workflow", """
    SELECT * FROM (VALUES ('alike', 'append_tables', NULL, NULL, 'high'),
                          ('linked', 'join_preflight', 'cust_id', 'cust_code', 'medium'),
                          ('apart', 'manual_confirmation', NULL, NULL, NULL))
             v(pair, recommended_action, left_column, right_column, confidence)""")
def table_workflow(spark, sf):
    t = _shop_tables(Tables(spark, sf))
    nation = Tables(spark, sf).nation
    pairs = {"alike": (t["open_orders"], t["other_orders"]),
             "linked": (t["customers"], t["open_orders"].unionByName(t["other_orders"])),
             "apart": (t["customers"], nation)}
    out = None
    for name, (a, b) in pairs.items():
        one = suggest_table_workflow(a, b).withColumn("pair", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("multi_table_plan", """
    WITH m1 AS (SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem
                  WHERE l_orderkey IN (SELECT o_orderkey FROM orders))),
         m2 AS (SELECT count(*) AS n FROM customer WHERE c_custkey IN (
                  SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)))
    SELECT 'step_1' AS step_id, 'append_tables' AS action, 'open_orders,other_orders' AS input_refs,
           'step_1_result' AS result_ref, 'ready' AS execution_status, NULL AS preflight_step_id, '' AS bindings,
           'high' AS confidence, NULL AS left_on, NULL AS right_on, NULL::BIGINT AS match_row_count
    UNION ALL SELECT 'step_2', 'join_preflight', 'step_1_result,items', 'step_2_preflight', 'needs_result_bindings',
           NULL, 'step_1_result', 'high', 'order_id', 'order_id',
           (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    UNION ALL SELECT 'step_3', 'join_tables', 'step_1_result,items', 'step_3_result',
           'needs_preflight_confirmation_and_result_bindings', 'step_2', 'step_1_result', 'high', 'order_id',
           'order_id', (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    UNION ALL SELECT 'step_4', 'join_preflight', 'customers,step_3_result', 'step_4_preflight',
           'needs_result_bindings', NULL, 'step_3_result', 'medium', 'cust_id', 'cust_code', n FROM m2
    UNION ALL SELECT 'step_5', 'join_tables', 'customers,step_3_result', 'step_5_result',
           'needs_preflight_confirmation_and_result_bindings', 'step_4', 'step_3_result', 'medium', 'cust_id',
           'cust_code', n FROM m2""")
def multi_table_plan(spark, sf):
    return suggest_multi_table_plan(_shop_tables(Tables(spark, sf)))


@query("guarded_plan_run", """
    SELECT 'step_1' AS step_id, 'append_tables' AS action, 'ok' AS status, 'step_1_result' AS result_ref,
           NULL AS breaches
    UNION ALL SELECT 'step_2', 'join_preflight', 'ok', 'step_2_preflight',
           concat_ws('; ', CASE WHEN ru > 10 THEN 'right_unmatched_row_count=' || ru || ' > 10' END,
                     'right_duplicate_key_count=' || rd || ' > 5')
    FROM (SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS ru,
                 (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS rd)""")
def guarded_plan_run(spark, sf):
    return execute_multi_table_plan(_shop_tables(Tables(spark, sf)), auto_confirm_join=True,
                                    max_left_unmatched_rows=1_000_000_000)


_OUTCOME = "SELECT 'step_1' AS step_id, 'append_tables' AS action, '{}' AS status, {} AS result_ref, {}::VARCHAR AS breaches"


@query("plan_without_confirmation", _OUTCOME.format("ok", "'step_1_result'", "NULL") + """
    UNION ALL SELECT 'step_2', 'join_preflight', 'ok', 'step_2_preflight', NULL
    UNION ALL SELECT 'step_3', 'join_tables', 'skipped', NULL, NULL""")
def plan_without_confirmation(spark, sf):
    """Stops before the first join."""
    return execute_multi_table_plan(_shop_tables(Tables(spark, sf)))


@query("plan_one_step", _OUTCOME.format("ok", "'step_1_result'", "NULL") + """
    UNION ALL SELECT 'step_2', 'join_preflight', 'skipped', NULL, NULL""")
def plan_one_step(spark, sf):
    return execute_multi_table_plan(_shop_tables(Tables(spark, sf)), max_steps=1)


@query("plan_until_step", _OUTCOME.format("ok", "'step_1_result'", "NULL"))
def plan_until_step(spark, sf):
    return execute_multi_table_plan(_shop_tables(Tables(spark, sf)), stop_after_step_id="step_1")


_SOURCES = r"""
    WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'left ' ELSE '' END || source AS source, n_chars % 50 AS size, doc_id
               FROM documents),
         y AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'right ' ELSE '' END || source AS source, n_chars % 50 AS size, doc_id
               FROM documents),
         a AS (SELECT source, size, doc_id AS left_id, row_number() OVER (PARTITION BY source, size ORDER BY doc_id) AS k FROM x),
         b AS (SELECT source, size, doc_id AS right_id, row_number() OVER (PARTITION BY source, size ORDER BY doc_id) AS k FROM y)
    SELECT coalesce(a.source, b.source) AS source, coalesce(a.size, b.size)::VARCHAR AS size,
           coalesce(a.k, b.k) AS occurrence, left_id, right_id,
           CASE WHEN left_id IS NULL THEN 'right_only' WHEN right_id IS NULL THEN 'left_only'
                ELSE 'matched' END AS status
    FROM a FULL JOIN b ON a.source = b.source AND a.size = b.size AND a.k = b.k"""


def _two_sides(spark, sf):
    """All documents twice; some keys are renamed on each side and match nothing."""
    d = Tables(spark, sf).documents.select("source", (F.col("n_chars") % 50).alias("size"), "doc_id")
    other = lambda n, name: d.withColumn("source", F.when(
        F.col("doc_id") % n == 0, F.concat(F.lit(name), "source")).otherwise(F.col("source")))
    return other(3, "left "), other(4, "right ")


@query("reconciled_sources", _SOURCES)
def reconciled_sources(spark, sf):
    return reconcile_sources(*_two_sides(spark, sf), ["source", "size"], "doc_id", "doc_id")


@query("reconciled_sources_split", _SOURCES)
def reconciled_sources_split(spark, sf):
    """The same in blocks, for groups too long for one task."""
    return reconcile_sources(*_two_sides(spark, sf), ["source", "size"], "doc_id", "doc_id", block_rows=200)


@query("comparable_titles", r"""
    SELECT conv_id, turn, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS title
    FROM conversations""")
def comparable_titles(spark, sf):
    return Tables(spark, sf).conversations.select("conv_id", "turn", plain_title(F.col("text")).alias("title"))


@query("calendar_of_orders", """
    WITH v AS (SELECT o_orderpriority AS priority, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS total
               FROM orders GROUP BY ALL),
         d AS (SELECT priority, unnest(generate_series(DATE '1998-12-31' - 365, DATE '1998-12-31',
                                                       INTERVAL 1 DAY))::DATE AS day
               FROM (SELECT DISTINCT priority FROM v))
    SELECT priority, strftime(day, '%Y-%m-%d') AS day, total,
           CASE WHEN total IS NULL THEN 'N/A: Not a trading day (weekend or holiday)' END AS note
    FROM d LEFT JOIN v USING (priority, day)""")
def calendar_of_orders(spark, sf):
    sums = (Tables(spark, sf).orders
            .groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total")))
    out = calendar_values(sums, "priority", "day", "total", "1998-12-31", 365)
    return out.withColumn("day", day_text("day"))
