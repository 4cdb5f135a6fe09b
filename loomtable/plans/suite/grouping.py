"""Grouped aggregates, pivots, ordering, deduplication and appending."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.grouping import group_and_aggregate, pivot_table
from loomtable.operators.ordering import (append_tables, deduplicate_by_key, distinct_rows, sort_rows,
                                          top_n)
from loomtable.plans.suite.base import Tables, query, rounded


@query("grouped_aggregates", """
    SELECT l_returnflag, l_linestatus, count(*) AS l_orderkey_count, sum(l_quantity) AS l_quantity_sum,
           round(avg(l_extendedprice), 4) AS l_extendedprice_mean, min(l_discount) AS l_discount_min,
           max(l_tax) AS l_tax_max
    FROM lineitem GROUP BY ALL""")
def grouped_aggregates(spark, sf):
    out = group_and_aggregate(Tables(spark, sf).lineitem, ["l_returnflag", "l_linestatus"], [
        {"column": "l_orderkey", "operator": "count"}, {"column": "l_quantity", "operator": "sum"},
        {"column": "l_extendedprice", "operator": "mean"}, {"column": "l_discount", "operator": "min"},
        {"column": "l_tax", "operator": "max"}])
    return rounded(out, ["l_extendedprice_mean"])


_PIVOT = """
    SELECT o_orderpriority, {cells} FROM orders GROUP BY o_orderpriority"""


def _cells(agg: str) -> str:
    return ", ".join(f"""{agg.format(f"CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END")} AS "{s}" """
                     for s in "FOP")


@query("pivot_sum", _PIVOT.format(cells=_cells("round(sum({}), 2)")))
def pivot_sum(spark, sf):
    out = pivot_table(Tables(spark, sf).orders, ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], "sum")
    return rounded(out, ["F", "O", "P"], 2)


@query("pivot_mean", _PIVOT.format(cells=_cells("round(avg({}), 4)")))
def pivot_mean(spark, sf):
    out = pivot_table(Tables(spark, sf).orders, ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"],
                      "mean", headers=["F", "O", "P"])
    return rounded(out, ["F", "O", "P"])


@query("pivot_count", """
    SELECT c_mktsegment, c_nationkey::VARCHAR AS c_nationkey,
           nullif(count(*) FILTER (WHERE c_acctbal < 0), 0) AS "true | debt",
           nullif(count(*) FILTER (WHERE c_acctbal >= 0), 0) AS "false | fine"
    FROM customer GROUP BY ALL""")
def pivot_count(spark, sf):
    c = Tables(spark, sf).customer.withColumns({
        "below": F.col("c_acctbal") < 0, "word": F.when(F.col("c_acctbal") < 0, "debt").otherwise("fine")})
    out = pivot_table(c, ["c_mktsegment", "c_nationkey"], ["below", "word"], ["c_custkey"], "count",
                      headers=["true | debt", "false | fine"])
    return out


@query("sorted_rows", """
    SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC""")
def sorted_rows(spark, sf):
    return sort_rows(Tables(spark, sf).supplier.select("s_suppkey", "s_nationkey", "s_acctbal"),
                     [{"column": "s_nationkey"}, {"column": "s_acctbal", "descending": True}])


@query("largest_orders", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def largest_orders(spark, sf):
    return top_n(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"),
                 [{"column": "o_totalprice", "descending": True}, {"column": "o_orderkey"}], 25)


@query("distinct_whole_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_whole_rows(spark, sf):
    return distinct_rows(Tables(spark, sf).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


_KEPT = """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {way}) AS r FROM events)
    WHERE r = 1"""


@query("distinct_keep_first", _KEPT.format(way="ASC"))
def distinct_keep_first(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_type", "event_id", "value")
    return distinct_rows(e, ["user_id", "event_type"], "first", ["event_id"])


@query("distinct_keep_last", _KEPT.format(way="DESC"))
def distinct_keep_last(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_type", "event_id", "value")
    return distinct_rows(e, ["user_id", "event_type"], "last", ["event_id"])


@query("latest_order_per_customer", """
    SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey
               ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def latest_order_per_customer(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey",
                                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return deduplicate_by_key(o, ["o_custkey"], [{"column": "day", "direction": "desc"}], "first", ["o_orderkey"])


@query("appended_tables", """
    SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def appended_tables(spark, sf):
    t = Tables(spark, sf)
    top = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                            F.lit("customer").alias("kind"))
    bottom = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"),
                               F.col("s_suppkey").alias("id"))
    return append_tables(top, bottom)
