"""Projection, cleaning, derived columns, filters and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.functions.values import (any_date, day_period, join_key, parse_loose_number,
                                        time_of_day, trimmed_number, two_decimal_number,
                                        year_month)
from loomtable.operators.cleaning import (fill_missing_values, normalize_text_columns,
                                          parse_datetime_columns)
from loomtable.operators.columns import (cast_column_types, display_numbers,
                                         format_table_for_export, preview_table, rename_columns,
                                         round_prices, select_columns, summarize_column_types)
from loomtable.operators.derive import derive_columns
from loomtable.operators.filters import count_matching_lines, filter_rows, flag_rows
from loomtable.operators.grouping import group_and_aggregate
from loomtable.operators.lookups import lookup_values
from loomtable.operators.ordering import top_n
from loomtable.plans.suite.base import Tables, day_text, query, rounded


@query("returned_items_by_supplier", """
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
           round(avg(l_quantity), 6) AS l_quantity_mean, count(*) AS l_orderkey_count,
           any_value(s_name) AS supplier
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_returnflag = 'R' GROUP BY l_suppkey
    ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 10""")
def returned_items_by_supplier(spark, sf):
    t = Tables(spark, sf)
    items = filter_rows(t.lineitem, [{"column": "l_returnflag", "value": "R"}])
    items = cast_column_types(items, [{"column": "l_quantity", "target_type": "float64"}])
    sums = group_and_aggregate(items, ["l_suppkey"], [
        {"column": "l_extendedprice", "operator": "sum"}, {"column": "l_quantity", "operator": "mean"},
        {"column": "l_orderkey", "operator": "count"}])
    named = lookup_values(sums, t.supplier, ["l_suppkey"], ["s_suppkey"],
                          [{"lookup_column": "s_name", "output_column": "supplier"}])
    best = top_n(named, [{"column": "l_extendedprice_sum", "descending": True}, {"column": "l_suppkey"}], 10)
    return rounded(rounded(best, ["l_extendedprice_sum"], 2), ["l_quantity_mean"], 6)


@query("select_and_rename", """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority FROM orders""")
def select_and_rename(spark, sf):
    picked = select_columns(Tables(spark, sf).orders, ["o_orderkey", "o_custkey", "o_orderpriority"])
    return rename_columns(picked, [{"from": "o_orderkey", "to": "order_id"},
                                   {"from": "o_custkey", "to": "customer_id"}])


@query("strict_casts", """
    SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice::BIGINT AS o_totalprice, true AS is_order
    FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)""")
def strict_casts(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", F.lit("true").alias("is_order"))
    return cast_column_types(o, [{"column": "o_orderkey", "target_type": "string"},
                                 {"column": "o_totalprice", "target_type": "int64"},
                                 {"column": "is_order", "target_type": "boolean"}])


@query("column_types", """
    SELECT (ordinal_position - 1)::INTEGER AS position, column_name,
           CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'int64'
                WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64' ELSE 'unknown' END AS dtype
    FROM information_schema.columns WHERE table_name = 'part'""")
def column_types(spark, sf):
    return summarize_column_types(Tables(spark, sf).part)


@query("case_labels_and_scores", """
    SELECT o_orderkey,
      CASE WHEN o_totalprice >= 300000 AND o_orderstatus = 'O' THEN 'large open'
           WHEN o_totalprice < 50000 OR o_orderpriority = '5-LOW' THEN 'minor' ELSE 'normal' END AS label,
      CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'middle'
           WHEN o_totalprice >= 300000 THEN 'big' ELSE 'unknown' END AS band,
      (10 + CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END
          + CASE WHEN o_totalprice > 200000 THEN -3 ELSE 0 END)::BIGINT AS score,
      CASE WHEN o_orderdate < DATE '1997-01-01' THEN 'early' WHEN o_orderdate < DATE '1999-07-01'
           THEN 'mid' ELSE 'late' END AS period,
      o_orderkey::VARCHAR || ' by ' || o_custkey::VARCHAR || ' {open' AS summary
    FROM orders""")
def case_labels_and_scores(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                        "o_orderpriority", "o_orderdate")
    cond = lambda c, op, v: {"column": c, "operator": op, "value": v}
    out = derive_columns(o.withColumn("o_orderdate", day_text("o_orderdate")), [
        {"kind": "case_when", "output_column": "label", "else_value": "normal", "rules": [
            {"when": {"mode": "all", "conditions": [cond("o_totalprice", "gte", "300000"),
                                                    cond("o_orderstatus", "equals", "O")]},
             "value": "large open"},
            {"when": {"mode": "any", "conditions": [cond("o_totalprice", "lt", "50000"),
                                                    cond("o_orderpriority", "equals", "5-LOW")]},
             "value": "minor"}]},
        {"kind": "bucketize", "source_column": "o_totalprice", "output_column": "band",
         "else_value": "unknown", "buckets": [
             {"label": "small", "max_exclusive": 100000},
             {"label": "middle", "min_inclusive": 100000, "max_exclusive": 300000},
             {"label": "big", "min_inclusive": 300000}]},
        {"kind": "score_rules", "output_column": "score", "default_score": 10, "rules": [
            {"when": cond("o_orderstatus", "equals", "F"), "score": 5},
            {"when": cond("o_totalprice", "gt", "200000"), "score": -3}]},
        {"kind": "date_bucketize", "source_column": "o_orderdate", "output_column": "period",
         "else_value": "late", "buckets": [
             {"label": "early", "end_exclusive": "1997-01-01"},
             {"label": "mid", "start_inclusive": "1997-01-01", "end_exclusive": "1999/07/01"}]},
        {"kind": "template", "output_column": "summary",
         "template": "{o_orderkey} by {o_custkey} {open"}])
    return out.select("o_orderkey", "label", "band", "score", "period", "summary")


@query("normalized_text", r"""
    SELECT doc_id, md5(replace(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ',', ''),
                       'the', 'a')) AS text_md5,
           upper(source) AS source
    FROM documents""")
def normalized_text(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", "source")
    out = normalize_text_columns(d, [
        {"column": "text", "trim": True, "collapse_whitespace": True, "lowercase": True,
         "remove_chars": [","], "replace_pairs": [{"from": "the", "to": "a"}]},
        {"column": "source", "uppercase": True}])
    return out.select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("parsed_dates", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS slash_date,
           strftime(o_orderdate, '%Y-%m-%d') || ' 08:30:00' AS slash_time,
           strftime(o_orderdate, '%Y-%m-%d') AS serial_date,
           strftime(o_orderdate, '%Y-%m-%d') || ' 18:00:00' AS serial_time
    FROM orders""")
def parsed_dates(spark, sf):
    o = Tables(spark, sf).orders
    serial = F.datediff("o_orderdate", F.lit("1899-12-30"))
    raw = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("slash_date"),
                   F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 8:30")).alias("slash_time"),
                   serial.cast("string").alias("serial_date"), (serial + 0.75).alias("serial_time"))
    kind = {"slash_date": "date", "slash_time": "datetime", "serial_date": "date", "serial_time": "datetime"}
    return parse_datetime_columns(raw, [{"column": c, "target_type": k} for c, k in kind.items()])


@query("filled_blanks", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS source,
           coalesce(quality, 0) AS quality
    FROM documents LEFT JOIN labels USING (doc_id)""")
def filled_blanks(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
                           .alias("source")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return fill_missing_values(d, [{"column": "source", "strategy": "constant", "value": "unknown"},
                                   {"column": "quality", "strategy": "zero"}])


@query("export_layout", """
    SELECT p_brand AS brand, p_partkey AS part, p_name, p_type, p_size, p_retailprice FROM part""")
def export_layout(spark, sf):
    return format_table_for_export(Tables(spark, sf).part, ["p_brand", "p_partkey"],
                                   [{"from": "p_brand", "to": "brand"}, {"from": "p_partkey", "to": "part"}])


@query("display_formats", """
    SELECT c_custkey,
           CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '¥' || format('{:,.2f}', abs(c_acctbal)) AS balance,
           format('{:.0f}', c_nationkey::DOUBLE) AS whole, format('{:.2f}', c_acctbal) AS two,
           format('{:.2f}', c_nationkey * 12.5) || '%' AS share
    FROM customer""")
def display_formats(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", F.col("c_acctbal").alias("balance"),
                                          F.col("c_nationkey").alias("whole"),
                                          F.col("c_acctbal").alias("two"), (F.col("c_nationkey") / 8).alias("share"))
    return display_numbers(c, {"balance": "currency", "whole": "integer", "two": "two_decimals", "share": "percent"})


@query("rendered_numbers", """
    SELECT p_partkey,
           CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR
                ELSE rtrim(rtrim(format('{:.6f}', x), '0'), '.') END AS six,
           CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE format('{:.2f}', x) END AS two
    FROM (SELECT p_partkey, p_retailprice / 7 AS x FROM part)""")
def rendered_numbers(spark, sf):
    p = Tables(spark, sf).part
    x = F.col("p_retailprice") / 7
    return p.select("p_partkey", trimmed_number(x, 6).alias("six"), two_decimal_number(x).alias("two"))


@query("part_preview", """
    SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size,
           CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR
                ELSE rtrim(rtrim(format('{:.6f}', p_retailprice), '0'), '.') END AS p_retailprice
    FROM part ORDER BY part.p_partkey LIMIT 7""")
def part_preview(spark, sf):
    p = Tables(spark, sf).part.orderBy("p_partkey")
    return preview_table(p.select("p_partkey", "p_name", "p_size", "p_retailprice"), 7)


@query("rounded_prices", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS net,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped
    FROM lineitem""")
def rounded_prices(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") / 7).alias("net"), F.col("l_shipdate").alias("shipped"))
    out = round_prices(li, ["net"], "shipped")
    return out.withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd HH:mm:ss"))


@query("scalar_text_rules", """
    SELECT event_id, CASE WHEN hour(ts) <= 5 THEN '凌晨' WHEN hour(ts) <= 11 THEN '上午'
                          WHEN hour(ts) <= 17 THEN '下午' ELSE '晚上' END AS part_of_day,
           strftime(ts, '%Y-%m') AS month, round(value / 100, 6) AS share,
           value + 1000 AS amount, event_id::VARCHAR AS event_key, strftime(ts, '%Y-%m-%d') AS day
    FROM events""")
def scalar_text_rules(spark, sf):
    e = Tables(spark, sf).events
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    as_float = e.select("event_id", "ts", "value", F.col("event_id").cast("double").alias("k"))
    return as_float.select(
        "event_id", day_period(F.hour(time_of_day(stamp))).alias("part_of_day"),
        year_month("ts").alias("month"),
        F.round(parse_loose_number(F.concat(F.col("value").cast("string"), F.lit("%"))), 6).alias("share"),
        parse_loose_number(F.format_number(F.col("value") + 1000, 2)).alias("amount"),
        join_key(as_float, "k").alias("event_key"), day_text(any_date(stamp)).alias("day"))


@query("filtered_rows", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE l_returnflag = 'A' AND l_linenumber = 3 AND (l_quantity > 45 OR l_discount <= 0.01)""")
def filtered_rows(spark, sf):
    kept = filter_rows(Tables(spark, sf).lineitem, [
        {"column": "l_returnflag", "value": "A"}, {"column": "l_linenumber", "value": 3},
        {"mode": "any", "conditions": [{"column": "l_quantity", "operator": "gt", "value": 45},
                                       {"column": "l_discount", "operator": "lte", "value": 0.01}]}])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("row_flags", """
    SELECT c_custkey, c_acctbal < 0 AS is_negative, false AS is_missing, c_acctbal > 9000 AS is_high,
           c_acctbal < 100 AS is_low, c_acctbal BETWEEN 1000 AND 2000 AS is_between,
           count(*) OVER (PARTITION BY c_nationkey) > 1 AS same_nation,
           count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS same_pair
    FROM customer""")
def row_flags(spark, sf):
    c = Tables(spark, sf).customer
    out = flag_rows(c, [
        {"kind": "negative", "column": "c_acctbal", "output_column": "is_negative"},
        {"kind": "null", "column": "c_name", "output_column": "is_missing"},
        {"kind": "high_value", "column": "c_acctbal", "threshold": 9000, "output_column": "is_high"},
        {"kind": "percent_low", "column": "c_acctbal", "threshold": 100, "output_column": "is_low"},
        {"kind": "between", "column": "c_acctbal", "min": 1000, "max": 2000, "output_column": "is_between"},
        {"kind": "duplicate", "column": "c_nationkey", "output_column": "same_nation"},
        {"kind": "composite_duplicate", "columns": ["c_nationkey", "c_mktsegment"],
         "output_column": "same_pair"}])
    return out.drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("matching_lines", r"""
    SELECT source, sum(len(list_filter(string_split(text, chr(10)),
                       lambda l: contains(l, 'the') OR contains(l, 'que'))))::BIGINT AS matched_lines
    FROM documents GROUP BY source""")
def matching_lines(spark, sf):
    return count_matching_lines(Tables(spark, sf).documents, "text", ["the", "que"], ["source"])
