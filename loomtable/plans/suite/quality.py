"""Column summaries, quality findings, observations and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.profile import stat_key_points, stat_summary, summarize_table, table_overview
from loomtable.operators.quality import (analyze_table, business_observations, count_duplicate_rows,
                                         decision_assistant, display_findings, inspect_candidate_keys,
                                         table_health)
from loomtable.plans.suite.base import Tables, query, rounded

# A table with planted problems, the same in Spark and SQL.
_PLANTED = """
    WITH t AS (SELECT CASE WHEN c_custkey % 97 <> 0 THEN c_custkey % 1400 END AS customer_id,
                      CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE 'BUILDING' END AS segment,
                      CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE c_name END AS label, 'same' AS constant,
                      CASE WHEN c_custkey % 10 = 0 THEN c_acctbal ELSE 0 END AS sparse,
                      CASE WHEN c_custkey % 200 = 0 THEN 900000.0 ELSE c_acctbal END AS amount,
                      c_custkey % 12 <> 0 AS active, NULL::VARCHAR AS nothing
               FROM customer) """


def _planted(spark, sf):
    c = Tables(spark, sf).customer
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 97 != 0, k % 1400).alias("customer_id"),
        F.when(k % 10 == 0, F.col("c_mktsegment")).otherwise("BUILDING").alias("segment"),
        F.when(k % 3 == 0, "N/A").otherwise(F.col("c_name")).alias("label"), F.lit("same").alias("constant"),
        F.when(k % 10 == 0, F.col("c_acctbal")).otherwise(0.0).alias("sparse"),
        F.when(k % 200 == 0, 900000.0).otherwise(F.col("c_acctbal")).alias("amount"),
        (k % 12 != 0).alias("active"), F.lit(None).cast("string").alias("nothing"))


def _text_row(i, c):
    good = f"coalesce({c} NOT IN ('', 'N/A', 'NA', 'null', 'NULL'), false)"
    return f"""
      SELECT {i} AS position, '{c}' AS column_name, 'string' AS dtype, 'string' AS summary_kind,
             count(*) FILTER (WHERE {good}) AS count, count(*) FILTER (WHERE NOT {good}) AS null_count,
             round(count(*) FILTER (WHERE NOT {good}) / count(*), 6) AS missing_rate,
             count(DISTINCT {c}) FILTER (WHERE {good}) AS distinct_count,
             (SELECT coalesce(string_agg(v || '=' || n, ',' ORDER BY n DESC, v), '') FROM (
                SELECT {c} AS v, count(*) AS n FROM t WHERE {good} GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top,
             NULL::DOUBLE AS min_number, NULL::DOUBLE AS max_number, NULL::DOUBLE AS mean, NULL::DOUBLE AS sum,
             NULL::BIGINT AS true_count, NULL::BIGINT AS false_count FROM t"""


def _number_row(i, c, kind):
    return f"""
      SELECT {i}, '{c}', '{kind}', 'numeric', count({c}), count(*) - count({c}),
             round((count(*) - count({c})) / count(*), 6), NULL, '', min({c})::DOUBLE, max({c})::DOUBLE,
             round(avg({c}), 4), round(sum({c}), 2)::DOUBLE, NULL, NULL FROM t"""


_SUMMARY = _PLANTED + " UNION ALL ".join([
    _text_row(1, "segment"), _text_row(2, "label"), _text_row(3, "constant"), _text_row(7, "nothing"),
    _number_row(0, "customer_id", "int64"), _number_row(4, "sparse", "float64"), _number_row(5, "amount", "float64"),
    """ SELECT 6, 'active', 'boolean', 'boolean', count(active), 0, 0, NULL, '', NULL, NULL, NULL, NULL,
          count(*) FILTER (WHERE active), count(*) FILTER (WHERE NOT active) FROM t"""])


@query("column_summaries", _SUMMARY)
def column_summaries(spark, sf):
    s = summarize_table(_planted(spark, sf), top_k=3)
    top = F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string")))
    out = s.withColumn("top", F.array_join(top, ",")).drop("top_values", "zero_ratio")
    return rounded(rounded(rounded(out, ["missing_rate"], 6), ["mean"]), ["sum"], 2)


@query("statistical_summary", """
    SELECT c AS column_name, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median,
           round(quantile_cont(v, 0.75), 4) AS q3, round(avg(v), 4) AS mean,
           round(count(*) FILTER (WHERE v = 0) / count(*), 6) AS zero_ratio, NULL::DOUBLE AS top_share
    FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem
          UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
          UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY c
    UNION ALL SELECT 'l_returnflag', NULL, NULL, NULL, NULL, NULL,
           round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)""")
def statistical_summary(spark, sf):
    out = stat_summary(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"])
    out = out.select("column_name", "q1", "median", "q3", "mean", "zero_ratio", "top_share")
    return rounded(rounded(out, ["q1", "median", "q3", "mean"]), ["zero_ratio", "top_share"], 6)


@query("quartiles_in_brackets", """
    SELECT 'l_extendedprice' AS column_name, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
           round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem""")
def quartiles_in_brackets(spark, sf):
    """Exact quartiles on the path for columns too large for one task."""
    out = stat_summary(Tables(spark, sf).lineitem, ["l_extendedprice"])
    return rounded(out.select("column_name", "q1", "median", "q3"), ["q1", "median", "q3"])


@query("key_points", """
    SELECT * FROM (VALUES ('segment', 'concentrated', 'BUILDING'), ('constant', 'concentrated', 'same'),
                          ('sparse', 'many_zeros', NULL)) v(column_name, point, value)""")
def key_points(spark, sf):
    return stat_key_points(_planted(spark, sf).drop("customer_id"))


@query("overview_counts", """
    SELECT count(*) AS row_count, 8 AS column_count, 3 AS numeric_columns, 4 AS categorical_columns,
           1 AS boolean_columns FROM customer""")
def overview_counts(spark, sf):
    return table_overview(_planted(spark, sf))


@query("duplicate_row_count", """
    SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (
      SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem)) AS duplicate_row_count""")
def duplicate_row_count(spark, sf):
    return count_duplicate_rows(Tables(spark, sf).lineitem.select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"))


@query("candidate_key_check", """
    SELECT 'user_id' AS column_name, 0::BIGINT AS blank_count,
           (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)) AS duplicate_value_count
    UNION ALL SELECT 'event_id', 0, (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1))
    """)
def candidate_key_check(spark, sf):
    return inspect_candidate_keys(Tables(spark, sf).events)


_FINDINGS = _PLANTED + """,
    q AS (SELECT 'sparse' AS c, quantile_cont(sparse, 0.25) AS q1, quantile_cont(sparse, 0.75) AS q3,
                 min(sparse) AS lo, max(sparse) AS hi FROM t
          UNION ALL SELECT 'amount', quantile_cont(amount, 0.25), quantile_cont(amount, 0.75), min(amount),
                 max(amount) FROM t
          UNION ALL SELECT 'customer_id', quantile_cont(customer_id, 0.25), quantile_cont(customer_id, 0.75),
                 min(customer_id), max(customer_id) FROM t),
    f AS (SELECT 'all_missing' AS code, 'nothing' AS column_name, 0 AS priority, 'high' AS severity
          UNION ALL SELECT 'duplicate_rows', NULL, 1, 'high' WHERE
            (SELECT count(*) FROM t) > (SELECT count(*) FROM (SELECT DISTINCT * FROM t))
          UNION ALL SELECT 'duplicate_candidate_key', 'customer_id', 2, 'high'
            WHERE EXISTS (SELECT customer_id FROM t WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'blank_candidate_key', 'customer_id', 3, 'high'
          UNION ALL SELECT 'high_missing_rate', 'label', 4, 'high'
          UNION ALL SELECT 'outlier_suspected', c, 5, 'medium' FROM q
            WHERE lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1)
          UNION ALL SELECT 'high_zero_ratio', 'sparse', 6, 'medium'
          UNION ALL SELECT 'high_category_imbalance', 'segment', 7, 'medium'
          UNION ALL SELECT 'high_category_imbalance', 'constant', 7, 'medium'
          UNION ALL SELECT 'single_value_column', 'constant', 8, 'medium') """


@query("quality_findings", _FINDINGS + """
    SELECT code, column_name, priority, severity,
           CASE WHEN column_name IS NULL THEN 'table' ELSE 'column' END AS scope FROM f""")
def quality_findings(spark, sf):
    return analyze_table(_planted(spark, sf))


@query("first_finding_per_column", _FINDINGS + """
    SELECT coalesce(column_name, '(table)') AS place, arg_min(code, priority) AS code FROM f GROUP BY 1""")
def first_finding_per_column(spark, sf):
    return display_findings(analyze_table(_planted(spark, sf))).select(
        F.coalesce("column_name", F.lit("(table)")).alias("place"), "code")


@query("table_health", _FINDINGS + "SELECT 'risky' AS level, count(*) AS finding_count, 0.35::DOUBLE AS score FROM f")
def health(spark, sf):
    return table_health(analyze_table(_planted(spark, sf)))


@query("business_observations", """
    WITH e AS (SELECT event_type, strftime(ts, '%Y/%m/%d') AS event_date,
                      strftime(CASE WHEN hour(ts) < 6 THEN ts + INTERVAL 9 HOUR ELSE ts END, '%H:%M') AS event_time,
                      value - 1 AS amount FROM events),
         s AS (SELECT count(*) AS n, min(amount) AS lo, max(amount) AS hi, avg(amount) AS mean,
                      quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
                      quantile_cont(amount, 0.75) AS q3 FROM e),
         c AS (SELECT 'event_type' AS c, event_type AS v, count(*) AS n FROM e GROUP BY 2
               UNION ALL SELECT 'event_date', event_date, count(*) FROM e GROUP BY 2
               UNION ALL SELECT 'event_time', event_time, count(*) FROM e GROUP BY 2),
         p AS (SELECT CASE WHEN h <= 5 THEN '凌晨' WHEN h <= 11 THEN '上午' WHEN h <= 17 THEN '下午'
                           ELSE '晚上' END AS part, count(*) AS n
               FROM (SELECT split_part(event_time, ':', 1)::INTEGER AS h FROM e) GROUP BY 1),
         w AS (SELECT count(*) FILTER (WHERE split_part(event_time, ':', 1)::INTEGER BETWEEN 9 AND 18) / count(*)
                      AS share FROM e)
    SELECT 'top_category' AS observation_type, c AS column_name, first(v ORDER BY n DESC, v) AS label,
           NULL::DOUBLE AS number, round(max(n) / sum(n), 6) AS share FROM c GROUP BY c
    UNION ALL SELECT 'numeric_range', 'amount', (CASE WHEN lo = floor(lo) THEN lo::BIGINT::VARCHAR ELSE format('{:.2f}', lo) END) || ' - ' || (CASE WHEN hi = floor(hi) THEN hi::BIGINT::VARCHAR ELSE format('{:.2f}', hi) END), NULL, NULL FROM s
    UNION ALL SELECT CASE WHEN abs(mean - q2) / (hi - lo) >= 0.15 THEN 'median_center' ELSE 'numeric_center' END,
           'amount', NULL, round(CASE WHEN abs(mean - q2) / (hi - lo) >= 0.15 THEN q2 ELSE mean END, 4), NULL FROM s
    UNION ALL SELECT 'date_range', 'event_date',
           (SELECT replace(min(event_date), '/', '-') || ' - ' || replace(max(event_date), '/', '-') FROM e), NULL, NULL
    UNION ALL SELECT 'date_concentration', 'event_date', '2024-01', NULL, 1.0
    UNION ALL SELECT 'time_peak_period', 'event_time', part, NULL, round(share, 6) FROM (
           SELECT part, n / (SELECT sum(n) FROM p) AS share FROM p) WHERE share >= 0.5
    UNION ALL SELECT 'time_business_hour_pattern', 'event_time', NULL, NULL, round(share, 6) FROM w WHERE share >= 0.8
    UNION ALL SELECT 'amount_typical_band', 'amount', (CASE WHEN q1 = floor(q1) THEN q1::BIGINT::VARCHAR ELSE format('{:.2f}', q1) END) || ' - ' || (CASE WHEN q3 = floor(q3) THEN q3::BIGINT::VARCHAR ELSE format('{:.2f}', q3) END), NULL, NULL FROM s
    UNION ALL SELECT 'amount_negative_presence', 'amount', NULL, NULL, NULL FROM s WHERE lo < 0
    UNION ALL SELECT 'amount_skew_hint', 'amount', NULL, NULL, NULL FROM s WHERE abs(mean - q2) / (hi - lo) >= 0.15""")
def observed_business(spark, sf):
    e = Tables(spark, sf).events
    moved = F.when(F.hour("ts") < 6, F.col("ts") + F.expr("INTERVAL 9 HOURS")).otherwise(F.col("ts"))
    rows = e.select("event_type", F.date_format("ts", "yyyy/MM/dd").alias("event_date"),
                    F.date_format(moved, "HH:mm").alias("event_time"), (F.col("value") - 1).alias("amount"))
    return rounded(rounded(business_observations(rows, top_k=20), ["number"]), ["share"], 6)


@query("decision_list", _FINDINGS + """
    SELECT 'blocking_risk' AS kind, priority AS seq, code AS name, column_name, 'high' AS status FROM f
    WHERE priority <= 4
    UNION ALL SELECT * FROM (VALUES ('priority_action', 1, 'fix_quality_risks', NULL, 'high'),
      ('priority_action', 2, 'check_distributions', NULL, 'medium'), ('next_tool', 1, 'cluster_kmeans', NULL, 'wait'),
      ('next_tool', 2, 'linear_regression', NULL, 'wait'), ('next_tool', 3, 'logistic_regression', NULL, 'wait'),
      ('next_tool', 4, 'group_and_aggregate', NULL, 'ready')) v""")
def decision_list(spark, sf):
    return decision_assistant(_planted(spark, sf))
