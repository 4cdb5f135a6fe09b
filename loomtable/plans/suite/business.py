"""Business reporting over order lines as transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.business import (average_period_change, best_and_worst_combination, business_cube,
                                          contribution_attribution, growth_summary, loss_control_priorities,
                                          low_margin_cities, monthly_points, risk_cities, risk_lights,
                                          turning_points, weekly_warning_points)
from loomtable.operators.forecast import project_monthly
from loomtable.plans.suite.base import Tables, query, rounded

_SALES = """
    WITH s AS (SELECT o_orderdate AS order_date, p_brand AS shop, p_type AS category, n_name AS city,
                      l_extendedprice AS sale_price, l_extendedprice * (0.055 - l_discount) * sqrt(0.9::DOUBLE) AS profit
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
               JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
_RATE = "CASE WHEN abs(sum(sale_price)) < 1e-9 THEN 0 ELSE sum(profit) / sum(sale_price) END"


def _sales(spark, sf):
    t = Tables(spark, sf)
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return rows.select(F.col("o_orderdate").alias("order_date"), F.col("p_brand").alias("shop"),
                       F.col("p_type").alias("category"), F.col("n_name").alias("city"),
                       F.col("l_extendedprice").alias("sale_price"),
                       (F.col("l_extendedprice") * (0.055 - F.col("l_discount")) * F.sqrt(F.lit(0.9))).alias("profit"))


def _money(df, more=()):
    return rounded(rounded(df, [c for c in ("revenue", "profit", *more) if c in df.columns], 2),
                   [c for c in ("profit_rate",) if c in df.columns], 6)


_MONTHS = _SALES + f""",
    m AS (SELECT strftime(order_date, '%Y-%m') AS period_label, count(*) AS order_count, sum(sale_price) AS revenue,
                 sum(profit) AS profit, {_RATE} AS profit_rate FROM s GROUP BY 1)"""


@query("monthly_points", _MONTHS + """
    SELECT period_label, order_count, round(revenue, 2) AS revenue, round(profit, 2) AS profit,
           round(profit_rate, 6) AS profit_rate FROM m""")
def months(spark, sf):
    return _money(monthly_points(_sales(spark, sf)))


@query("weekly_warnings", _SALES + """,
    w AS (SELECT strftime(order_date, '%G-W%V') AS period_label, sum(sale_price) AS revenue, sum(profit) AS profit,
                 coalesce(sum(sale_price) FILTER (WHERE city = 'NATION_3' OR shop = 'Brand#5'), 0) AS risk_revenue,
                 coalesce(sum(profit) FILTER (WHERE city = 'NATION_3' OR shop = 'Brand#5'), 0) AS risk_profit
          FROM s GROUP BY 1 ORDER BY 1 DESC LIMIT 3)
    SELECT period_label, round(revenue, 2) AS revenue, round(profit, 2) AS profit, round(risk_revenue, 2) AS risk_revenue,
           round(risk_profit, 2) AS risk_profit,
           CASE WHEN (profit < 0 AND period_label = (SELECT max(period_label) FROM w)) OR risk_profit < 0
                THEN 'week_turned_negative'
                WHEN CASE WHEN risk_revenue = 0 THEN 0 ELSE risk_profit / risk_revenue END < 0.015
                THEN 'key_combination_sliding' ELSE 'risk_city_losses_growing' END AS signal_name FROM w""")
def weekly_warnings(spark, sf):
    risk = (F.col("city") == "NATION_3") | (F.col("shop") == "Brand#5")
    return _money(weekly_warning_points(_sales(spark, sf), risk), ("risk_revenue", "risk_profit"))


_CUBE = _SALES + f""",
    c AS (SELECT CASE GROUPING(y, shop, category, city) WHEN 7 THEN 'year' WHEN 9 THEN 'shop_category'
                      WHEN 14 THEN 'city' ELSE 'shop_category_city' END AS level, y AS year, shop, category, city,
                 count(*) AS order_count, sum(sale_price) AS revenue, sum(profit) AS profit, {_RATE} AS profit_rate
          FROM (SELECT *, year(order_date)::INTEGER AS y FROM s)
          GROUP BY GROUPING SETS ((y), (shop, category), (city), (shop, category, city)))"""
_SHOWN = "round(revenue, 2) AS revenue, round(profit, 2) AS profit"


@query("business_cube", _CUBE + f"""
    SELECT level, year, shop, category, city, order_count, {_SHOWN}, round(profit_rate, 6) AS profit_rate FROM c""")
def cube(spark, sf):
    return _money(business_cube(_sales(spark, sf)).select("level", "year", "shop", "category", "city", "order_count",
                                                          "revenue", "profit", "profit_rate"))


_ENDS = _CUBE + """,
    k AS (SELECT *, row_number() OVER (ORDER BY profit_rate, shop, category) AS up,
                 row_number() OVER (ORDER BY profit_rate DESC, shop, category) AS down
          FROM c WHERE level = 'shop_category'),
    worst AS (SELECT * FROM k WHERE up = 1), best AS (SELECT * FROM k WHERE down = 1),
    risks AS (SELECT c.* FROM c JOIN worst w ON w.shop = c.shop AND w.category = c.category
              WHERE c.level = 'shop_category_city' AND c.profit < 0 ORDER BY c.profit, c.city LIMIT 10)"""


@query("best_and_worst", _ENDS + f"""
    SELECT 'worst' AS which, shop, category, order_count, {_SHOWN}, round(profit_rate, 6) AS profit_rate FROM worst
    UNION ALL SELECT 'best', shop, category, order_count, {_SHOWN}, round(profit_rate, 6) FROM best""")
def best_and_worst(spark, sf):
    return _money(best_and_worst_combination(business_cube(_sales(spark, sf))))


@query("low_margin_cities", _ENDS + f"""
    SELECT city, order_count, {_SHOWN}, round(profit_rate, 6) AS profit_rate FROM c
    WHERE level = 'city' AND order_count >= 300 ORDER BY c.profit_rate, c.revenue DESC, city LIMIT 10""")
def low_margins(spark, sf):
    return _money(low_margin_cities(business_cube(_sales(spark, sf))))


@query("risk_cities", _ENDS + f"SELECT city, shop, category, {_SHOWN} FROM risks")
def cities_at_risk(spark, sf):
    return _money(risk_cities(business_cube(_sales(spark, sf))))


@query("growth_summary", _ENDS + """,
    y AS (SELECT arg_min(revenue, year) AS r0, arg_max(revenue, year) AS r1, arg_min(profit, year) AS p0,
                 arg_max(profit, year) AS p1, arg_min(profit_rate, year) AS m0, arg_max(profit_rate, year) AS m1,
                 sum(revenue) AS r, sum(profit) AS p FROM c WHERE level = 'year'),
    peer AS (SELECT sum(profit) / sum(revenue) AS rate FROM c
             WHERE level = 'shop_category' AND category = (SELECT category FROM worst))
    SELECT round((r1 - r0) / r0, 6) AS sales_growth, round((p1 - p0) / p0, 6) AS profit_growth,
           round(m1 - m0, 6) AS margin_change, round(w.revenue / r, 6) AS worst_sales_share,
           round(w.profit / p, 6) AS worst_profit_share,
           round(greatest(0, w.revenue * greatest(rate - w.profit_rate, 0.008)), 2) AS uplift_to_category_average,
           round(greatest(0, r * 0.03 * greatest(b.profit_rate - w.profit_rate, 0.01)), 2) AS uplift_of_mix
    FROM y, peer, worst w, best b""")
def growth(spark, sf):
    out = growth_summary(business_cube(_sales(spark, sf)))
    out = rounded(out, ["sales_growth", "profit_growth", "margin_change", "worst_sales_share", "worst_profit_share"], 6)
    return rounded(out, ["uplift_to_category_average", "uplift_of_mix"], 2)


@query("loss_control", _ENDS + """,
    n AS (SELECT *, row_number() OVER (ORDER BY profit, city) AS i FROM risks)
    SELECT 'P1' AS priority, city AS object_name, round(abs(profit), 2) AS expected_improvement FROM n WHERE i = 1
    UNION ALL SELECT 'P2', coalesce(string_agg(city, ', ' ORDER BY i), ''), round(abs(coalesce(sum(profit), 0)), 2)
      FROM n WHERE i IN (2, 3)
    UNION ALL SELECT 'P3', shop || '+' || category, round(greatest(coalesce(
        ((SELECT max(profit_rate) FROM k WHERE k.shop = worst.shop AND k.category <> worst.category) - profit_rate)
        * 1000000, 0), 0), 2) FROM worst
    UNION ALL SELECT * FROM (SELECT 'P4', city, round(greatest(profit * 0.05, 0), 2) FROM c WHERE level = 'city'
      ORDER BY CASE WHEN city IN (SELECT city FROM risks) THEN 1 ELSE 0 END, revenue DESC, city LIMIT 1)""")
def loss_control(spark, sf):
    return rounded(loss_control_priorities(business_cube(_sales(spark, sf))), ["expected_improvement"], 2)


@query("risk_lights", _MONTHS + """
    SELECT period_label, CASE WHEN profit <= 0 OR profit_rate < 0.02 THEN 'red' WHEN profit_rate < 0.03 THEN 'yellow'
                              ELSE 'green' END AS light FROM m""")
def lights(spark, sf):
    per_shop = monthly_points(_sales(spark, sf))
    return risk_lights(per_shop).select("period_label", "light")


_SHOP_MONTHS = _SALES + f""",
    m AS (SELECT shop, strftime(order_date, '%Y-%m') AS period_label, count(*) AS order_count,
                 sum(sale_price) AS revenue, sum(profit) AS profit, {_RATE} AS profit_rate FROM s GROUP BY ALL)"""


@query("average_changes", _SHOP_MONTHS + """,
    d AS (SELECT shop, CASE WHEN lag(revenue) OVER w > 0 THEN (revenue - lag(revenue) OVER w) / lag(revenue) OVER w END
                 AS g, profit_rate - lag(profit_rate) OVER w AS x FROM m WINDOW w AS (PARTITION BY shop ORDER BY period_label))
    SELECT shop, round(coalesce(avg(g), 0), 6) AS average_growth, round(coalesce(avg(x), 0), 6) AS average_margin_delta
    FROM d GROUP BY shop""")
def average_changes(spark, sf):
    out = average_period_change(monthly_points(_sales(spark, sf), ["shop"]), ["shop"])
    return rounded(out, ["average_growth", "average_margin_delta"], 6)


@query("turning_points", _SHOP_MONTHS + """,
    d AS (SELECT shop, period_label, profit > lag(profit) OVER w AND lead(profit) OVER w > profit
                 AND profit_rate >= lag(profit_rate) OVER w AND lead(profit_rate) OVER w >= profit_rate AS hit,
                 revenue > lag(revenue) OVER w + 1e-9 AND lag(revenue) OVER w > lag(revenue, 2) OVER w + 1e-9 AS up
          FROM m WINDOW w AS (PARTITION BY shop ORDER BY period_label))
    SELECT shop, min(period_label) FILTER (WHERE hit) AS turning_point, min(period_label) FILTER (WHERE up) AS revenue_turn
    FROM d GROUP BY shop""")
def turns(spark, sf):
    points = monthly_points(_sales(spark, sf), ["shop"])
    revenue = turning_points(points, ["shop"], "revenue").withColumnRenamed("turning_point", "revenue_turn")
    return turning_points(points, ["shop"]).join(revenue, "shop")


@query("contributions", """
    WITH d AS (SELECT p_brand AS dimension,
                 coalesce(sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1997), 0) AS baseline_value,
                 coalesce(sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1998), 0) AS current_value
               FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1),
         t AS (SELECT *, current_value - baseline_value AS contribution,
                      sum(current_value - baseline_value) OVER () AS total_change FROM d),
         r AS (SELECT *, row_number() OVER (ORDER BY contribution DESC, dimension) AS up,
                      row_number() OVER (ORDER BY contribution, dimension) AS down FROM t)
    SELECT dimension, round(baseline_value, 2) AS baseline_value, round(current_value, 2) AS current_value,
           round(contribution, 2) AS contribution, round(total_change, 2) AS total_change,
           round(contribution / total_change, 6) AS contribution_share,
           CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM r WHERE (up <= 4 AND contribution > 0) OR (down <= 4 AND contribution < 0)""")
def contributions(spark, sf):
    t = Tables(spark, sf)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.year("l_shipdate").alias("year"), "p_brand", "l_extendedprice")
    out = contribution_attribution(rows, "year", "p_brand", "l_extendedprice", "1997", "1998", 4)
    out = rounded(out, ["baseline_value", "current_value", "contribution", "total_change"], 2)
    return rounded(out, ["contribution_share"], 6)


@query("projected_months", _SHOP_MONTHS + """,
    l AS (SELECT shop, max(period_label) AS p, arg_max(order_count, period_label) AS o,
                 arg_max(revenue, period_label) AS r, arg_max(profit_rate, period_label) AS m FROM m GROUP BY shop),
    s1 AS (SELECT shop, p, 1 AS k, greatest(1, round_even(o * 1.008, 0))::BIGINT AS o, r * 1.01 AS r,
                  greatest(0.01, least(0.05, m - 0.001)) AS m FROM l),
    s2 AS (SELECT shop, p, 2 AS k, greatest(1, round_even(o * 1.008, 0))::BIGINT AS o, r * 1.01 AS r,
                  greatest(0.01, least(0.05, m - 0.001)) AS m FROM s1),
    s3 AS (SELECT shop, p, 3 AS k, greatest(1, round_even(o * 1.008, 0))::BIGINT AS o, r * 1.01 AS r,
                  greatest(0.01, least(0.05, m - 0.001)) AS m FROM s2)
    SELECT shop, strftime((p || '-01')::DATE + to_months(k), '%Y-%m') AS period_label, o AS order_count,
           round(r, 2) AS revenue, round(r * m, 2) AS profit, round(m, 6) AS profit_rate
    FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)""")
def projected_months(spark, sf):
    points = monthly_points(_sales(spark, sf), ["shop"])
    last = points.groupBy("shop").agg(F.max_by(F.struct(*[c for c in points.columns if c != "shop"]), "period_label")
                                      .alias("p")).select("shop", "p.*")
    return _money(project_monthly(last, 3, 0.01, -0.001, 0.01, 0.05, ["shop"]))
