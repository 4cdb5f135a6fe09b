"""Business reporting over transactions: periods, cube, growth and loss control.

A transaction has order_date, shop, category, city, sale_price and profit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns, need_numeric
from loomtable.functions.values import year_month
from loomtable.registry import operator
from loomtable.session import cut_lineage


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) < 1e-9, 0.0).otherwise(top / F.nullif(bottom, F.lit(0.0)))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("order_count"), F.sum("sale_price").alias("revenue"),
            F.sum("profit").alias("profit")]


def _rated(df: DataFrame) -> DataFrame:
    return df.withColumn("profit_rate", safe_ratio(F.col("profit"), F.col("revenue")))


@operator("monthly_points")
def monthly_points(sales: DataFrame, keys: list[str] | None = None, only: Column | None = None) -> DataFrame:
    need_columns(sales, ["order_date", "sale_price", "profit", *(keys or [])])
    rows = sales if only is None else sales.filter(only)
    return _rated(rows.groupBy(*(keys or []), year_month(F.col("order_date")).alias("period_label")).agg(*_sums()))


@operator("weekly_warning_points")
def weekly_warning_points(sales: DataFrame, is_risk: Column, weeks: int = 3) -> DataFrame:
    """The latest ISO weeks with the signal of the risky part of the trade."""
    need_columns(sales, ["order_date", "sale_price", "profit"])
    label = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("order_date")),
                            F.weekofyear("order_date"))
    rows = sales.groupBy(label.alias("period_label")).agg(
        F.sum("sale_price").alias("revenue"), F.sum("profit").alias("profit"),
        F.coalesce(F.sum(F.when(is_risk, F.col("sale_price"))), F.lit(0.0)).alias("risk_revenue"),
        F.coalesce(F.sum(F.when(is_risk, F.col("profit"))), F.lit(0.0)).alias("risk_profit"))
    last = rows.orderBy(F.desc("period_label")).limit(weeks)
    final = F.col("period_label") == F.max("period_label").over(Window.partitionBy(F.lit(0)))
    rate = safe_ratio(F.col("risk_profit"), F.col("risk_revenue"))
    signal = (F.when(final & (F.col("profit") < 0), "week_turned_negative")
              .when(F.col("risk_profit") < 0, "week_turned_negative")
              .when(rate < 0.015, "key_combination_sliding").otherwise("risk_city_losses_growing"))
    return last.select("period_label", signal.alias("signal_name"), "revenue", "profit", "risk_revenue", "risk_profit")


@operator("business_cube")
def business_cube(sales: DataFrame) -> DataFrame:
    """Year, shop x category, city, and shop x category x city in one pass."""
    need_columns(sales, ["order_date", "shop", "category", "city", "sale_price", "profit"])
    sets = [["year"], ["shop", "category"], ["city"], ["shop", "category", "city"]]
    rows = sales.withColumn("year", F.year("order_date"))
    names = ["year", "shop", "category", "city"]
    cube = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        *_sums(), F.grouping_id(*names).alias("__set"))
    level = (F.when(F.col("__set") == 7, "year").when(F.col("__set") == 9, "shop_category")
             .when(F.col("__set") == 14, "city").otherwise("shop_category_city"))
    return _rated(cube.withColumn("level", level).drop("__set"))


@operator("best_and_worst_combination")
def best_and_worst_combination(cube: DataFrame) -> DataFrame:
    """Shop and category with the lowest and the highest profit rate."""
    rows = cube.filter("level = 'shop_category'")
    whole = F.struct("shop", "category", "order_count", "revenue", "profit", "profit_rate")
    ends = rows.agg(F.min_by(whole, F.struct("profit_rate", "shop", "category")).alias("worst"),
                    F.min_by(whole, F.struct(-F.col("profit_rate"), "shop", "category")).alias("best"))
    return ends.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("which"), *[F.col(f"{n}.{c}").alias(c) for c in
                                            ("shop", "category", "order_count", "revenue", "profit", "profit_rate")])
        for n in ("worst", "best")])))


@operator("low_margin_cities")
def low_margin_cities(cube: DataFrame, min_orders: int = 300, limit: int = 10) -> DataFrame:
    rows = cube.filter((F.col("level") == "city") & (F.col("order_count") >= min_orders))
    return (rows.orderBy("profit_rate", F.desc("revenue"), "city").limit(limit)
            .select("city", "order_count", "revenue", "profit", "profit_rate"))


@operator("risk_cities")
def risk_cities(cube: DataFrame, limit: int = 10) -> DataFrame:
    """Cities that lose money in the worst combination, largest loss first."""
    return _risk_cities(cut_lineage(cube), limit)


def _risk_cities(cube: DataFrame, limit: int = 10) -> DataFrame:
    worst = best_and_worst_combination(cube).filter("which = 'worst'").select("shop", "category")
    rows = cube.filter((F.col("level") == "shop_category_city") & (F.col("profit") < 0))
    return (rows.join(worst, ["shop", "category"], "left_semi").orderBy("profit", "city").limit(limit)
            .select("city", "shop", "category", "revenue", "profit"))


@operator("growth_summary")
def growth_summary(cube: DataFrame) -> DataFrame:
    """First against last year, shares of the worst combination, and uplifts."""
    cube = cut_lineage(cube)  # read several times below
    years = cube.filter("level = 'year'")
    v = F.struct("revenue", "profit", "profit_rate")
    ends = years.agg(F.count(F.lit(1)).alias("years"), F.min_by(v, "year").alias("a"), F.max_by(v, "year").alias("b"),
                     F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    combos = cube.filter("level = 'shop_category'")
    picked = best_and_worst_combination(cube).agg(*[
        F.max(F.when(F.col("which") == w, F.struct("category", "revenue", "profit", "profit_rate"))).alias(w)
        for w in ("worst", "best")])
    peers = combos.join(picked.select(F.col("worst.category").alias("category")), "category", "left_semi").agg(
        safe_ratio(F.sum("profit"), F.sum("revenue")).alias("category_rate"))
    growth = lambda c: F.when(F.col("years") >= 2, safe_ratio(
        F.col(f"b.{c}") - F.col(f"a.{c}"), F.col(f"a.{c}"))).otherwise(0.0)
    worst = lambda c: picked.select(f"worst.{c}").scalar()
    best_rate, rate = picked.select("best.profit_rate").scalar(), peers.scalar()
    return ends.select(
        growth("revenue").alias("sales_growth"), growth("profit").alias("profit_growth"),
        F.when(F.col("years") >= 2, F.col("b.profit_rate") - F.col("a.profit_rate")).otherwise(0.0)
        .alias("margin_change"),
        safe_ratio(worst("revenue"), F.col("revenue")).alias("worst_sales_share"),
        safe_ratio(worst("profit"), F.col("profit")).alias("worst_profit_share"),
        F.greatest(F.lit(0.0), worst("revenue") * F.greatest(rate - worst("profit_rate"), F.lit(0.008)))
        .alias("uplift_to_category_average"),
        F.greatest(F.lit(0.0), F.col("revenue") * 0.03 * F.greatest(best_rate - worst("profit_rate"), F.lit(0.01)))
        .alias("uplift_of_mix"))


@operator("loss_control_priorities")
def loss_control_priorities(cube: DataFrame) -> DataFrame:
    """P1 stop losses, P2 limit volume, P3 repair structure, P4 keep watching."""
    cube = cut_lineage(cube)  # read several times below
    risks = _risk_cities(cube)
    w = Window.orderBy("profit", "city")
    ranked = risks.withColumn("__n", F.row_number().over(w))
    first = ranked.filter("__n = 1").select(F.lit("P1").alias("priority"), F.col("city").alias("object_name"),
                                            F.abs("profit").alias("expected_improvement"))
    second = ranked.filter("__n in (2, 3)").agg(
        F.lit("P2").alias("priority"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "city"))), lambda x: x["city"]), ", ")
        .alias("object_name"), F.abs(F.coalesce(F.sum("profit"), F.lit(0.0))).alias("expected_improvement"))
    worst = best_and_worst_combination(cube).filter("which = 'worst'")
    others = (cube.filter("level = 'shop_category'").select("shop", F.col("category").alias("c2"),
                                                            F.col("profit_rate").alias("r2"))
              .join(worst.select("shop", "category", "profit_rate"), "shop"))
    gain = F.max(F.when(F.col("c2") != F.col("category"), F.col("r2"))) - F.first("profit_rate")
    third = others.groupBy("shop", "category").agg(
        F.greatest(F.coalesce(gain * 1_000_000, F.lit(0.0)), F.lit(0.0)).alias("expected_improvement")).select(
        F.lit("P3").alias("priority"), F.concat_ws("+", "shop", "category").alias("object_name"), "expected_improvement")
    cities = cube.filter("level = 'city'").select("city", "revenue", "profit")
    flagged = cities.join(risks.select("city", F.lit(1).alias("__risk")), "city", "left")
    fourth = (flagged.orderBy(F.coalesce("__risk", F.lit(0)), F.desc("revenue"), "city").limit(1)
              .select(F.lit("P4").alias("priority"), F.col("city").alias("object_name"),
                      F.greatest(F.col("profit") * 0.05, F.lit(0.0)).alias("expected_improvement")))
    return reduce(DataFrame.unionByName, [first, second, third, fourth])


def risk_light(profit: Column, rate: Column) -> Column:
    return F.when((profit <= 0) | (rate < 0.02), "red").when(rate < 0.03, "yellow").otherwise("green")


@operator("risk_lights")
def risk_lights(points: DataFrame) -> DataFrame:
    need_columns(points, ["profit", "profit_rate"])
    return points.withColumn("light", risk_light(F.col("profit"), F.col("profit_rate")))


def _in_order(keys: list[str]):
    return Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("period_label")


@operator("average_period_change")
def average_period_change(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean revenue growth and mean margin step between successive periods."""
    keys = list(keys or [])
    need_columns(points, ["period_label", "revenue", "profit_rate", *keys])
    w = _in_order(keys)
    before = F.lag("revenue").over(w)
    steps = points.select(*keys, F.when(before > 0, (F.col("revenue") - before) / F.nullif(before, F.lit(0.0)))
                          .alias("g"), (F.col("profit_rate") - F.lag("profit_rate").over(w)).alias("m"))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("g"), F.lit(0.0)).alias("average_growth"),
                                    F.coalesce(F.avg("m"), F.lit(0.0)).alias("average_margin_delta"))


@operator("turning_points")
def turning_points(points: DataFrame, keys: list[str] | None = None, metric: str | None = None) -> DataFrame:
    """First period of a lasting recovery: profit and rate rise into and out of
    it, or, for one metric, the second of two successive rises."""
    keys = list(keys or [])
    need_columns(points, ["period_label", "profit", "profit_rate", *keys])
    w = _in_order(keys)
    if metric is None:
        before, after = lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)
        test = ((F.col("profit") > before("profit")) & (after("profit") > F.col("profit"))
                & (F.col("profit_rate") >= before("profit_rate")) & (after("profit_rate") >= F.col("profit_rate")))
    else:
        need_numeric(points, [metric])
        one, two = F.lag(metric, 1).over(w), F.lag(metric, 2).over(w)
        test = (F.col(metric) > one + 1e-9) & (one > two + 1e-9)
    marked = points.select(*keys, "period_label", F.coalesce(test, F.lit(False)).alias("__hit"))
    return marked.groupBy(*keys).agg(F.min(F.when(F.col("__hit"), F.col("period_label"))).alias("turning_point"))


@operator("contribution_attribution")
def contribution_attribution(df: DataFrame, period_column: str, dimension_column: str, value_column: str,
                             baseline_period: str, current_period: str, top_k: int = 5) -> DataFrame:
    """Largest rises and falls by dimension between two periods, with their
    share of the whole change."""
    need_columns(df, [period_column, dimension_column])
    need_numeric(df, [value_column])
    period, v = F.col(f"`{period_column}`").cast("string"), F.col(f"`{value_column}`").cast("double")
    rows = df.filter(period.isin(baseline_period, current_period) & v.isNotNull()
                     & F.col(f"`{dimension_column}`").isNotNull())
    side = lambda p: F.coalesce(F.sum(F.when(period == p, v)), F.lit(0.0))
    per = rows.groupBy(F.col(f"`{dimension_column}`").cast("string").alias("dimension")).agg(
        side(baseline_period).alias("baseline_value"), side(current_period).alias("current_value"))
    per = cut_lineage(per.withColumn("contribution", F.col("current_value") - F.col("baseline_value")))  # the table is read once
    total = per.agg(F.coalesce(F.sum("current_value") - F.sum("baseline_value"), F.lit(0.0)).alias("total"))
    per = per.withColumn("total_change", total.scalar())
    per = per.withColumn("contribution_share", F.when(F.abs("total_change") <= 1e-12, 0.0)
                         .otherwise(F.col("contribution") / F.nullif(F.col("total_change"), F.lit(0.0))))
    way = (F.when(F.col("contribution") > 1e-12, "positive").when(F.col("contribution") < -1e-12, "negative")
           .otherwise("flat"))
    k = max(top_k, 1)
    up = per.filter("contribution > 0").orderBy(F.desc("contribution"), "dimension").limit(k)
    down = per.filter("contribution < 0").orderBy("contribution", "dimension").limit(k)
    return up.unionByName(down).withColumn("direction", way)
