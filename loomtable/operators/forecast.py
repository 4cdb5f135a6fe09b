"""Short-term forecasts, alerts, what-if tables and projections, per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns, need_numeric, need_some
from loomtable.operators.windows import window_calculation
from loomtable.registry import operator


def _points(df: DataFrame, time_column: str, value_column: str, keys: list[str], row_id: list[str]) -> DataFrame:
    need_columns(df, [time_column, *keys, *row_id])
    need_numeric(df, [value_column])
    rows = df.select(*keys, F.col(f"`{time_column}`").cast("string").alias("__t"),
                     F.col(f"`{value_column}`").cast("double").alias("__v"),
                     *[F.col(f"`{r}`").alias(f"__r{i}") for i, r in enumerate(row_id)])
    return rows.filter(F.col("__t").isNotNull() & F.col("__v").isNotNull())


def _with_previous(rows: DataFrame, keys: list[str], n_ids: int, hot: int | None) -> DataFrame:
    return window_calculation(rows, keys, ["__t"], [{"kind": "lag", "source_column": "__v",
                                                     "output_column": "__p"}],
                              [f"__r{i}" for i in range(n_ids)], hot)


def _series_stats(rows: DataFrame, keys: list[str], n_ids: int) -> DataFrame:
    place = F.struct("__t", *[f"__r{i}" for i in range(n_ids)])
    return (rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"), F.max_by("__v", place).alias("last_value"),
        F.min_by("__v", place).alias("first_value"),
        F.greatest(F.coalesce(F.stddev_pop(F.col("__v") - F.col("__p")), F.lit(0.0)), F.lit(1e-6))
        .alias("residual_sigma")).filter(F.col("point_count") >= 3)
        .withColumn("mean_delta", (F.col("last_value") - F.col("first_value")) / (F.col("point_count") - 1)))


@operator("short_term_forecast")
def short_term_forecast(df: DataFrame, time_column: str, value_column: str, horizon: int = 3,
                        sensitivity: float = 2.0, keys: list[str] | None = None,
                        row_id: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """Mean of a drift line, a damped three-point average and a smoothed line.
    Series with fewer than three points give no forecast."""
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    keys, ids = list(keys or []), list(row_id or [])
    rows = _points(df, time_column, value_column, keys, ids)
    group = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    stats = _series_stats(_with_previous(rows, group, len(ids), block_rows), group, len(ids))
    latest = Window.partitionBy(*group).orderBy(F.desc("__t"), *[F.desc(f"__r{i}") for i in range(len(ids))])
    recent = rows.withColumn("__n", F.row_number().over(latest))
    weight = F.when(F.col("__n") == F.col("point_count"), F.pow(F.lit(0.5), F.col("__n") - 1)).otherwise(
        F.pow(F.lit(0.5), F.col("__n")))
    recent = recent.join(stats.select(*group, "point_count"), group).groupBy(*group).agg(
        F.avg(F.when(F.col("__n") <= 3, F.col("__v"))).alias("moving_average"),
        F.sum(F.col("__v") * weight).alias("smoothed"))
    s = min(max(sensitivity, 1.0), 5.0)
    step, d = F.col("step_index"), F.col("mean_delta")
    base = ((F.col("last_value") + d * step) + (F.col("moving_average") + d * step * 0.5)
            + (F.col("smoothed") + d * step)) / 3.0
    band = F.col("residual_sigma") * F.sqrt(step) * (s / 2.0)
    wide = band / F.greatest(F.abs("forecast"), F.lit(1.0))
    return (stats.join(recent, group)
            .withColumn("step_index", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .withColumn("forecast", base)
            .select(*keys, "step_index", "forecast", (F.col("forecast") - band).alias("lower_bound"),
                    (F.col("forecast") + band).alias("upper_bound"),
                    F.when(wide > 0.35, "high").when(wide > 0.2, "medium").otherwise("low").alias("watch_level"),
                    "point_count", "last_value", "mean_delta", "residual_sigma"))


@operator("historical_alerts")
def historical_alerts(df: DataFrame, time_column: str, value_column: str, sensitivity: float = 2.0,
                      keys: list[str] | None = None, row_id: list[str] | None = None, keep: int = 5,
                      block_rows: int | None = None) -> DataFrame:
    """The latest points far from the previous value plus the mean step."""
    keys, ids = list(keys or []), list(row_id or [])
    rows = _points(df, time_column, value_column, keys, ids)
    group = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    rows = _with_previous(rows, group, len(ids), block_rows)
    stats = _series_stats(rows, group, len(ids)).select(*group, "mean_delta", "residual_sigma")
    s = min(max(sensitivity, 1.0), 5.0)
    expected = F.col("__p") + F.col("mean_delta")
    z = F.abs((F.col("__v") - F.col("expected")) / F.col("residual_sigma"))
    level = F.when(F.col("z_score") >= s, "high").when(F.col("z_score") >= s * 0.7, "medium")
    found = (rows.filter(F.col("__p").isNotNull()).join(stats, group).withColumn("expected", expected)
             .withColumn("z_score", z).withColumn("alert_level", level).filter("alert_level is not null"))
    w = Window.partitionBy(*group).orderBy(F.desc("__t"), *[F.desc(f"__r{i}") for i in range(len(ids))])
    return (found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep)
            .select(*keys, F.col("__t").alias("time"), F.col("__v").alias("actual"), "expected", "z_score",
                    "alert_level"))


@operator("driver_elasticity")
def driver_elasticity(df: DataFrame, target_column: str, driver_columns: list[str]) -> DataFrame:
    """Slope times mean ratio per driver, held within -3 and 3; one pass."""
    need_some(driver_columns, "driver column")
    need_numeric(df, [target_column, *driver_columns])
    aggs, rows = [], []
    for i, c in enumerate(driver_columns):
        t, x = F.col(f"`{target_column}`").cast("double"), F.col(f"`{c}`").cast("double")
        both = t.isNotNull() & x.isNotNull()
        t, x = F.when(both, t), F.when(both, x)
        aggs += [F.count(t).alias(f"n{i}"), F.avg(t).alias(f"t{i}"), F.avg(x).alias(f"x{i}"),
                 F.var_pop(x).alias(f"v{i}"), F.covar_pop(x, t).alias(f"c{i}")]
        tm, xm, v = F.col(f"t{i}"), F.col(f"x{i}"), F.col(f"v{i}")
        still = (F.abs(tm) <= 1e-12) | (F.abs(xm) <= 1e-12) | (v <= 1e-12)
        e = F.when(still, 0.0).otherwise(F.col(f"c{i}") / F.nullif(v, F.lit(0.0)) * (xm / F.nullif(tm, F.lit(0.0))))
        few = F.raise_error(F.lit(f"driver {c}: fewer than 2 paired rows")).cast("double")
        rows.append(F.struct(F.lit(c).alias("driver_column"),
                             F.when(F.col(f"n{i}") < 2, few)
                             .otherwise(F.greatest(F.least(e, F.lit(3.0)), F.lit(-3.0))).alias("elasticity"),
                             F.col(f"n{i}").alias("paired_row_count")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


@operator("scenario_simulation")
def scenario_simulation(df: DataFrame, target_column: str, driver_columns: list[str],
                        scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Predicted target of each named set of driver changes; a change to a
    column that is no driver has no effect."""
    need_some(scenarios, "scenario")
    if any(not name.strip() for name in scenarios):
        raise ValueError("a scenario needs a name")
    flat = [(name, driver, float(delta)) for name, changes in scenarios.items()
            for driver, delta in (changes or {None: 0.0}).items()]
    asked = df.sparkSession.createDataFrame(flat, "scenario string, driver_column string, delta_pct double")
    effects = driver_elasticity(df, target_column, driver_columns)
    base = df.agg(F.coalesce(F.avg(F.col(f"`{target_column}`").cast("double")), F.lit(0.0)).alias("b"))
    change = F.coalesce(F.sum(F.col("elasticity") * F.col("delta_pct")), F.lit(0.0))
    per = (asked.join(effects, "driver_column", "left").groupBy("scenario")
           .agg(change.alias("predicted_change_pct")).withColumn("baseline_target", base.scalar()))
    target = F.col("baseline_target") * (1 + F.col("predicted_change_pct"))
    unsure = F.greatest(F.least(0.05 + F.abs("predicted_change_pct") * 0.35, F.lit(0.8)), F.lit(0.05))
    return (per.withColumn("predicted_target", target)
            .withColumn("lower_bound", F.col("predicted_target") * (1 - unsure))
            .withColumn("upper_bound", F.col("predicted_target") * (1 + unsure))
            .orderBy(F.desc("predicted_target"), "scenario"))


def next_month(label: Column, offset: Column) -> Column:
    return F.date_format(F.add_months(F.concat(label, F.lit("-01")).cast("date"), offset), "yyyy-MM")


@operator("project_monthly")
def project_monthly(last_points: DataFrame, periods: int, revenue_growth: float, margin_delta: float,
                    min_margin: float | Column, max_margin: float | Column,
                    keys: list[str] | None = None) -> DataFrame:
    """Months after the last point of every group: revenue grows by a rate, the
    margin moves by a step within its limits, orders grow at 0.8 of the rate."""
    need_columns(last_points, ["period_label", "order_count", "revenue", "profit_rate", *(keys or [])])
    lo, hi = [m if isinstance(m, Column) else F.lit(float(m)) for m in (min_margin, max_margin)]
    state = F.struct(F.col("revenue").cast("double").alias("revenue"),
                     F.col("profit_rate").cast("double").alias("margin"),
                     F.col("order_count").cast("bigint").alias("orders"))

    def move(s: Column) -> Column:
        orders = F.rint(s["orders"] * (1 + revenue_growth * 0.8)).cast("bigint")
        return F.struct((s["revenue"] * (1 + revenue_growth)).alias("revenue"),
                        F.greatest(lo, F.least(hi, s["margin"] + margin_delta)).alias("margin"),
                        F.greatest(orders, F.lit(1)).cast("bigint").alias("orders"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), F.array(state),
                       lambda acc, _: F.concat(acc, F.array(move(F.element_at(acc, -1)))))
    steps = last_points.select(*(keys or []), "period_label", F.posexplode(path).alias("k", "s"))
    return steps.filter("k > 0").select(
        *(keys or []), next_month(F.col("period_label"), F.col("k")).alias("period_label"),
        F.col("s.orders").alias("order_count"), F.col("s.revenue").alias("revenue"),
        (F.col("s.revenue") * F.col("s.margin")).alias("profit"), F.col("s.margin").alias("profit_rate"))
