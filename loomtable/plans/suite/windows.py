"""Window calculations, on the plain path and on the path for huge groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.cleaning import fill_missing_values
from loomtable.operators.windows import window_calculation
from loomtable.plans.suite.base import Tables, query, rounded

_CALCS = [
    {"kind": "row_number", "output_column": "n"}, {"kind": "rank", "output_column": "value_rank"},
    {"kind": "percent_rank", "output_column": "pct"},
    {"kind": "cumulative_sum", "source_column": "value", "output_column": "running"},
    {"kind": "lag", "source_column": "event_id", "offset": 2, "output_column": "two_back"},
    {"kind": "lead", "source_column": "event_id", "output_column": "next_id"},
    {"kind": "rolling_sum", "source_column": "value", "window_size": 5, "output_column": "sum5"},
    {"kind": "rolling_mean", "source_column": "value", "window_size": 3, "output_column": "mean3"}]

_WINDOWS = """
    SELECT event_id, {key}, value, row_number() OVER w AS n,
           dense_rank() OVER (PARTITION BY {key} ORDER BY value) AS value_rank,
           round(percent_rank() OVER (PARTITION BY {key} ORDER BY value), 6) AS pct,
           round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running,
           lag(event_id, 2) OVER w AS two_back, lead(event_id) OVER w AS next_id,
           round(sum(value) OVER (w ROWS 4 PRECEDING), 2) AS sum5,
           round(avg(value) OVER (w ROWS 2 PRECEDING), 4) AS mean3
    FROM events WINDOW w AS (PARTITION BY {key} ORDER BY value, event_id)"""


def _calculate(spark, sf, key, hot=None):
    e = Tables(spark, sf).events.select("event_id", key, "value")
    out = window_calculation(e, [key], [{"column": "value"}], _CALCS, ["event_id"], hot)
    out = rounded(rounded(out, ["running", "sum5"], 2), ["mean3"])
    return rounded(out, ["pct"], 6)


@query("windows_per_user", _WINDOWS.format(key="user_id"))
def windows_per_user(spark, sf):
    return _calculate(spark, sf, "user_id")


@query("windows_split", _WINDOWS.format(key="event_type"))
def windows_split(spark, sf):
    """Few large groups, cut into blocks as groups too large for one task are."""
    return _calculate(spark, sf, "event_type", 700)


_FILL = """
    SELECT event_id, coalesce(last_value(CASE WHEN event_id % 4 = 1 THEN event_type END IGNORE NULLS)
                              OVER (ORDER BY ts, event_id), '  ') AS label
    FROM events"""


def _blanked(spark, sf):
    e = Tables(spark, sf).events
    return e.select("event_id", "ts", F.when(F.col("event_id") % 4 == 1, F.col("event_type"))
                    .otherwise("  ").alias("label"))


@query("forward_filled", _FILL)
def forward_filled(spark, sf):
    return fill_missing_values(_blanked(spark, sf), [{"column": "label", "strategy": "forward_fill"}],
                               ["ts", "event_id"]).drop("ts")


@query("forward_filled_split", _FILL)
def forward_filled_split(spark, sf):
    return fill_missing_values(_blanked(spark, sf), [{"column": "label", "strategy": "forward_fill"}],
                               ["ts", "event_id"], 900).drop("ts")
