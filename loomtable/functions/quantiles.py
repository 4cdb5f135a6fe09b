"""Exact linear-interpolation quantiles of many columns in two scans.

The first counts the values of all columns in bins that follow the order of the numbers (1/256 of a doubling wide), and
sums tell which bins hold the wanted ranks.  The second counts only the values in those bins; a bin that holds one value
only needs none.  Bins are combined before the shuffle, so a task sends a bounded number of rows per column, and no task
holds a whole column.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

#: bins per doubling, and the place of 2 ** -1100 below every double
_FINE, _FLOOR = 256, 1100
_NAN, _ZERO = 1_000_000, 0


def value_bin(v: Column) -> Column:
    """Whole number that never falls as the double grows: Java's logarithm is semi-monotonic, and so is all that follows.
    NaN comes last, as Spark sorts it; infinities share the outermost bins but for NaN."""
    size = F.least(F.floor((F.log2(F.abs(v)) + _FLOOR) * _FINE), F.lit(_NAN - 1)).cast("int")
    return F.when(F.isnan(v), _NAN).when(v > 0, size).when(v < 0, -size).otherwise(_ZERO)


def _long(values: DataFrame, places) -> DataFrame:
    """(col, v): a row per cell of the columns c<place>; plain projections, as a filter of an array would leave the
    generated code."""
    cells = [f"{i}, c{i}" for i in places]
    return values.select(F.expr(f"stack({len(cells)}, {', '.join(cells)}) as (col, v)")).filter("v is not null")


def _ranks(total: Column, probabilities: list[float]) -> Column:
    """The ranks (from 0) that the quantiles need: the one below and the one above each position."""
    return F.array(*[f(p * (total - 1)).cast("bigint") for p in probabilities for f in (F.floor, F.ceil)])


def _needed(total: int, probabilities: list[float]) -> list[int]:
    """The same ranks of a known total."""
    return sorted({f(p * (total - 1)) for p in probabilities for f in (math.floor, math.ceil)})


def quantile_rows(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Rows of (column_name, quantiles array<double>)."""
    # a negative zero equals zero everywhere but in a grouping
    values = df.select(*[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    bins = (_long(values, range(len(columns))).withColumn("bin", value_bin(F.col("v"))).groupBy("col", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    # a column has at most 2,200 doublings of bins, so its bins fit one task
    of = Window.partitionBy("col")
    placed = bins.select("*", (F.col("lo") == F.col("hi")).alias("single"), F.sum("n").over(of).alias("total"), F.coalesce(F.sum("n").over(
        of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    held = placed.filter(F.exists(_ranks(F.col("total"), probabilities),
                                  lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
    found = held.collect()  # at most two bins per quantile and column
    wanted = {i: [r for r in found if r["col"] == i] for i in range(len(columns))}
    out = {i: [None] * len(probabilities) for i in wanted}
    picked = {(i, k): r["lo"] for i, rows in wanted.items() for r in rows if r["single"]
              for k in _needed(r["total"], probabilities) if r["before"] <= k < r["before"] + r["n"]}
    open_bins = [r for r in found if not r["single"]]
    if open_bins:
        picked.update(_values_at(values, probabilities, open_bins))
    for i, rows in wanted.items():
        for j, p in enumerate(probabilities if rows else []):
            at = p * (rows[0]["total"] - 1)
            low, high = picked[(i, math.floor(at))], picked[(i, math.ceil(at))]
            out[i][j] = low if low == high else low + (high - low) * (at - math.floor(at))
    return df.sparkSession.createDataFrame([(c, out[i]) for i, c in enumerate(columns)],
                                           "column_name string, quantiles array<double>")


def _values_at(values: DataFrame, probabilities: list[float], bins: list) -> dict:
    """(column, rank) -> value, by counting the values in the given bins."""
    place = F.lit(None).cast("int")
    for b, r in enumerate(bins):
        place = F.when((F.col("col") == r["col"]) & F.col("v").between(r["lo"], r["hi"]), b).otherwise(place)
    some = values.filter(reduce(or_, [F.col(f"c{r['col']}").between(r["lo"], r["hi"]) for r in bins]))
    counts = (_long(some, sorted({r["col"] for r in bins})).select(place.alias("at"), "v").filter("at is not null")
              .groupBy("at", "v").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("at").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.array(*[F.lit(r["before"]) for r in bins])
    ranks = F.array(*[F.array(*[F.lit(k) for k in _needed(r["total"], probabilities)]) for r in bins])
    placed = counts.withColumn("before", F.get(start, "at") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    hit = placed.select("at", "v", F.explode(F.filter(
        F.get(ranks, "at"), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).alias("rank"))
    return {(bins[r["at"]]["col"], r["rank"]): r["v"] for r in hit.collect()}
