"""Equi-joins on a normalised key, and the check to run before one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import join_key
from loomtable.registry import operator

KEEP_MODES = {"matched_only": "inner", "keep_left": "left", "keep_right": "right"}


def _check(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> None:
    if not left_on.strip() or not right_on.strip():
        raise ValueError("a key column is needed on both sides")
    need_columns(left, [left_on], "left table")
    need_columns(right, [right_on], "right table")


def right_output_names(left_columns: list[str], right_columns: list[str],
                       left_on: str, right_on: str) -> dict[str, str]:
    """A right column that clashes gets ``_right``; a same-named key is dropped."""
    taken, names = set(left_columns), {}
    for c in right_columns:
        if c == right_on and left_on == right_on:
            continue
        name = c
        while name in taken:
            name += "_right"
        taken.add(name)
        names[c] = name
    return names


@operator("join_tables")
def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                keep_mode: str = "matched_only", match_blank_keys: bool = False) -> DataFrame:
    """Catalyst and AQE pick broadcast or sort-merge by size and split hot keys.

    In ``keep_right`` an unmatched row has a null left key, as its right key
    column of the same name is not part of the result.
    """
    _check(left, right, left_on, right_on)
    if keep_mode not in KEEP_MODES:
        raise ValueError(f"unknown keep mode {keep_mode!r}")
    names = right_output_names(left.columns, right.columns, left_on, right_on)
    lhs = left.withColumn("__lk", join_key(left, left_on, match_blank_keys))
    rhs = right.select(join_key(right, right_on, match_blank_keys).alias("__rk"),
                       *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return (lhs.join(rhs, F.col("__lk") == F.col("__rk"), KEEP_MODES[keep_mode])
            .select(*[F.col(f"`{c}`") for c in [*left.columns, *names.values()]]))


@operator("join_preflight")
def join_preflight(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                   match_blank_keys: bool = False) -> DataFrame:
    """One row: matches, unmatched rows, surplus duplicate keys, result sizes.

    Works on per-key counts, so no joined row is ever built.
    """
    _check(left, right, left_on, right_on)
    count = lambda df, on, k, n: (df.select(join_key(df, on, match_blank_keys).alias(k))
                                  .groupBy(k).agg(F.count(F.lit(1)).alias(n)))
    sides = count(left, left_on, "lk", "l").join(count(right, right_on, "rk", "r"),
                                                 F.col("lk") == F.col("rk"), "full")
    left_n, right_n = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    surplus = lambda n, k: total(F.when(F.col(k) != "", n - 1))
    stats = sides.agg(
        total(left_n * right_n).alias("matched_row_count"),
        total(F.when(right_n == 0, left_n)).alias("left_unmatched_row_count"),
        total(F.when(left_n == 0, right_n)).alias("right_unmatched_row_count"),
        surplus(left_n, "lk").alias("left_duplicate_key_count"),
        surplus(right_n, "rk").alias("right_duplicate_key_count"),
        total(left_n).alias("left_row_count"), total(right_n).alias("right_row_count"))
    out = stats.select(
        "*", F.col("matched_row_count").alias("matched_only_rows"),
        (F.col("matched_row_count") + F.col("left_unmatched_row_count")).alias("keep_left_rows"),
        (F.col("matched_row_count") + F.col("right_unmatched_row_count")).alias("keep_right_rows"),
        *[(1.0 - F.col(f"{s}_unmatched_row_count") / F.greatest(F.col(f"{s}_row_count"), F.lit(1)))
          .alias(f"{s}_match_rate") for s in ("left", "right")])
    both = (F.col("left_row_count") > 0) & (F.col("right_row_count") > 0)
    risks = F.array_compact(F.array(
        F.when((F.col("left_unmatched_row_count") > 0) | (F.col("right_unmatched_row_count") > 0),
               "unmatched_rows"),
        F.when((F.col("left_duplicate_key_count") > 0) | (F.col("right_duplicate_key_count") > 0),
               "duplicate_keys"),
        F.when(both & ((F.col("left_match_rate") < 0.8) | (F.col("right_match_rate") < 0.8)),
               "low_match_rate")))
    return out.withColumn("risks", F.array_join(risks, ","))


def join_preview(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                 keep_mode: str = "matched_only", limit: int = 5) -> DataFrame:
    from loomtable.operators.columns import preview_table
    return preview_table(join_tables(left, right, left_on, right_on, keep_mode), limit)
