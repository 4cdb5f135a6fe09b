"""Finding the columns that tie two tables together."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from loomtable.functions.values import is_blank, looks_like_identifier_name, strip, text_of
from loomtable.registry import operator

# Endings dropped, in this order, to get at the stem of a key name.
STEM_ENDINGS = ("id", "code", "no", "编号", "编码", "代码")

LINK_SCHEMA = ("left_column string, right_column string, confidence string, match_row_count bigint, "
               "left_match_rate double, right_match_rate double, left_unmatched_row_count bigint, "
               "right_unmatched_row_count bigint, left_duplicate_key_count bigint, "
               "right_duplicate_key_count bigint")
#: slots of a column's sketch, and the probability that one of its bounds fails
SKETCH_SLOTS = 4096
SKETCH_RISK = 1e-12
#: ((left table, left column), (right table, right column))
Pair = tuple[tuple[str, str], tuple[str, str]]


def _plain(name: str) -> str:
    return reduce(lambda s, ch: s.replace(ch, ""), " _-", name.strip().lower())


def _stem(name: str) -> str:
    stem = _plain(name)
    for ending in STEM_ENDINGS:
        while stem.endswith(ending):
            stem = stem[: -len(ending)]
    return stem


def _both_identifiers(left: str, right: str) -> bool:
    return looks_like_identifier_name(left) and looks_like_identifier_name(right)


def candidate_pairs(left_columns: list[str], right_columns: list[str]) -> list[tuple[str, str]]:
    """Equal names, or identifier names with the same stem."""
    return [(a, b) for a in left_columns for b in right_columns
            if _plain(a) == _plain(b)
            or (_both_identifiers(a, b) and _stem(a) and _stem(a) == _stem(b))]


def _cells(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(col, key) of every cell that is not blank, all columns of a table in one scan; col is the place in ``columns``."""
    parts = []
    for ref in dict.fromkeys(t for t, _ in columns):
        df = tables[ref]
        cells = [F.when(~is_blank(df, c), F.struct(F.lit(i).alias("col"), strip(text_of(df, c)).alias("key")))
                 for i, (t, c) in enumerate(columns) if t == ref]
        # blanks go after the explode: array_compact would leave the generated code
        parts.append(df.select(F.explode(F.array(*cells)).alias("x")).filter("x is not null").select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def _unmatched_at_least(seen: int, only: int, scanned: float) -> float:
    """Lower bound on the keys that one side alone holds.

    The smallest hashes of the slots are a random subset, without replacement, of the keys of both sides; ``only`` of these
    ``seen`` keys are on one side alone, so Hoeffding's bound holds for the share.  All keys together are at least the slots
    in use, or, with every slot in use, at least 0.88 of what the scanned share of the hash range says (Chernoff).
    Either bound fails with a probability below ``SKETCH_RISK``."""
    if not seen:
        return 0.0
    keys = max(seen, 0.88 * seen / scanned) if seen == SKETCH_SLOTS else seen
    return max(0.0, only / seen - math.sqrt(math.log(1 / SKETCH_RISK) / (2 * seen))) * keys


def possible_pairs(tables: dict[str, DataFrame], pairs: list[Pair]) -> list[Pair]:
    """The pairs that sketches cannot rule out, by one scan per table.

    A sketch holds the smallest hash of each of ``SKETCH_SLOTS`` slots per column: tasks merge theirs by minimum, and any
    number of rows sends at most that many rows per column and task.  A key without a partner takes at least one row, so
    once such keys outnumber half of a side's rows, less than half of its rows can match.  One row reaches the driver."""
    columns = list(dict.fromkeys(c for a, b in pairs for c in (a, b)))
    at = {c: i for i, c in enumerate(columns)}
    hashed = _cells(tables, columns).select("col", F.xxhash64("key").alias("h"))
    slots = (hashed.groupBy("col", F.pmod("h", F.lit(SKETCH_SLOTS)).alias("slot"))
             .agg(F.min(F.shiftrightunsigned("h", 12) / F.lit(2.0 ** 52)).alias("least"), F.count(F.lit(1)).alias("n"))
             .groupBy("slot").agg(*[e for i in range(len(columns)) for e in (
                 F.max(F.when(F.col("col") == i, F.col("least"))).alias(f"m{i}"),
                 F.sum(F.when(F.col("col") == i, F.col("n"))).alias(f"n{i}"))]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = [F.count(F.lit(1)).alias("slots"), *[total(f"n{i}").alias(f"n{i}") for i in range(len(columns))]]
    for j, (a, b) in enumerate(pairs):
        m, o = F.col(f"m{at[a]}"), F.col(f"m{at[b]}")
        alone = lambda x, y: total(F.when(x.isNotNull() & (y.isNull() | (x < y)), 1))
        sums += [F.count(F.coalesce(m, o)).alias(f"seen{j}"), alone(m, o).alias(f"l{j}"), alone(o, m).alias(f"r{j}"),
                 total(F.coalesce(F.least(m, o), F.lit(1.0))).alias(f"scanned{j}")]
    s = slots.agg(*sums).first()
    out = []
    for j, (a, b) in enumerate(pairs):
        rows = s[f"n{at[a]}"], s[f"n{at[b]}"]
        scanned = (s[f"scanned{j}"] + SKETCH_SLOTS - s["slots"]) / SKETCH_SLOTS
        alone = [_unmatched_at_least(s[f"seen{j}"], s[f"{side}{j}"], scanned) for side in "lr"]
        if all(n > 0 and 2 * u <= n for n, u in zip(rows, alone)):
            out.append((a, b))
    return out


def link_counts(tables: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """Exact match counts of all pairs in one grouping by key: one scan per table, one shuffle, combined before it.

    left_table, right_table, the columns of ``LINK_SCHEMA``, key_rank, left_place, right_place."""
    columns = list(dict.fromkeys(c for a, b in pairs for c in (a, b)))
    at = {c: i for i, c in enumerate(columns)}
    keys = _cells(tables, columns).groupBy("key").agg(
        *[F.sum(F.when(F.col("col") == i, 1)).alias(f"n{i}") for i in range(len(columns))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    n = lambda c: F.col(f"n{at[c]}")
    sums = [e for i in range(len(columns)) for e in (
        total(f"n{i}").alias(f"rows{i}"), total(F.col(f"n{i}") - 1).alias(f"more{i}"))]
    for j, (a, b) in enumerate(pairs):
        sums += [total(F.when(n(b).isNotNull(), n(a))).alias(f"l{j}"), total(F.when(n(a).isNotNull(), n(b))).alias(f"r{j}")]
    rows = []
    for j, (a, b) in enumerate(pairs):
        (left, lc), (right, rc) = a, b
        ln, rn, lm, rm = F.col(f"rows{at[a]}"), F.col(f"rows{at[b]}"), F.col(f"l{j}"), F.col(f"r{j}")
        rate = lambda m, of: F.when(of > 0, m / of).otherwise(0.0)
        sure = F.lit(_plain(lc) == _plain(rc)) & (rate(lm, ln) >= 0.6) & (rate(rm, rn) >= 0.6)
        rows.append(F.struct(
            F.lit(left).alias("left_table"), F.lit(right).alias("right_table"),
            F.lit(lc).alias("left_column"), F.lit(rc).alias("right_column"),
            F.when(sure, "high").otherwise("medium").alias("confidence"), F.least(lm, rm).alias("match_row_count"),
            rate(lm, ln).alias("left_match_rate"), rate(rm, rn).alias("right_match_rate"),
            (ln - lm).alias("left_unmatched_row_count"), (rn - rm).alias("right_unmatched_row_count"),
            F.col(f"more{at[a]}").alias("left_duplicate_key_count"), F.col(f"more{at[b]}").alias("right_duplicate_key_count"),
            F.lit(int(_both_identifiers(lc, rc))).alias("key_rank"),
            F.lit(tables[left].columns.index(lc)).alias("left_place"),
            F.lit(tables[right].columns.index(rc)).alias("right_place")))
    return keys.agg(*sums).select(F.inline(F.array(*rows)))


def ranked_links(tables: dict[str, DataFrame], table_pairs: list[tuple[str, str]], max_candidates: int = 3) -> DataFrame | None:
    """The best column pairs of each pair of tables with their rank (from 1), all counted together; None if there are none."""
    pairs = [((a, x), (b, y)) for a, b in table_pairs for x, y in candidate_pairs(tables[a].columns, tables[b].columns)]
    pairs = possible_pairs(tables, pairs) if pairs else []
    if not pairs:
        return None
    good = link_counts(tables, pairs).filter((F.col("match_row_count") > 0) & (F.col("left_match_rate") >= 0.5)
                                             & (F.col("right_match_rate") >= 0.5))
    best = Window.partitionBy("left_table", "right_table").orderBy(
        F.when(F.col("confidence") == "high", 1).otherwise(2), F.desc("key_rank"), F.desc("match_row_count"),
        F.desc("left_match_rate"), F.desc("right_match_rate"), "left_place", "right_place")
    return (good.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(max_candidates, 1))
            .drop("key_rank", "left_place", "right_place"))


@operator("suggest_table_links")
def suggest_table_links(left: DataFrame, right: DataFrame, max_candidates: int = 3) -> DataFrame:
    """Obvious column pairs (at least half of both sides met), best first.  Sketches are compared when it is called."""
    found = ranked_links({"left": left, "right": right}, [("left", "right")], max_candidates)
    if found is None:
        return left.sparkSession.createDataFrame([], LINK_SCHEMA)
    return found.orderBy("rank").drop("left_table", "right_table", "rank")


@operator("suggest_table_workflow")
def suggest_table_workflow(left: DataFrame, right: DataFrame, max_candidates: int = 3) -> DataFrame:
    """One row: append_tables, join_preflight (with the best pair) or manual_confirmation."""
    if set(left.columns) == set(right.columns):
        return left.sparkSession.createDataFrame(
            [("append_tables", None, None, "high")],
            "recommended_action string, left_column string, right_column string, confidence string")
    links = suggest_table_links(left, right, max_candidates)
    best = links.limit(1).agg(*[F.first(c).alias(c) for c in ("left_column", "right_column", "confidence")])
    action = F.when(F.col("left_column").isNotNull(), "join_preflight").otherwise("manual_confirmation")
    return best.select(action.alias("recommended_action"), "left_column", "right_column", "confidence")
