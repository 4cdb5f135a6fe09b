"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks.  With weight w, block j of a source is released at floor(j / w) and due at
ceil((j + 1) / w), in slots of one block; each slot takes the released block that is due first.  At every prefix a source's
share then deviates from its weight by less than one block.

Weights are taken exactly, as whole numbers without a common divisor (a float counts as the decimal it prints).  Their sum is the period in
which the schedule repeats: every source gets its weight in slots and all windows end with the period.  So one period is scheduled, and the
place of any block follows from its number by a join with that table; a period longer than its phase is scheduled only as far as the phase
goes, so the table has no more rows than there are periods' slots or blocks.  When a source runs out, the others share its weight in a new phase
with a period of its own; there are at most as many phases as sources, each of which ends at the block where the first source runs out.  No row
is dropped or repeated.  A given ``period`` rounds the weights to whole shares of that many slots instead, and deviations then grow.

Rows of a source are ordered by a fingerprint of their id, then by id, and numbered from counts per fingerprint range, so no task
holds a whole source.  Only one count per source reaches the driver; a given ``period`` has at least as many slots as there are sources.

Defined results: sources without a weight (a null source too) get ``default_weight``; weights must be positive; a null id is ordered as the
empty id; rows that tie in all of (source, id) take any order among themselves; an empty table gives an empty result.  Input
columns travel in one struct.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, functions as F, Window

from loomtable.llm.tables import written


def whole_weights(weights: dict) -> dict:
    """The same ratios in the smallest whole numbers."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    scale = lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def shares(weights: dict, period: int) -> dict:
    """Whole shares of the period by largest remainders; each source gets at least one."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    for s in order[:period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(share: dict, period: int) -> list:
    """The source of each slot, earliest deadline first among the released blocks."""
    return list(_slots(share, period))


def _slots(share: dict, period: int) -> Iterator:
    waiting = [(0, str(s), s, 0) for s in share]  # release, name, source, block
    ready: list = []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, name, s, j = heapq.heappop(waiting)
            due = -(-(j + 1) * period // share[s])
            # among equal deadlines the block whose next window overlaps this one goes first, then the one with the later group deadline
            overlap = ((j + 1) * period) % share[s] != 0
            heapq.heappush(ready, (due, not overlap, -_group_deadline(j, share[s], period), name, s, j))
        if not ready:
            raise AssertionError("an empty slot: shares do not fill the period")
        _, _, _, name, s, j = heapq.heappop(ready)
        yield s
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * period // share[s], name, s, j + 1))


def _group_deadline(j: int, share: int, period: int) -> int:
    """The slot where a run of tight windows that starts with block j must end (0 for weights below one half)."""
    if 2 * share < period or share == period:
        return 0
    # windows of a heavy source mirror those of the slots it leaves free: the next free slot's deadline
    due = -(-(j + 1) * period // share)
    free = period - share
    k = due * free // period
    while -(-(k) * period // free) < due:
        k += 1
    return -(-k * period // free)


def phases(blocks: dict, weights: dict, period: int | None = None) -> list[tuple[int, dict, list]]:
    """(first slot, first block of each source, schedule of a period or of a shorter phase) until every block has a place."""
    left, done, at, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {s: weights[s] for s in left}
        share = shares(own, period) if period else whole_weights(own)
        turn = sum(share.values())
        whole = min(n // share[s] for s, n in left.items())
        used = {s: whole * share[s] for s in left}
        length, schedule = whole * turn, _slots(share, turn)
        plan = list(schedule) if whole else []
        if all(used[s] < n for s, n in left.items()):
            for s in plan if whole else schedule:  # into the next period, until a source runs out
                if not whole:
                    plan.append(s)
                used[s] += 1
                length += 1
                if used[s] == left[s]:
                    break
        out.append((at, {s: done[s] for s in left}, plan))
        at += length
        for s in list(left):
            done[s] += used[s]
            left[s] -= used[s]
            if not left[s]:
                del left[s]
    return out


def mixed(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 100,
          period: int | None = None, default_weight: float = 1.0, carry: list[str] | None = None, range_rows: int = 2000) -> DataFrame:
    """row (the carried columns, all by default), source, block, slot (the block's place), place (of the row in its block)."""
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), source.alias("source"),
                       F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"))
    rows = rows.withColumn("h", F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"))
    counts = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if period and len(counts) > period:
        raise ValueError("more sources than slots in a period")
    if not counts:
        return rows.select("row", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "place")])
    # ranges of the fingerprint of about range_rows rows of all sources; the order does not depend on their number
    ranges = max(1, sum(counts.values()) // range_rows)
    part = rows.withColumn("range", F.expr(f"h * {ranges} div 4294967296"))
    sizes = part.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), (F.sum("n").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    # dealt by range alone, so a large source spreads over all ranges
    local = part.repartition("range").withColumn("i", F.row_number().over(Window.partitionBy("source", "range").orderBy("h", "id")) - 1)
    numbered = local.join(written(before), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
    index = F.col("before") + F.col("i")
    blocks = numbered.select("row", "source", F.expr(f"(before + i) div {block_rows}").alias("block"),
                             (index % block_rows).cast("long").alias("place"))
    given = {s: weights.get(s, default_weight) for s in counts}
    if min(given.values()) <= 0:
        raise ValueError("weights must be positive")
    steps = phases({s: -(-n // block_rows) for s, n in counts.items()}, given, period)
    table = []
    for k, (first_slot, first_block, plan) in enumerate(steps):
        seen = dict.fromkeys(first_block, 0)
        share = Counter(plan)
        ends = {s: (steps[k + 1][1].get(s) if k + 1 < len(steps) else None) for s in first_block}
        for slot, s in enumerate(plan):
            table.append((s, first_block[s], ends[s], share[s], len(plan), seen[s], first_slot + slot))
            seen[s] += 1
    # a period's slots for each phase at most, never more than there are blocks, and no more phases than sources: bounded, so broadcast
    spark = docs.sparkSession
    plan = spark.createDataFrame(table, "p_source string, first long, until long, share long, turn long, k long, at long")
    spans = plan.groupBy("p_source", "first", "until", "share", "turn").agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("slots"))
    placed = blocks.join(F.broadcast(spans), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") >= F.col("first"))
                         & (F.col("until").isNull() | (F.col("block") < F.col("until"))))
    slot = F.expr("slots[cast((block - first) % share as int)].at + (block - first) div share * turn")
    return placed.select("row", "source", "block", slot.alias("slot"), "place")


def mixed_order(docs: DataFrame, weights: dict, **options) -> DataFrame:
    """The table's own columns, its rows dealt to range partitions and sorted in the order of the mix."""
    out = mixed(docs, weights, **options)
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
