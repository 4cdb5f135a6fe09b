"""Window calculations.

With partition keys the calculation is a plain Spark window: a group is sorted, spilled where it must be, and streamed.  Without keys,
or when the caller passes ``block_rows`` because one group is too long for a task, rows are range-partitioned on (group, order),
numbered chunk by chunk with carried counts, and regrouped into blocks of the row number.  Neighbours needed across a block edge
travel as marked copies, and running totals are carried from block to block.  Which form runs depends on the arguments alone, never on
the number of rows; in blocks a sum adds up inside each block first, then over the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import is_numeric, need_columns, need_distinct, need_some
from loomtable.functions.values import is_blank
from loomtable.registry import operator
from loomtable.session import cut_lineage

BLOCK_ROWS = 1_000_000
RANKS = ("rank", "percent_rank")
NUMERIC_KINDS = ("cumulative_sum", "rolling_sum", "rolling_mean")
KINDS = ("row_number", *RANKS, "lag", "lead", *NUMERIC_KINDS)


def sort_columns(order_by: list) -> list[Column]:
    """``[{"column", "descending"}]`` or plain names -> sort expressions."""
    out = []
    for o in order_by:
        o = {"column": o} if isinstance(o, str) else o
        c = F.col(f"`{o['column']}`")
        out.append(c.desc_nulls_first() if o.get("descending") else c.asc_nulls_first())
    return out


def order_names(order_by: list) -> list[str]:
    return [o if isinstance(o, str) else o["column"] for o in order_by]


def in_blocks(keys: list[str], block_rows: int | None) -> int | None:
    """Rows of a block, or None for a plain window."""
    return block_rows or (None if keys else BLOCK_ROWS)


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    return df.withColumn("__g", group)


def _number_in_chunks(df: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """Adds ``__rn`` (1, 2, ... per ``__g``) and, with a weight, ``__before``
    (the weight of all earlier rows of the group)."""
    # the chunks are read twice and must be the same both times, so they are written
    chunked = cut_lineage(df.repartitionByRange(F.col("__g"), *order)
                          .withColumn("__chunk", F.spark_partition_id()))
    w = Window.partitionBy("__g", "__chunk").orderBy(*order)
    earlier = Window.partitionBy("__g").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    load = F.sum(weight) if weight else F.lit(0)
    sizes = (chunked.groupBy("__g", "__chunk")
             .agg(F.count(F.lit(1)).alias("__n"), load.alias("__w"))
             .select("__g", "__chunk",
                     F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows_before"),
                     F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__load_before")))
    out = chunked.withColumn("__rn", F.row_number().over(w))
    if weight:
        inside = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("__before", F.coalesce(inside, F.lit(0)))
    out = (out.join(sizes, ["__g", "__chunk"])
           .withColumn("__rn", F.col("__rn") + F.col("__rows_before")))
    if weight:
        out = out.withColumn("__before", F.col("__before") + F.col("__load_before"))
    return out.drop("__chunk", "__rows_before", "__load_before")


@operator("number_rows")
def number_rows(df: DataFrame, keys: list[str], order_by: list, out: str,
                block_rows: int | None = None) -> DataFrame:
    """Position of each row in its group, under a unique order."""
    need_columns(df, [*keys, *order_names(order_by)])
    order = sort_columns(order_by)
    if not in_blocks(keys, block_rows):
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("bigint"))
    numbered = _number_in_chunks(_grouped(df, keys), order)
    return numbered.withColumn(out, F.col("__rn").cast("bigint")).select(*df.columns, out)


def _check(df: DataFrame, partition_by, order_by, calculations) -> None:
    need_some(order_by, "order column")
    need_some(calculations, "calculation")
    need_columns(df, [*partition_by, *order_names(order_by)])
    need_distinct([*df.columns, *[c["output_column"] for c in calculations]], "output column")
    for c in calculations:
        kind = c["kind"]
        if kind not in KINDS:
            raise ValueError(f"unknown window calculation {kind!r}")
        if kind in ("lag", "lead", *NUMERIC_KINDS):
            if not c.get("source_column"):
                raise ValueError(f"{kind} needs a source column")
            need_columns(df, [c["source_column"]])
        if kind in NUMERIC_KINDS and not is_numeric(df, c["source_column"]):
            raise ValueError(f"{kind}: column {c['source_column']!r} is not numeric")
        if kind in ("lag", "lead") and c.get("offset", 1) < 1:
            raise ValueError(f"{kind}: the offset must be positive")
        if kind in ("rolling_sum", "rolling_mean") and c.get("window_size", 0) < 1:
            raise ValueError(f"{kind}: the window size must be positive")


def _value(c: dict) -> Column:
    return F.coalesce(F.col(f"`{c['source_column']}`").cast("double"), F.lit(0.0))


def _row_calc(c: dict, w) -> Column:
    """lag, lead and rolling frames over an ordered window."""
    source = F.col(f"`{c['source_column']}`")
    if c["kind"] == "lag":
        return F.lag(source, c.get("offset", 1)).over(w)
    if c["kind"] == "lead":
        return F.lead(source, c.get("offset", 1)).over(w)
    frame = w.rowsBetween(-(c["window_size"] - 1), Window.currentRow)
    fn = F.sum if c["kind"] == "rolling_sum" else F.avg
    return fn(_value(c)).over(frame)


@operator("window_calculation")
def window_calculation(df: DataFrame, partition_by: list[str], order_by: list,
                       calculations: list[dict], row_id: list[str] | None = None,
                       block_rows: int | None = None) -> DataFrame:
    """row_number, rank (dense), percent_rank, cumulative_sum, lag, lead,
    rolling_sum and rolling_mean.  All but the ranks depend on which of two tied rows comes first, so ``order_by``
    with ``row_id`` must tell the rows of a group apart; without ``row_id``, ties are broken by all orderable columns, so that
    only rows equal in every one of them are interchangeable."""
    _check(df, partition_by, order_by, calculations)
    if row_id is None:
        given = {*partition_by, *order_names(order_by)}
        row_id = [c for c, t in df.dtypes if c not in given and not t.startswith(("map", "variant", "array<map"))]
    size = in_blocks(partition_by, block_rows)
    if size:
        return _split_calculation(df, partition_by, order_by, calculations, row_id or [], size)
    keys = [F.col(f"`{k}`") for k in partition_by]
    ranked = Window.partitionBy(*keys).orderBy(*sort_columns(order_by))
    w = Window.partitionBy(*keys).orderBy(*sort_columns([*order_by, *(row_id or [])]))
    out = {}
    for c in calculations:
        kind = c["kind"]
        if kind == "row_number":
            value = F.row_number().over(w).cast("bigint")
        elif kind == "rank":
            value = F.dense_rank().over(ranked).cast("bigint")
        elif kind == "percent_rank":
            value = F.percent_rank().over(ranked)
        elif kind == "cumulative_sum":
            value = F.sum(_value(c)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            value = _row_calc(c, w)
        out[c["output_column"]] = value
    return df.withColumns(out)


def _split_calculation(df, partition_by, order_by, calculations, row_id, block_rows) -> DataFrame:
    names = order_names(order_by)
    full_order = sort_columns([*order_by, *row_id])
    rows = _number_in_chunks(_grouped(df, partition_by), full_order)
    if any(c["kind"] in RANKS for c in calculations):
        rows = _with_ranks(rows, names, sort_columns(order_by))
    before = max([c.get("offset", 1) if c["kind"] == "lag" else c["window_size"] - 1
                  for c in calculations if c["kind"] in ("lag", "rolling_sum", "rolling_mean")] + [0])
    after = max([c.get("offset", 1) for c in calculations if c["kind"] == "lead"] + [0])
    size = max(block_rows, before, after)
    at = F.col("__rn") - 1
    rows = rows.withColumn("__block", F.floor(at / size)).withColumn("__copy", F.lit(False))
    if before or after:
        place = lambda shift: F.struct((F.col("__block") + shift).alias("__block"),
                                       F.lit(shift != 0).alias("__copy"))
        places = F.array_compact(F.array(
            place(0),
            F.when(at % size >= size - before, place(1)),
            F.when((at % size < after) & (F.col("__block") > 0), place(-1))))
        rows = (rows.withColumn("__place", F.explode(places))
                .withColumn("__block", F.col("__place.__block"))
                .withColumn("__copy", F.col("__place.__copy")).drop("__place"))
    w = Window.partitionBy("__g", "__block").orderBy("__rn")
    own = lambda c: F.when(F.col("__copy"), 0.0).otherwise(_value(c))
    sums = [c for c in calculations if c["kind"] == "cumulative_sum"]
    if sums:
        earlier = Window.partitionBy("__g").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = (rows.groupBy("__g", "__block")
                   .agg(*[F.sum(own(c)).alias(f"__s{i}") for i, c in enumerate(sums)])
                   .select("__g", "__block",
                           *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0.0)).alias(f"__c{i}")
                             for i in range(len(sums))]))
    out = {}
    for c in calculations:
        name, kind = c["output_column"], c["kind"]
        if kind == "row_number":
            out[name] = F.col("__rn").cast("bigint")
        elif kind == "rank":
            out[name] = F.col("__dense").cast("bigint")
        elif kind == "percent_rank":
            out[name] = F.col("__percent")
        elif kind == "cumulative_sum":
            out[name] = F.sum(own(c)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            out[name] = _row_calc(c, w)
    rows = rows.withColumns(out).filter(~F.col("__copy"))
    if sums:
        rows = rows.join(carried, ["__g", "__block"])
        rows = rows.withColumns({c["output_column"]: F.col(f"`{c['output_column']}`") + F.col(f"__c{i}")
                                 for i, c in enumerate(sums)})
    return rows.select(*df.columns, *[c["output_column"] for c in calculations])


def _with_ranks(rows: DataFrame, names: list[str], order: list[Column]) -> DataFrame:
    """Ranks from the distinct order values of each group and their counts."""
    value = F.struct(*[F.col(f"`{n}`") for n in names])
    distinct = rows.groupBy("__g", *names).agg(F.count(F.lit(1)).alias("__n"))
    ranked = (_number_in_chunks(distinct, order, "__n")
              .select("__g", value.alias("__o"), F.col("__rn").alias("__dense"), "__before"))
    totals = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__total"))
    share = F.when(F.col("__total") > 1, F.col("__before") / (F.col("__total") - 1)).otherwise(0.0)
    return (rows.withColumn("__o", value).join(ranked, ["__g", "__o"]).join(totals, "__g")
            .withColumn("__percent", share).drop("__o", "__before", "__total"))


def forward_fill(df: DataFrame, columns: list[str], keys: list[str], order_by: list,
                 block_rows: int | None = None) -> DataFrame:
    """Last value that is not blank, in row order; leading blanks stay."""
    need_some(order_by, "order column")
    need_columns(df, [*columns, *keys, *order_names(order_by)])
    present = {c: F.when(~is_blank(df, c), F.col(f"`{c}`")) for c in columns}
    size = in_blocks(keys, block_rows)
    if not size:
        w = (Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
             .orderBy(*sort_columns(order_by)).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumns({c: F.coalesce(F.last(p, ignorenulls=True).over(w), F.col(f"`{c}`"))
                               for c, p in present.items()})
    # a fill inside ordered chunks and the last value before each chunk: no row needs a number of its own
    order = sort_columns(order_by)
    chunked = cut_lineage(_grouped(df, keys).repartitionByRange(F.col("__g"), *order).withColumn("__chunk", F.spark_partition_id()))
    w = Window.partitionBy("__g", "__chunk").orderBy(*order)
    rows = chunked.withColumns({"__n": F.row_number().over(w), **{f"__l{i}": F.last(p, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) for i, p in enumerate(present.values())}})
    earlier = Window.partitionBy("__g").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__g", "__chunk").agg(*[F.max_by(f"__l{i}", "__n").alias(f"__v{i}") for i in range(len(columns))])
    carried = ends.select("__g", "__chunk", *[F.last(f"__v{i}", ignorenulls=True).over(earlier).alias(f"__c{i}") for i in range(len(columns))])
    rows = rows.join(carried, ["__g", "__chunk"]).withColumns({c: F.coalesce(F.col(f"__l{i}"), F.col(f"__c{i}"), F.col(f"`{c}`"))
                                                              for i, c in enumerate(columns)})
    return rows.select(*df.columns)
