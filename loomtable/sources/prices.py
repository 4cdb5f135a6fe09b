"""Daily price bars: text import, provider payloads, upsert and look-back reads.

A bar is (symbol, trade_date, open, high, low, close, adj_close, volume); the
key is (symbol, trade_date).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomtable.functions.checks import need_columns, need_some
from loomtable.functions.values import parse_number, strip
from loomtable.operators.ordering import keep_one_per_key
from loomtable.operators.windows import forward_fill, window_calculation
from loomtable.registry import operator
from loomtable.session import cut_lineage
from loomtable.sources.tables import read_cells

BAR = ("trade_date", "open", "high", "low", "close", "adj_close", "volume")
# Accepted header names of each field.
HEADER_ALIASES = {"trade_date": ("trade_date", "date", "tradedate"), "open": ("open",),
                  "high": ("high",), "low": ("low",), "close": ("close",),
                  "adj_close": ("adj_close", "adjclose", "adj close", "adjusted_close", "adjustedclose"),
                  "volume": ("volume",)}


def _plain(name: str) -> str:
    return re.sub("[ _-]", "", name.strip().lower())


def bar_date(c: Column) -> Column:
    """Dates written y-m-d, y/m/d or yyyymmdd."""
    t = strip(c)
    dashed = F.regexp_replace(t, "/", "-")
    packed = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{4}/\d{1,2}/\d{1,2}$"), dashed.try_cast("date")).when(
        t.rlike(r"^\d{8}$"), packed.try_cast("date"))


def _price(c: Column) -> Column:
    return parse_number(F.replace(strip(c), F.lit(","), F.lit("")))


def _volume(c: Column) -> Column:
    t = F.replace(strip(c), F.lit(","), F.lit(""))
    whole = F.when(t.rlike(r"^[+-]?\d{1,19}$"), t.try_cast("bigint"))
    return F.coalesce(whole, F.round(parse_number(t)).cast("bigint"))


@operator("parse_price_rows")
def parse_price_rows(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Text bars -> typed bars, with ``bad_fields`` naming what did not parse."""
    by_name = {_plain(c): c for c in raw.columns}
    found = {f: next((by_name[_plain(a)] for a in names if _plain(a) in by_name), None)
             for f, names in HEADER_ALIASES.items()}
    missing = [f for f, c in found.items() if c is None]
    if missing:
        raise ValueError(f"missing price columns: {', '.join(missing)}")
    parse = {"trade_date": bar_date, "volume": _volume}
    typed = {f: parse.get(f, _price)(F.col(f"`{c}`").cast("string")) for f, c in found.items()}
    bad = F.array_compact(F.array(*[F.when(v.isNull(), f) for f, v in typed.items()]))
    return raw.select(*(keep or []), *[v.alias(f) for f, v in typed.items()],
                      F.array_join(bad, ",").alias("bad_fields"))


@operator("import_price_csv")
def import_price_csv(spark: SparkSession, path: str, symbol: str, source: str = "csv_import",
                     strict: bool = True) -> DataFrame:
    """Bars of one symbol.  Strict: a bad cell fails the job with its line; otherwise rows keep ``line_number`` and
    ``bad_fields``, and ``set_aside`` parts them.  Lines count over all files of the path, header lines and all."""
    cells = read_cells(spark, path, "line_number")
    names = [c for c in cells.columns if c != "line_number"]
    head = cells.filter("line_number = 1").first()
    if head is None:
        raise ValueError(f"no header line in {path}")
    titles = {c: head[c] or c for c in names}
    body = cells.filter(~reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(head[c])) for c in names]))
    raw = body.select("line_number", *[F.col(c).alias(t) for c, t in titles.items()])
    rows = parse_price_rows(raw, ["line_number"]).select("line_number", F.lit(symbol).alias("symbol"), *BAR,
                                                         F.lit(source).alias("source"), "bad_fields")
    if not strict:
        return rows
    problem = F.raise_error(F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": bad price cells: "),
                                     F.col("bad_fields"))).cast("date")
    return rows.withColumn("trade_date", F.when(F.col("bad_fields") != "", problem)
                           .otherwise(F.col("trade_date"))).drop("bad_fields", "line_number")


@operator("set_aside")
def set_aside(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good bars, quarantined rows with their line and bad fields) of a lenient import."""
    return rows.filter("bad_fields = ''").drop("bad_fields", "line_number"), rows.filter("bad_fields <> ''")


@operator("upsert_bars")
def upsert_bars(batches: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Later batches win; within a batch the row with the higher ``load_seq`` wins."""
    need_some(batches, "batch")
    keys = keys or ["symbol", "trade_date"]
    parts = []
    for i, b in enumerate(batches):
        need_columns(b, keys)
        parts.append((b if "load_seq" in b.columns else b.withColumn("load_seq", F.lit(0)))
                     .withColumn("__batch", F.lit(i)))
    rows = reduce(DataFrame.unionByName, parts)
    order = [F.desc("__batch"), F.desc("load_seq")]
    return keep_one_per_key(rows, [F.col(k) for k in keys], order).drop("__batch", "load_seq")


@operator("import_summary")
def import_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("imported_row_count"),
                                      F.min("trade_date").alias("start_date"),
                                      F.max("trade_date").alias("end_date"))


@operator("recent_bars")
def recent_bars(bars: DataFrame, lookback: int, as_of: str | None = None) -> DataFrame:
    """Latest bars of every symbol up to a date.  The rank filter also runs
    before the shuffle, so a symbol sends few rows from each task."""
    if lookback < 1:
        raise ValueError("the look-back must be positive")
    rows = bars.filter(F.col("trade_date") <= F.lit(as_of).cast("date")) if as_of else bars
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= lookback).drop("__r")


@operator("packed_bars_as_of")
def packed_bars_as_of(bars: DataFrame, requests: DataFrame, lookback: int, block_rows: int | None = None) -> DataFrame:
    """symbol, as_of, bars: for every request (symbol, as_of) its latest bars up to that date, ascending, in one array.

    Bars and requests of a symbol are sorted together once, so a running count of bars gives each bar its number and each request the
    number of its last bar.  Bars are packed in blocks of ``lookback`` numbers, and a request meets the block of its last bar
    and the one before: no range join, two rows per request.  ``block_rows`` spreads a symbol too long for one task.
    Requests before a symbol's first bar, or for unknown symbols, give no row; repeated requests give one.
    """
    if lookback < 1:
        raise ValueError("the look-back must be positive")
    need_columns(bars, ["symbol", "trade_date"])
    need_columns(requests, ["symbol", "as_of"])
    row = F.struct("trade_date", *[c for c in bars.columns if c not in ("symbol", "trade_date")])
    known = bars.filter(F.col("trade_date").isNotNull()).select("symbol", F.col("trade_date").alias("__day"), F.lit(1).alias("__bar"), row.alias("__row"))
    asked = (requests.select("symbol", F.col("as_of").cast(bars.schema["trade_date"].dataType).alias("__day")).dropna().distinct()
             .select("symbol", "__day", F.lit(0).alias("__bar"), F.lit(None).cast(known.schema["__row"].dataType).alias("__row")))
    counted = window_calculation(
        known.unionByName(asked), ["symbol"], ["__day", {"column": "__bar", "descending": True}],
        [{"kind": "cumulative_sum", "source_column": "__bar", "output_column": "__number"}], [], block_rows)
    counted = cut_lineage(counted.withColumn("__block", F.floor((F.col("__number") - 1) / lookback)))
    blocks = counted.filter("__bar = 1").groupBy("symbol", "__block").agg(F.collect_list("__row").alias("__rows"))
    places = F.array("__block", F.col("__block") - 1)
    wanted = counted.filter("__bar = 0 and __number > 0").select("symbol", F.col("__day").alias("as_of"), F.explode(places).alias("__block"))
    met = wanted.join(blocks, ["symbol", "__block"]).groupBy("symbol", "as_of").agg(F.sort_array(F.flatten(F.collect_list("__rows"))).alias("__rows"))
    upto = F.filter("__rows", lambda x: x["trade_date"] <= F.col("as_of"))
    return met.select("symbol", "as_of", upto.alias("__rows")).select(
        "symbol", "as_of", F.slice("__rows", F.greatest(F.size("__rows") - lookback + 1, F.lit(1)), F.lit(lookback)).alias("bars"))


@operator("bars_as_of")
def bars_as_of(bars: DataFrame, requests: DataFrame, lookback: int, block_rows: int | None = None) -> DataFrame:
    """The rows of ``packed_bars_as_of``: at most ``lookback`` bars per request."""
    return packed_bars_as_of(bars, requests, lookback, block_rows).select("symbol", "as_of", F.inline("bars"))


# ---- provider payloads ----

# Providers in the default order of preference.
PROVIDERS = ("tencent", "sina")


def provider_symbol(c: Column) -> Column:
    """``600519`` or ``600519.SH`` -> ``sh600519``; null when it is not supported."""
    t = F.upper(strip(c))
    code, exchange = F.substring_index(t, ".", 1), F.regexp_extract(t, r"^[^.]*\.(.*)$", 1)
    bare = F.when(F.length(t) == 6, F.when(t.rlike("^[69]"), "SH").when(t.rlike("^[023]"), "SZ"))
    where = F.when(F.instr(t, ".") > 0, exchange).otherwise(bare)
    return F.when(where.isin("SH", "SZ"), F.concat(F.lower(where), code))


def _array_bars(payload: Column, symbol: Column, adjustment: str) -> Column:
    """``{"code", "data": {symbol: {"qfqday": [[date, open, close, high, low, volume]]}}}``."""
    shape = (f"struct<code:int,data:map<string,struct<{adjustment}day:array<array<string>>>>>")
    doc = F.from_json(payload, shape)
    rows = F.when(doc["code"] == 0, F.try_element_at(doc["data"], symbol)[f"{adjustment}day"])
    return F.transform(rows, lambda r: F.struct(
        F.get(r, F.lit(0)).alias("d"), F.get(r, F.lit(1)).alias("o"), F.get(r, F.lit(3)).alias("h"),
        F.get(r, F.lit(4)).alias("l"), F.get(r, F.lit(2)).alias("c"), F.get(r, F.lit(5)).alias("v")))


def _object_bars(payload: Column) -> Column:
    doc = F.from_json(payload, "array<struct<day:string,open:string,high:string,low:string,"
                               "close:string,volume:string>>")
    return F.transform(doc, lambda r: F.struct(
        r["day"].alias("d"), r["open"].alias("o"), r["high"].alias("h"), r["low"].alias("l"),
        r["close"].alias("c"), r["volume"].alias("v")))


@operator("sync_price_payloads")
def sync_price_payloads(landed: DataFrame, start: str, end: str, providers: list[str] | None = None,
                        adjustment: str = "qfq") -> DataFrame:
    """Landed payloads (symbol, provider, payload) -> bars of the first provider
    in order that has usable rows for the symbol."""
    need_columns(landed, ["symbol", "provider", "payload"])
    if adjustment != "qfq":
        raise ValueError(f"unsupported adjustment {adjustment!r}")
    order = list(providers if providers is not None else PROVIDERS)
    need_some(order, "provider")
    unknown = set(order) - set(PROVIDERS)
    if unknown:
        raise ValueError(f"unknown providers: {sorted(unknown)}")
    if start > end:
        raise ValueError("the date range is empty")
    bars = F.when(F.col("provider") == "tencent",
                  _array_bars(F.col("payload"), provider_symbol(F.col("symbol")), adjustment)).when(
        F.col("provider") == "sina", _object_bars(F.col("payload")))
    rows = landed.filter(F.col("provider").isin(*order)).select(
        "symbol", "provider", F.explode(bars).alias("b"))
    day = bar_date(F.col("b.d"))
    rows = rows.select("symbol", "provider", day.alias("trade_date"), _price(F.col("b.o")).alias("open"),
                       _price(F.col("b.h")).alias("high"), _price(F.col("b.l")).alias("low"),
                       _price(F.col("b.c")).alias("close"), _price(F.col("b.c")).alias("adj_close"),
                       _volume(F.col("b.v")).alias("volume"))
    broken = reduce(Column.__or__, [F.col(c).isNull() for c in BAR])
    inside = F.coalesce(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(True))
    rows = rows.filter(inside)
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    usable = (rows.groupBy("symbol", "provider").agg(F.max(broken).alias("broken")).filter(~F.col("broken"))
              .groupBy("symbol").agg(F.min_by("provider", rank).alias("provider")))
    return (rows.join(usable, ["symbol", "provider"])
            .withColumn("source", F.concat(F.col("provider"), F.lit(f"_http_{adjustment}"))))


@operator("clean_prices")
def clean_prices(raw: DataFrame, symbol: str = "symbol", day: str = "Date",
                 block_rows: int | None = None) -> DataFrame:
    """Drops rows without a date or close; fills prices forward, then backward."""
    need_columns(raw, [symbol, day, "Close"])
    prices = [c for c in ("Open", "High", "Low", "Close", "Volume") if c in raw.columns]
    rows = raw.withColumn(day, F.col(day).cast("string").try_cast("timestamp").cast("date"))
    rows = rows.withColumns({c: parse_number(strip(F.col(c).cast("string"))) for c in prices})
    rows = rows.filter(F.col(day).isNotNull() & F.col("Close").isNotNull())
    ahead = forward_fill(rows, prices, [symbol], [day], block_rows)
    return forward_fill(ahead, prices, [symbol], [{"column": day, "descending": True}], block_rows)
