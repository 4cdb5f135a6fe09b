"""Price bars made from order lines, and their indicators.

A part brand is a symbol, a ship date a trading day, and the square root of an
amount its price: no value then lies on the edge of a rounded digit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.bars import INDICATORS, SNAPSHOT, indicator_series, indicator_snapshot, short_histories
from loomtable.plans.suite.base import Tables, day_text, query, rounded, saved, scratch_folder
from loomtable.sources.exports import export_csv
from loomtable.sources.prices import (bars_as_of, clean_prices, import_price_csv, import_summary, parse_price_rows, recent_bars,
                                      sync_price_payloads, upsert_bars)
from loomtable.sources.versions import read_version, upsert_version, write_version

BARS_SQL = """
    p AS (SELECT p_brand AS symbol, l_shipdate::DATE AS trade_date, sqrt(l_extendedprice) AS price,
                 l_quantity AS q, (l_orderkey, l_linenumber, l_extendedprice) AS k
          FROM lineitem JOIN part ON p_partkey = l_partkey),
    bars AS (SELECT symbol, trade_date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
                    arg_max(price, k) AS close, arg_max(price, k) AS adj_close, sum(q)::BIGINT AS volume
             FROM p GROUP BY ALL)"""


def daily_bars(spark, sf):
    t = Tables(spark, sf)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"),
        F.sqrt("l_extendedprice").alias("price"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("k"))
    return rows.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"), F.max_by("price", "k").alias("adj_close"),
        F.sum("l_quantity").cast("bigint").alias("volume"))


_SHOW = """symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, open, high, low, close, adj_close, volume"""


def _shown(df, *more):
    return df.select("symbol", day_text("trade_date").alias("trade_date"), "open", "high", "low", "close",
                     "adj_close", "volume", *more)


@query("daily_bars", f"WITH {BARS_SQL} SELECT {_SHOW} FROM bars")
def bars(spark, sf):
    return _shown(daily_bars(spark, sf))


@query("price_text_rows", f"""WITH {BARS_SQL}
    SELECT symbol, CASE WHEN volume % 10 <> 0 THEN strftime(trade_date, '%Y-%m-%d') END AS trade_date, open, high, low,
           close, adj_close, volume, CASE WHEN volume % 10 = 0 THEN 'trade_date' ELSE '' END AS bad_fields FROM bars""")
def price_text_rows(spark, sf):
    """Bars written as text in the accepted ways, some with a broken date."""
    b = daily_bars(spark, sf)
    v = F.col("volume") % 10
    date = (F.when(v == 0, F.lit("soon")).when(v < 4, F.date_format("trade_date", "yyyyMMdd"))
            .when(v < 7, F.date_format("trade_date", "yyyy/M/d")).otherwise(F.date_format("trade_date", "yyyy-MM-dd")))
    raw = b.select("symbol", date.alias("Trade Date"), *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low", "close")],
                   F.col("close").cast("string").alias("Adj Close"),
                   F.format_number(F.col("volume") + 0.2, 1).alias("Volume"))
    return _shown(parse_price_rows(raw, ["symbol"]), "bad_fields")


@query("imported_price_lines", f"""WITH {BARS_SQL},
    b AS (SELECT CASE WHEN volume % 10 = 0 THEN 'trade_date' WHEN volume % 10 = 1 THEN 'low,volume' ELSE '' END AS bad_fields,
                 close, trade_date FROM bars)
    SELECT bad_fields, count(*) AS rows, count(*) AS lines, count(*) FILTER (bad_fields = '') AS good,
           round(sum(close), 2) AS closes FROM b GROUP BY 1""")
def imported_price_lines(spark, sf):
    """Bars written as CSV with bad cells planted, imported leniently: every row keeps a line of its own."""
    v = F.col("volume") % 10
    bars = daily_bars(spark, sf).select(
        F.when(v == 0, "soon").otherwise(F.date_format("trade_date", "yyyy-MM-dd")).alias("trade_date"), "open", "high",
        F.when(v == 1, "?").otherwise(F.col("low").cast("string")).alias("low"), "close", F.col("close").alias("adj_close"),
        F.when(v == 1, "many").otherwise(F.col("volume").cast("string")).alias("volume"))
    rows = import_price_csv(spark, export_csv(bars, scratch_folder(spark)), "all", strict=False)
    return rows.groupBy("bad_fields").agg(
        F.count("*").alias("rows"), F.count_distinct("line_number").alias("lines"),
        F.count(F.when(F.col("bad_fields") == "", 1)).alias("good"), F.round(F.sum("close"), 2).alias("closes"))


@query("upserted_bars", f"""WITH {BARS_SQL}
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date,
           CASE WHEN volume % 3 = 0 THEN close + 1 ELSE close END AS close,
           CASE WHEN volume % 3 = 0 THEN 'second' ELSE 'first' END AS source FROM bars""")
def upserted_bars(spark, sf):
    b = daily_bars(spark, sf)
    first = b.withColumn("source", F.lit("first"))
    second = b.filter("volume % 3 = 0").withColumns({"close": F.col("close") + 1, "source": F.lit("second")})
    return upsert_bars([first, second]).select("symbol", day_text("trade_date").alias("trade_date"), "close", "source")


_LOADS_SQL = f"""WITH {BARS_SQL},
    loads AS (SELECT symbol, trade_date, close, 1 AS load FROM bars
              UNION ALL SELECT symbol, trade_date, close + 1, 2 FROM bars WHERE volume % 3 = 0 AND year(trade_date) = 1997
              UNION ALL SELECT symbol, trade_date + 10000, close, 2 FROM bars WHERE volume % 50 = 0 AND year(trade_date) = 1997)"""


def _committed(spark, sf):
    """A first version of all bars in buckets of years, then a load that corrects and adds some."""
    root, b = scratch_folder(spark), daily_bars(spark, sf).select("symbol", "trade_date", "close", "volume").transform(saved)
    write_version(b.drop("volume").withColumn("load", F.lit(1)), root, ["symbol", "trade_date"], ["year(trade_date)"], 16)
    year = b.filter(F.year("trade_date") == 1997)
    new = (year.filter("volume % 3 = 0").withColumn("close", F.col("close") + 1)
           .unionByName(year.filter("volume % 50 = 0").withColumn("trade_date", F.date_add("trade_date", 10000))))
    upsert_version(new.withColumn("load", F.lit(2)), root)
    return root


@query("committed_bars", _LOADS_SQL + """
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, arg_max(close, load) AS close, max(load) AS load
    FROM loads GROUP BY ALL""")
def committed_bars(spark, sf):
    return read_version(spark, _committed(spark, sf)).withColumn("trade_date", day_text("trade_date"))


@query("committed_bars_before", _LOADS_SQL + """
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, close, load FROM loads WHERE load = 1""")
def committed_bars_before(spark, sf):
    """The first version stays as it was after the second load."""
    return read_version(spark, _committed(spark, sf), 1).withColumn("trade_date", day_text("trade_date"))


@query("bars_per_symbol", f"""WITH {BARS_SQL}
    SELECT symbol, count(*) AS imported_row_count, strftime(min(trade_date), '%Y-%m-%d') AS start_date,
           strftime(max(trade_date), '%Y-%m-%d') AS end_date FROM bars GROUP BY symbol""")
def bars_per_symbol(spark, sf):
    return import_summary(daily_bars(spark, sf)).select(
        "symbol", "imported_row_count", day_text("start_date").alias("start_date"), day_text("end_date").alias("end_date"))


@query("recent_bars", f"""WITH {BARS_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM bars
          WHERE trade_date <= DATE '1999-12-31')
    SELECT {_SHOW} FROM r WHERE n <= 60""")
def latest_bars(spark, sf):
    return _shown(recent_bars(daily_bars(spark, sf), 60, "1999-12-31"))


# Requests: each symbol as of the first day of every quarter (or year) in which it was traded.
def asked_dates(bars, unit):
    return bars.select("symbol", F.trunc("trade_date", unit).alias("as_of")).distinct()


_AS_OF_SQL = f"""WITH {BARS_SQL},
    q AS (SELECT DISTINCT symbol, date_trunc('quarter', trade_date)::DATE AS as_of FROM bars),
    r AS (SELECT b.*, as_of, row_number() OVER (PARTITION BY b.symbol, as_of ORDER BY trade_date DESC) AS n
          FROM q JOIN bars b ON b.symbol = q.symbol AND trade_date <= as_of)
    SELECT strftime(as_of, '%Y-%m-%d') AS as_of, {_SHOW} FROM r WHERE n <= 60"""


@query("bars_as_of", _AS_OF_SQL)
def requested_bars(spark, sf):
    b = daily_bars(spark, sf)
    return _shown(bars_as_of(b, asked_dates(b, "quarter"), 60), day_text("as_of").alias("as_of"))


@query("bars_as_of_split", _AS_OF_SQL)
def requested_bars_split(spark, sf):
    """The same with every symbol cut into blocks of rows, as for one too long for a task."""
    b = daily_bars(spark, sf)
    return _shown(bars_as_of(b, asked_dates(b, "quarter"), 60, block_rows=500), day_text("as_of").alias("as_of"))


@query("synced_payloads", f"""WITH {BARS_SQL},
    n AS (SELECT *, replace(symbol, 'Brand#', '')::INTEGER AS k FROM bars)
    SELECT printf('%06d.SH', 600000 + k) AS symbol,
           strftime(trade_date, '%Y-%m-%d') AS trade_date, open, high, low, close,
           close AS adj_close, volume,
           CASE WHEN k % 2 = 0 THEN 'tencent_http_qfq' ELSE 'sina_http_qfq' END AS source
    FROM n WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def synced_payloads(spark, sf):
    """Bars packed into provider payloads per symbol and read back.  The first
    provider answers with an error for odd symbols, so the second one is used."""
    b = daily_bars(spark, sf).withColumn("k", F.regexp_extract("symbol", r"(\d+)$", 1).cast("int"))
    text = lambda c: F.col(c).cast("string")
    day = day_text("trade_date")
    packed = b.groupBy("k").agg(
        F.collect_list(F.array(day, text("open"), text("close"), text("high"), text("low"), text("volume"))).alias("a"),
        F.collect_list(F.struct(day.alias("day"), text("open").alias("open"), text("high").alias("high"),
                                text("low").alias("low"), text("close").alias("close"),
                                text("volume").alias("volume"))).alias("o"))
    code = F.format_string("%06d", 600000 + F.col("k"))
    first = F.to_json(F.struct(F.when(F.col("k") % 2 == 0, 0).otherwise(1).alias("code"), F.create_map(
        F.concat(F.lit("sh"), code), F.struct(F.col("a").alias("qfqday"))).alias("data")))
    landed = packed.select(F.concat(code, F.lit(".SH")).alias("symbol"), F.lit("tencent").alias("provider"),
                           first.alias("payload")).unionByName(
        packed.select(F.concat(code, F.lit(".SH")).alias("symbol"), F.lit("sina").alias("provider"),
                      F.to_json("o").alias("payload")))
    return _shown(sync_price_payloads(landed, "1997-01-01", "1998-12-31"), "source")


@query("cleaned_prices", f"""WITH {BARS_SQL},
    raw AS (SELECT symbol, trade_date, CASE WHEN volume % 4 <> 0 THEN open END AS o, close, volume FROM bars
            WHERE volume % 7 <> 0)
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS day,
           coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date),
                    first_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS open, close, volume::DOUBLE AS volume
    FROM raw""")
def cleaned_prices(spark, sf):
    b = daily_bars(spark, sf)
    raw = b.select("symbol", F.when(F.col("volume") % 7 == 0, "not a day").otherwise(day_text("trade_date")).alias("Date"),
                   F.when(F.col("volume") % 4 == 0, "n/a").otherwise(F.col("open").cast("string")).alias("Open"),
                   F.col("close").cast("string").alias("Close"), F.col("volume").cast("string").alias("Volume"))
    out = clean_prices(raw)
    return out.select("symbol", day_text("Date").alias("day"), F.col("Open").alias("open"),
                      F.col("Close").alias("close"), F.col("Volume").alias("volume"))


# ---- indicators: one recursive walk over the bars of each look-back window ----

SNAPSHOT_SQL = f"""WITH RECURSIVE {BARS_SQL},
    cut AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars),
    r AS (SELECT *, row_number() OVER s AS i, count(*) OVER (PARTITION BY symbol) AS n, (high + low + close) / 3 AS tp,
                 lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl
          FROM cut WHERE back <= 260 WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
    w AS (SELECT *, close - pc AS diff, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
                 CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS up,
                 CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS down,
                 max(high) OVER (s ROWS 8 PRECEDING) AS h9, min(low) OVER (s ROWS 8 PRECEDING) AS l9,
                 tp - lag(tp) OVER s AS step, regr_slope(high, low) OVER (s ROWS 17 PRECEDING) AS beta
          FROM r WHERE n >= 200 WINDOW s AS (PARTITION BY symbol ORDER BY i)),
    f AS (SELECT symbol, i, n, close AS e10, close AS ef, close AS es, 0.0::DOUBLE AS eg, 0.0::DOUBLE AS gain,
                 0.0::DOUBLE AS loss, 0.0::DOUBLE AS atr, 0.0::DOUBLE AS tr14, 0.0::DOUBLE AS up14,
                 0.0::DOUBLE AS down14, 0.0::DOUBLE AS adx, 0.0::DOUBLE AS obv, 50.0::DOUBLE AS k, 50.0::DOUBLE AS d
          FROM w WHERE i = 1
          UNION ALL
          SELECT symbol, i, n, e10, ef, es, eg, gain, loss, atr, tr14, up14, down14,
                 CASE WHEN i < 15 THEN 0 WHEN i < 28 THEN adx + dx WHEN i = 28 THEN (adx + dx) / 14
                      ELSE (adx * 13 + dx) / 14 END, obv, nk, CASE WHEN i < 9 THEN 50 ELSE (2 * d + nk) / 3 END
          FROM (SELECT *, CASE WHEN up14 + down14 = 0 OR tr14 = 0 THEN 0
                               ELSE abs(up14 / tr14 - down14 / tr14) / (up14 / tr14 + down14 / tr14) * 100 END AS dx
                FROM (SELECT w.symbol, w.i, w.n, 2.0 / 11 * close + 9.0 / 11 * e10 AS e10,
                        2.0 / 13 * close + 11.0 / 13 * ef AS ef, 2.0 / 27 * close + 25.0 / 27 * es AS es,
                        0.2 * (2.0 / 13 * close + 11.0 / 13 * ef - (2.0 / 27 * close + 25.0 / 27 * es)) + 0.8 * eg AS eg,
                        CASE WHEN w.i < 15 THEN gain + greatest(diff, 0) WHEN w.i = 15 THEN (gain + greatest(diff, 0)) / 14
                             ELSE (gain * 13 + greatest(diff, 0)) / 14 END AS gain,
                        CASE WHEN w.i < 15 THEN loss + greatest(-diff, 0) WHEN w.i = 15 THEN (loss + greatest(-diff, 0)) / 14
                             ELSE (loss * 13 + greatest(-diff, 0)) / 14 END AS loss,
                        CASE WHEN w.i < 15 THEN atr + tr WHEN w.i = 15 THEN (atr + tr) / 14 ELSE (atr * 13 + tr) / 14 END AS atr,
                        CASE WHEN w.i <= 15 THEN tr14 + tr ELSE tr14 - tr14 / 14 + tr END AS tr14,
                        CASE WHEN w.i <= 15 THEN up14 + up ELSE up14 - up14 / 14 + up END AS up14,
                        CASE WHEN w.i <= 15 THEN down14 + down ELSE down14 - down14 / 14 + down END AS down14,
                        adx, obv + sign(diff) * volume AS obv, d,
                        CASE WHEN w.i < 9 THEN 50 ELSE (2 * k + CASE WHEN h9 = l9 THEN 50
                             ELSE least(greatest((close - l9) / (h9 - l9) * 100, 0), 100) END) / 3 END AS nk
                      FROM f JOIN w ON w.symbol = f.symbol AND w.i = f.i + 1))),
    roll AS (SELECT *, avg(close) OVER (s ROWS 49 PRECEDING) AS sma_50, avg(close) OVER (s ROWS 199 PRECEDING) AS sma_200,
                    avg(volume) OVER (s ROWS 19 PRECEDING) AS volume_sma_20, list(tp) OVER (s ROWS 19 PRECEDING) AS tps,
                    sum(CASE WHEN step > 0 THEN tp * volume ELSE 0 END) OVER (s ROWS 13 PRECEDING) AS mup,
                    sum(CASE WHEN step < 0 THEN tp * volume ELSE 0 END) OVER (s ROWS 13 PRECEDING) AS mdown,
                    max(high) OVER (s ROWS 13 PRECEDING) AS h14, min(low) OVER (s ROWS 13 PRECEDING) AS l14,
                    avg(beta) OVER (s ROWS 59 PRECEDING) AS bm, stddev_pop(beta) OVER (s ROWS 59 PRECEDING) AS bsd,
                    avg(close) OVER (s ROWS 19 PRECEDING) AS mid, stddev_pop(close) OVER (s ROWS 19 PRECEDING) AS sd,
                    min(close) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS support_level_20,
                    max(close) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS resistance_level_20,
                    list(close) OVER (s ROWS 29 PRECEDING) AS closes
             FROM w WINDOW s AS (PARTITION BY symbol ORDER BY i)),
    tails AS (SELECT symbol, list(obv ORDER BY i) FILTER (WHERE i > n - 30) AS obv_tail FROM f GROUP BY symbol),
    snap AS (SELECT x.symbol, trade_date AS as_of_date, x.n AS bar_count, close, e10 AS ema_10, sma_50, sma_200,
                    adx AS adx_14, up14 / tr14 * 100 AS plus_di_14, down14 / tr14 * 100 AS minus_di_14, obv, volume_sma_20,
                    volume / volume_sma_20 AS volume_ratio_20,
                    CASE WHEN mup = 0 AND mdown = 0 THEN 50 WHEN mdown = 0 THEN 100 WHEN mup = 0 THEN 0
                         ELSE 100 - 100 / (1 + mup / mdown) END AS mfi_14,
                    (tp - list_avg(tps)) / (0.015 * list_avg([abs(v - list_avg(tps)) for v in tps])) AS cci_20,
                    (h14 - close) / (h14 - l14) * -100 AS williams_r_14, 4 * sd / mid AS boll_width_ratio_20,
                    ef - es AS macd, eg AS macd_signal, ef - es - eg AS macd_histogram,
                    CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14, k AS k_9, d AS d_9,
                    3 * k - 2 * d AS j_9, beta AS rsrs_beta_18,
                    CASE WHEN bsd = 0 THEN 0 ELSE (beta - bm) / bsd END AS rsrs_zscore_18_60, mid + 2 * sd AS boll_upper,
                    mid AS boll_middle, mid - 2 * sd AS boll_lower, support_level_20, resistance_level_20,
                    atr AS atr_14, closes, obv_tail
             FROM roll x JOIN f USING (symbol, i) JOIN tails USING (symbol) WHERE x.i = x.n)"""


@query("indicator_snapshot", SNAPSHOT_SQL + " SELECT symbol, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, bar_count, "
       + ", ".join(f"round({c}, 4) AS {c}" for c in SNAPSHOT) + " FROM snap")
def snapshot(spark, sf):
    s = indicator_snapshot(daily_bars(spark, sf)).drop("closes", "obv_tail")
    return rounded(s.withColumn("as_of_date", day_text("as_of_date")), list(SNAPSHOT))


@query("short_histories", f"""WITH {BARS_SQL}
    SELECT symbol, count(*) AS bar_count FROM bars WHERE trade_date <= DATE '1996-01-15' GROUP BY symbol
    HAVING count(*) < 200""")
def few_bars(spark, sf):
    return short_histories(daily_bars(spark, sf), "1996-01-15")


@query("rolling_series", f"""WITH {BARS_SQL},
    r AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER s AS i FROM bars
          WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
    t AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY i) AS step FROM r),
    m AS (SELECT *, sum(CASE WHEN step > 0 THEN tp * volume ELSE 0 END) OVER (s ROWS 13 PRECEDING) AS up,
                 sum(CASE WHEN step < 0 THEN tp * volume ELSE 0 END) OVER (s ROWS 13 PRECEDING) AS down,
                 avg(close) OVER (s ROWS 49 PRECEDING) AS s50, avg(close) OVER (s ROWS 199 PRECEDING) AS s200,
                 avg(close) OVER (s ROWS 19 PRECEDING) AS mid, stddev_pop(close) OVER (s ROWS 19 PRECEDING) AS sd,
                 sum(tp * volume) OVER (s ROWS 13 PRECEDING) / sum(volume) OVER (s ROWS 13 PRECEDING) AS vw
          FROM t WINDOW s AS (PARTITION BY symbol ORDER BY i))
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, CASE WHEN i >= 50 THEN round(s50, 4) END AS close_50_sma,
           CASE WHEN i >= 200 THEN round(s200, 4) END AS close_200_sma, CASE WHEN i >= 20 THEN round(mid, 4) END AS boll,
           CASE WHEN i >= 20 THEN round(mid + 2 * sd, 4) END AS boll_ub,
           CASE WHEN i >= 20 THEN round(mid - 2 * sd, 4) END AS boll_lb, CASE WHEN i >= 14 THEN round(vw, 4) END AS vwma,
           CASE WHEN i >= 15 THEN round(CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 WHEN up = 0 THEN 0
                                             ELSE 100 - 100 / (1 + up / down) END, 4) END AS mfi FROM m""")
def rolling_series(spark, sf):
    names = ["close_50_sma", "close_200_sma", "boll", "boll_ub", "boll_lb", "vwma", "mfi"]
    s = indicator_series(daily_bars(spark, sf), names)
    return rounded(s.withColumn("trade_date", day_text("trade_date")), names)


_FOLDED_SQL = f"""WITH RECURSIVE {BARS_SQL},
    r AS (SELECT *, row_number() OVER s AS i, close - lag(close) OVER s AS diff,
                 greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr
          FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
    f AS (SELECT symbol, i, trade_date, close AS e10, close AS ef, close AS es, 0.0::DOUBLE AS eg, 0.0::DOUBLE AS gain,
                 0.0::DOUBLE AS loss, 0.0::DOUBLE AS atr FROM r WHERE i = 1
          UNION ALL SELECT r.symbol, r.i, r.trade_date, 2.0 / 11 * close + 9.0 / 11 * e10,
                 2.0 / 13 * close + 11.0 / 13 * ef, 2.0 / 27 * close + 25.0 / 27 * es,
                 0.2 * (2.0 / 13 * close + 11.0 / 13 * ef - (2.0 / 27 * close + 25.0 / 27 * es)) + 0.8 * eg,
                 CASE WHEN r.i < 15 THEN gain + greatest(diff, 0) WHEN r.i = 15 THEN (gain + greatest(diff, 0)) / 14
                      ELSE (gain * 13 + greatest(diff, 0)) / 14 END,
                 CASE WHEN r.i < 15 THEN loss + greatest(-diff, 0) WHEN r.i = 15 THEN (loss + greatest(-diff, 0)) / 14
                      ELSE (loss * 13 + greatest(-diff, 0)) / 14 END,
                 CASE WHEN r.i < 15 THEN atr + tr WHEN r.i = 15 THEN (atr + tr) / 14 ELSE (atr * 13 + tr) / 14 END
          FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1)
    SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, round(e10, 4) AS close_10_ema, round(ef - es, 4) AS macd,
           round(eg, 4) AS macds, round(ef - es - eg, 4) AS macdh,
           CASE WHEN i >= 15 THEN round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 4) END AS rsi,
           CASE WHEN i >= 15 THEN round(atr, 4) END AS atr FROM f"""


@query("folded_series", _FOLDED_SQL)
def folded_series(spark, sf):
    names = [n for n in INDICATORS if n in ("close_10_ema", "macd", "macds", "macdh", "rsi", "atr")]
    s = indicator_series(daily_bars(spark, sf), names)
    return rounded(s.withColumn("trade_date", day_text("trade_date")), names)


@query("folded_series_split", _FOLDED_SQL)
def folded_series_split(spark, sf):
    """The same with every symbol spread over blocks of rows and scanned in short blocks."""
    names = [n for n in INDICATORS if n in ("close_10_ema", "macd", "macds", "macdh", "rsi", "atr")]
    s = indicator_series(daily_bars(spark, sf), names, block_rows=400, scan_rows=64)
    return rounded(s.withColumn("trade_date", day_text("trade_date")), names)
