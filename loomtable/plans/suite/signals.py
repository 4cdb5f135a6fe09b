"""Signals, surroundings, statements, announcements and decisions per symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.decisions import (disclosure_flags, security_decision, statement_signals)
from loomtable.operators.signals import SIGNALS, contextual_alignment, contextual_consultation, technical_consultation
from loomtable.plans.suite.base import Tables, query, rounded
from loomtable.plans.suite.prices import SNAPSHOT_SQL, asked_dates, daily_bars
from loomtable.sources.statements import announcements, latest_statement


def _anchor_sql(up: bool) -> str:
    """First level, latest break first, that was broken, held and touched."""
    parts = []
    for back in range(2, 6):
        # the tail holds 30 closes; the bar `back` bars ago is number 30 - back
        at = 30 - back
        level = f"list_{'max' if up else 'min'}(closes[{at - 21}:{at - 2}])"
        since = f"closes[{at + 1}:29]"
        broke = f"closes[{at}] {'>' if up else '<'} {level}"
        far = f"{'list_min' if up else 'list_max'}({since}) {'>=' if up else '<='} {level} {'-' if up else '+'} buf"
        near = f"list_min([abs(x - {level}) for x in {since}]) <= buf + 1e-9"
        parts.append(f"CASE WHEN {broke} AND {far} AND {near} THEN {level} END")
    return f"coalesce({', '.join(parts)})"


def _stage_sql(names, one, two, three, four) -> str:
    return f"""
        WHEN prev > hi AND {one} THEN '{names[0]}' WHEN prev < lo AND {two} THEN '{names[1]}'
        WHEN au IS NOT NULL AND {three} THEN '{names[0]}'
        WHEN au IS NULL AND ad IS NOT NULL AND {four} THEN '{names[1]}'"""


SIGNALS_SQL = SNAPSHOT_SQL + f""",
    g1 AS (SELECT *, CASE WHEN adx_14 >= 25 THEN 'strong' WHEN adx_14 < 20 THEN 'weak' ELSE 'moderate' END AS trend_strength,
        CASE WHEN mfi_14 >= 80 THEN 'overbought_distribution' WHEN mfi_14 <= 20 THEN 'oversold_accumulation'
             ELSE 'neutral' END AS money_flow_signal,
        CASE WHEN cci_20 >= 100 THEN 'overbought_reversal_risk' WHEN cci_20 <= -100 THEN 'oversold_rebound_candidate'
             ELSE 'neutral' END AS mean_reversion_signal,
        CASE WHEN williams_r_14 >= -20 THEN 'overbought_pullback_risk' WHEN williams_r_14 <= -80
             THEN 'oversold_rebound_candidate' ELSE 'neutral' END AS range_position_signal,
        CASE WHEN close >= boll_upper THEN 'upper_band_breakout_risk' WHEN close <= boll_lower
             THEN 'lower_band_rebound_candidate' ELSE 'neutral' END AS bollinger_position_signal,
        CASE WHEN boll_width_ratio_20 >= 0.12 THEN 'expanding' WHEN boll_width_ratio_20 <= 0.05 THEN 'contracting'
             ELSE 'normal' END AS bollinger_bandwidth_signal,
        CASE WHEN macd > macd_signal AND rsi_14 >= 55 THEN 'positive' WHEN macd < macd_signal AND rsi_14 <= 45
             THEN 'negative' ELSE 'neutral' END AS momentum_signal,
        CASE WHEN rsi_14 <= 30 AND k_9 > d_9 AND j_9 > k_9 AND macd_histogram > 0 THEN 'oversold_rebound'
             WHEN rsi_14 >= 70 AND k_9 < d_9 AND j_9 < k_9 AND macd_histogram < 0 THEN 'overbought_pullback'
             ELSE 'neutral' END AS timing_signal,
        CASE WHEN rsrs_zscore_18_60 >= 0.7 AND round(rsrs_beta_18, 9) >= 1 THEN 'bullish_breakout'
             WHEN rsrs_zscore_18_60 <= -0.7 AND round(rsrs_beta_18, 9) <= 1 THEN 'bearish_pressure' ELSE 'neutral' END AS rsrs_signal,
        CASE WHEN atr_14 / close >= 0.03 OR boll_width_ratio_20 >= 0.18 OR close >= boll_upper OR close <= boll_lower
             THEN 'high' ELSE 'normal' END AS volatility_state,
        greatest(atr_14 * 0.25, 0.15) AS buf, closes[29] AS prev, list_max(closes[9:28]) AS hi, list_min(closes[9:28]) AS lo
        FROM snap),
    g2 AS (SELECT *, CASE WHEN trend_strength = 'weak' THEN 'sideways'
             WHEN close > ema_10 AND ema_10 > sma_50 AND sma_50 > sma_200 AND plus_di_14 >= minus_di_14 THEN 'bullish'
             WHEN close < ema_10 AND ema_10 < sma_50 AND sma_50 < sma_200 AND minus_di_14 >= plus_di_14 THEN 'bearish'
             ELSE 'sideways' END AS trend_bias,
        CASE WHEN bollinger_position_signal <> 'neutral' THEN 'neutral' WHEN close > boll_middle
             THEN 'midline_support_bias' WHEN close < boll_middle THEN 'midline_resistance_bias'
             ELSE 'neutral' END AS bollinger_midline_signal,
        CASE WHEN closes[30] > list_max(closes[11:29]) AND obv_tail[30] < list_max(obv_tail[11:29]) THEN 'bearish_divergence'
             WHEN closes[30] < list_min(closes[11:29]) AND obv_tail[30] > list_min(obv_tail[11:29]) THEN 'bullish_divergence'
             WHEN list_max(closes[21:30]) > list_max(closes[1:20]) AND list_max(obv_tail[21:30]) < list_max(obv_tail[1:20])
             THEN 'bearish_divergence'
             WHEN list_min(closes[21:30]) < list_min(closes[1:20]) AND list_min(obv_tail[21:30]) > list_min(obv_tail[1:20])
             THEN 'bullish_divergence' ELSE 'none' END AS divergence_signal,
        {_anchor_sql(True)} AS au, {_anchor_sql(False)} AS ad FROM g1),
    g3 AS (SELECT *, CASE WHEN trend_bias <> 'sideways' AND volume_ratio_20 >= 1
             AND (trend_bias = 'bullish') = (obv >= 0) THEN 'confirmed' WHEN volume_ratio_20 < 0.95 THEN 'weakening'
             ELSE 'neutral' END AS volume_confirmation,
        CASE WHEN trend_bias = 'bullish' AND close > resistance_level_20 THEN 'confirmed_resistance_breakout'
             WHEN close > resistance_level_20 THEN 'resistance_breakout_watch'
             WHEN trend_bias = 'bearish' AND close < support_level_20 THEN 'confirmed_support_breakdown'
             WHEN close < support_level_20 THEN 'support_breakdown_watch'
        {_stage_sql(('resistance_retest_watch', 'support_retest_watch'),
                    'abs(close - hi) <= buf + 1e-9 AND close < resistance_level_20',
                    'abs(close - lo) <= buf + 1e-9 AND close > support_level_20',
                    'abs(close - au) <= buf + 1e-9 AND close < resistance_level_20',
                    'abs(close - ad) <= buf + 1e-9 AND close > support_level_20')}
        {_stage_sql(('confirmed_resistance_retest_hold', 'confirmed_support_retest_reject'),
                    'close >= hi + buf AND close < resistance_level_20', 'close <= lo - buf AND close > support_level_20',
                    'close >= au + buf AND close < resistance_level_20', 'close <= ad - buf AND close > support_level_20')}
        {_stage_sql(('failed_resistance_breakout', 'failed_support_breakdown'), 'close < hi - buf', 'close > lo + buf',
                    'close < au - buf', 'close > ad + buf')}
             ELSE 'range_bound' END AS breakout_signal FROM g2),
    g4 AS (SELECT *, CASE
        WHEN breakout_signal IN ('confirmed_resistance_breakout', 'confirmed_resistance_retest_hold') THEN 'bullish_continuation'
        WHEN breakout_signal IN ('resistance_breakout_watch', 'resistance_retest_watch') THEN 'bullish_confirmation_watch'
        WHEN breakout_signal IN ('confirmed_support_breakdown', 'confirmed_support_retest_reject') THEN 'bearish_continuation'
        WHEN breakout_signal IN ('support_breakdown_watch', 'support_retest_watch') THEN 'bearish_confirmation_watch'
        WHEN breakout_signal = 'failed_resistance_breakout' THEN 'bull_trap_risk'
        WHEN breakout_signal = 'failed_support_breakdown' THEN 'bear_trap_risk'
        WHEN trend_bias = 'bullish' AND trend_strength <> 'weak' THEN 'bullish_range_watch'
        WHEN trend_bias = 'bearish' AND trend_strength <> 'weak' THEN 'bearish_range_watch'
        WHEN divergence_signal = 'bullish_divergence' AND timing_signal = 'oversold_rebound' THEN 'bullish_range_watch'
        WHEN divergence_signal = 'bearish_divergence' AND timing_signal = 'overbought_pullback' THEN 'bearish_range_watch'
        ELSE 'range_wait' END AS bias FROM g3),
    g5 AS (SELECT *, (CASE WHEN breakout_signal LIKE 'confirmed%' OR breakout_signal LIKE 'failed%' THEN 2
                           WHEN breakout_signal LIKE '%watch' THEN 1 ELSE 0 END
        + CASE trend_strength WHEN 'strong' THEN 1 WHEN 'weak' THEN -1 ELSE 0 END
        + CASE volume_confirmation WHEN 'confirmed' THEN 1 WHEN 'weakening' THEN -1 ELSE 0 END
        + CASE WHEN bias IN ('bullish_continuation', 'bullish_confirmation_watch', 'bullish_range_watch', 'bear_trap_risk')
               THEN CASE momentum_signal WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END
                  + CASE rsrs_signal WHEN 'bullish_breakout' THEN 1 WHEN 'bearish_pressure' THEN -1 ELSE 0 END
                  - CASE divergence_signal WHEN 'bearish_divergence' THEN 1 ELSE 0 END
               WHEN bias IN ('bearish_continuation', 'bearish_confirmation_watch', 'bearish_range_watch', 'bull_trap_risk')
               THEN CASE momentum_signal WHEN 'negative' THEN 1 WHEN 'positive' THEN -1 ELSE 0 END
                  + CASE rsrs_signal WHEN 'bearish_pressure' THEN 1 WHEN 'bullish_breakout' THEN -1 ELSE 0 END
                  - CASE divergence_signal WHEN 'bullish_divergence' THEN 1 ELSE 0 END
               ELSE 0 END)::INTEGER AS score FROM g4),
    sig AS (SELECT *, CASE WHEN bias = 'range_wait' THEN 'low'
        WHEN bias LIKE '%range_watch' THEN CASE WHEN score >= 1 THEN 'medium' ELSE 'low' END
        WHEN bias LIKE '%_watch' THEN CASE WHEN score >= 2 THEN 'medium' ELSE 'low' END
        WHEN score < 2 THEN 'medium' WHEN score >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM g5)"""


@query("technical_signals", SIGNALS_SQL + f" SELECT symbol, {', '.join(SIGNALS)} FROM sig")
def signals(spark, sf):
    return technical_consultation(daily_bars(spark, sf)).select("symbol", *SIGNALS)


@query("technical_signals_by_supplier", SIGNALS_SQL.replace(
    "SELECT p_brand AS symbol", "SELECT l_suppkey::VARCHAR AS symbol").replace("n >= 200", "n >= 220")
    + f" SELECT symbol, {', '.join(SIGNALS)} FROM sig")
def supplier_signals(spark, sf):
    """The same rules over many more symbols: every supplier."""
    li = Tables(spark, sf).lineitem
    price = F.sqrt("l_extendedprice")
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    bars = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"))
    return technical_consultation(bars, min_bars=220).select("symbol", *SIGNALS)


_CONTEXT_SQL = SIGNALS_SQL + """,
    d AS (SELECT *, CASE WHEN bias IN ('bullish_continuation', 'bull_trap_risk') THEN 'bullish'
                         WHEN bias IN ('bearish_continuation', 'bear_trap_risk') THEN 'bearish' ELSE 'neutral' END AS way
          FROM sig),
    px AS (SELECT *, 'Brand#' || (replace(symbol, 'Brand#', '')::INTEGER % 5 + 1) AS market_symbol,
                  'Brand#' || (replace(symbol, 'Brand#', '')::INTEGER % 3 + 6) AS sector_symbol FROM d),
    ctx AS (SELECT d.symbol, d.as_of_date, d.bias, market_symbol, sector_symbol,
                   CASE WHEN m.symbol IS NULL OR s.symbol IS NULL THEN 'unavailable' WHEN d.way = 'neutral' THEN 'mixed' WHEN d.way = m.way AND d.way = s.way THEN 'tailwind'
                        WHEN d.way <> m.way AND d.way <> s.way THEN 'headwind' ELSE 'mixed' END AS alignment
            FROM px d LEFT JOIN d m ON m.symbol = market_symbol LEFT JOIN d s ON s.symbol = sector_symbol)"""


def _context(spark, sf):
    s = technical_consultation(daily_bars(spark, sf))
    k = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    proxies = s.select("symbol", F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string")).alias("market_symbol"),
                       F.concat(F.lit("Brand#"), (k % 3 + 6).cast("string")).alias("sector_symbol"))
    return contextual_alignment(s, proxies)


@query("contextual_alignment", _CONTEXT_SQL + """
    SELECT symbol, bias, market_symbol, sector_symbol, alignment FROM ctx""")
def alignment(spark, sf):
    return _context(spark, sf).select("symbol", "bias", "market_symbol", "sector_symbol", "alignment")


def _as_of_sql(sql: str) -> str:
    """The same rules with each symbol's bars repeated for every date asked for: symbol@date stands for a request."""
    asked = """asked AS (SELECT b.symbol || '@' || strftime(q.as_of, '%Y-%m-%d') AS symbol, b.* EXCLUDE (symbol) FROM bars b
             JOIN (SELECT DISTINCT symbol, date_trunc('year', trade_date)::DATE AS as_of FROM bars) q
             ON q.symbol = b.symbol AND b.trade_date <= q.as_of),
    cut AS ("""
    sql = sql.replace("cut AS (", asked, 1).replace("AS back FROM bars)", "AS back FROM asked)")
    for end in ("% 5 + 1)", "% 3 + 6)"):
        sql = sql.replace(end, f"{end} || '@' || split_part(symbol, '@', 2)")
    return sql.replace("replace(symbol, 'Brand#', '')", "replace(split_part(symbol, '@', 1), 'Brand#', '')")


@query("technical_signals_as_of", _as_of_sql(SIGNALS_SQL) + f"""
    SELECT split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS as_of, {', '.join(SIGNALS)} FROM sig""")
def signals_as_of(spark, sf):
    """Every symbol as of the first day of each year in which it was traded."""
    b = daily_bars(spark, sf)
    s = technical_consultation(b, requests=asked_dates(b, "year"))
    return s.select("symbol", F.col("as_of").cast("string").alias("as_of"), *SIGNALS)


@query("contextual_alignment_as_of", _as_of_sql(_CONTEXT_SQL) + """
    SELECT split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS as_of, bias, split_part(market_symbol, '@', 1) AS market_symbol,
           split_part(sector_symbol, '@', 1) AS sector_symbol, alignment FROM ctx""")
def alignment_as_of(spark, sf):
    b = daily_bars(spark, sf)
    k = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    proxies = b.select("symbol").distinct().select("symbol", F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string")).alias("market_symbol"),
                                                   F.concat(F.lit("Brand#"), (k % 3 + 6).cast("string")).alias("sector_symbol"))
    out = contextual_consultation(b, asked_dates(b, "year"), proxies)
    return out.select("symbol", F.col("as_of").cast("string").alias("as_of"), "bias", "market_symbol", "sector_symbol", "alignment")


# Statement figures per brand from its lines, under changing field names; those of brands above 20 go to another symbol.
_STATEMENTS_SQL = """
    y AS (SELECT CASE WHEN replace(p_brand, 'Brand#', '')::INTEGER > 20 THEN 'other ' ELSE '' END || p_brand AS symbol,
                 replace(p_brand, 'Brand#', '')::INTEGER AS k,
                 sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1999) AS a,
                 sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 2000) AS b,
                 sum(l_quantity * (l_discount - 0.05)) FILTER (WHERE year(l_shipdate) = 1999) AS pa,
                 sum(l_quantity * (l_discount - 0.05)) FILTER (WHERE year(l_shipdate) = 2000) AS pb
          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    st AS (SELECT symbol, k, round(b, 2) AS revenue, round((b - a) / a * 100, 3) AS revenue_yoy_pct,
                  round(pb, 2) AS net_profit, CASE WHEN k % 6 <> 0 THEN round((pb - pa) / abs(pa) * 100, 3) END
                  AS net_profit_yoy_pct, 6.0::DOUBLE + k % 5 AS roe_pct FROM y),
    ss AS (SELECT *, CASE WHEN net_profit_yoy_pct IS NULL THEN 'unknown'
                          WHEN revenue_yoy_pct >= 0 AND net_profit_yoy_pct >= 0 THEN 'positive'
                          WHEN revenue_yoy_pct < 0 AND net_profit_yoy_pct < 0 THEN 'negative' ELSE 'mixed' END AS profit_signal,
                  concat_ws(',', CASE WHEN net_profit_yoy_pct < 0 THEN 'profit_falling' END,
                            CASE WHEN revenue_yoy_pct < 0 THEN 'revenue_falling' END,
                            CASE WHEN roe_pct < 8 THEN 'low_return_on_equity' END,
                            CASE WHEN net_profit_yoy_pct IS NULL THEN 'growth_incomplete' END) AS statement_risks FROM st)"""


def _statements(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    year, profit = F.year("l_shipdate"), F.col("l_quantity") * (F.col("l_discount") - 0.05)
    in_year = lambda v, y: F.sum(F.when(year == y, v))
    y = li.groupBy(F.col("p_brand").alias("symbol")).agg(
        in_year(F.col("l_extendedprice"), 1999).alias("a"), in_year(F.col("l_extendedprice"), 2000).alias("b"),
        in_year(profit, 1999).alias("pa"), in_year(profit, 2000).alias("pb"))
    k = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    y = y.withColumn("k", k).withColumn("symbol", F.when(F.col("k") > 20, F.concat(F.lit("other "), "symbol")).otherwise(F.col("symbol")))
    text = lambda c, d: F.regexp_replace(F.format_number(c, d), "", "")
    row = F.create_map(
        F.lit("REPORT_DATE"), F.lit("2000-12-31 00:00:00"), F.lit("NOTICE_DATE"), F.lit("2001-03-01T08:00"),
        F.when(F.col("k") % 2 == 0, "TOTAL_OPERATE_INCOME").otherwise("营业总收入"), text(F.col("b"), 2),
        F.lit("YSTZ"), text((F.col("b") - F.col("a")) / F.col("a") * 100, 3),
        F.lit("PARENT_NETPROFIT"), text(F.col("pb"), 2),
        F.when(F.col("k") % 6 == 0, "other").otherwise("SJLTZ"),
        text((F.col("pb") - F.col("pa")) / F.abs(F.col("pa")) * 100, 3),
        F.lit("ROEJQ"), (6 + F.col("k") % 5).cast("string"))
    old = F.create_map(F.lit("REPORT_DATE"), F.lit("1999-12-31"))
    payload = F.when(F.col("k") % 3 == 0, F.to_json(F.array(row, old))).otherwise(
        F.to_json(F.struct(F.array(row, old).alias("data"))))
    return statement_signals(latest_statement(y.select("symbol", payload.alias("payload"))))


@query("statement_signals", "WITH " + _STATEMENTS_SQL + """
    SELECT symbol, 'available' AS statement_status, '2000-12-31' AS report_period, '2001-03-01' AS notice_date, revenue,
           revenue_yoy_pct, net_profit, net_profit_yoy_pct, roe_pct, profit_signal, statement_risks FROM ss""")
def statements(spark, sf):
    return _statements(spark, sf).withColumn("statement_risks", F.array_join("statement_risks", ","))


# Announcement titles per brand: one per part, words by part size; those of some brands go to another symbol.
_TITLE_SQL = """CASE p_size % 16 WHEN 0 THEN '关于股东减持计划' WHEN 1 THEN '2024年年度报告' WHEN 2 THEN '利润分配方案'
      WHEN 3 THEN '回购股份' WHEN 4 THEN '关于问询函的回复' WHEN 5 THEN '业绩预亏公告' ELSE '董事会决议' END"""
_NOTICES_SQL = f"""
    a AS (SELECT p_brand AS symbol, replace(p_brand, 'Brand#', '')::INTEGER AS k, p_partkey, {_TITLE_SQL} AS title, p_type,
                 row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
    an AS (SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 'other ' ELSE '' END || symbol AS symbol) FROM a WHERE pos < 8),
    dr AS (SELECT symbol, count(*) AS announcement_count,
                  concat_ws(',', CASE WHEN bool_or(contains(title, '减持')) THEN '减持' END,
                            CASE WHEN bool_or(contains(title, '问询')) THEN '问询' END,
                            CASE WHEN bool_or(contains(title, '预亏')) THEN '预亏' END) AS disclosure_risks,
                  concat_ws(',', CASE WHEN bool_or(contains(title, '年度报告')) THEN 'annual_report' END,
                            CASE WHEN bool_or(contains(title, '利润分配')) THEN 'dividend' END,
                            CASE WHEN bool_or(contains(title, '回购')) THEN 'buyback' END) AS disclosure_topics
           FROM an GROUP BY symbol)"""


def _notices(spark, sf):
    part = Tables(spark, sf).part
    s = F.col("p_size") % 16
    words = ("关于股东减持计划", "2024年年度报告", "利润分配方案", "回购股份", "关于问询函的回复", "业绩预亏公告")
    title = F.lit("董事会决议")
    for i, w in enumerate(words):
        title = F.when(s == i, w).otherwise(title)
    item = F.struct("p_partkey", F.lit("2024-03-05 00:00:00").alias("notice_date"),
                    F.concat(F.lit(" "), title, F.lit(" ")).alias("title"),
                    F.col("p_partkey").cast("string").alias("art_code"),
                    F.array(F.struct(F.col("p_type").alias("column_name"))).alias("columns"))
    per = part.groupBy(F.col("p_brand").alias("symbol")).agg(F.sort_array(F.collect_list(item)).alias("list"))
    blank = F.struct(F.lit(-1).cast("bigint").alias("p_partkey"), F.lit("").alias("notice_date"), F.lit("  ").alias("title"),
                     F.lit("x").alias("art_code"), F.array(F.struct(F.lit("x").alias("column_name"))).alias("columns"))
    doc = F.to_json(F.struct(F.struct(F.concat(F.array(blank), F.col("list")).alias("list")).alias("data")))
    k = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    symbol = F.when(k % 9 == 0, F.concat(F.lit("other "), "symbol")).otherwise(F.col("symbol"))
    return announcements(per.select(symbol.alias("symbol"), doc.alias("payload")))


@query("announcements", "WITH " + _NOTICES_SQL + """
    SELECT symbol, pos AS position, '2024-03-05' AS published_at, title, p_partkey::VARCHAR AS article_code,
           p_type AS category FROM an""")
def notices(spark, sf):
    return _notices(spark, sf)


@query("disclosure_flags", "WITH " + _NOTICES_SQL + """
    SELECT symbol, 'available' AS disclosure_status, announcement_count, disclosure_risks, disclosure_topics FROM dr""")
def flags(spark, sf):
    out = disclosure_flags(_notices(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("disclosure_risks", "disclosure_topics")})


@query("security_decisions", _CONTEXT_SQL + "," + _STATEMENTS_SQL + "," + _NOTICES_SQL + """,
    j AS (SELECT c.symbol, c.alignment, coalesce(ss.profit_signal, 'unknown') AS profit_signal,
                 ss.symbol IS NULL AS no_statement, dr.symbol IS NULL AS no_disclosure,
                 coalesce(disclosure_risks, '') AS dr, CASE WHEN contains(coalesce(disclosure_risks, ''), '减持') THEN 1 ELSE 0 END
                 + CASE WHEN contains(coalesce(disclosure_risks, ''), '问询') THEN 1 ELSE 0 END AS event_risk_count
          FROM ctx c LEFT JOIN ss USING (symbol) LEFT JOIN dr ON dr.symbol = c.symbol),
    q AS (SELECT *, CASE WHEN no_statement OR no_disclosure THEN 'technical_only'
                         WHEN alignment = 'tailwind' AND profit_signal = 'positive' AND dr = '' THEN 'constructive'
                         WHEN alignment = 'mixed' AND profit_signal = 'positive' AND dr = '' THEN 'watchful_positive'
                         WHEN alignment = 'headwind' OR profit_signal = 'negative' OR dr <> '' THEN 'cautious'
                         ELSE 'mixed_watch' END AS stance,
                 CASE WHEN no_statement OR no_disclosure OR alignment = 'unavailable' THEN 'degraded' ELSE 'complete' END AS evidence_status,
                 concat_ws(',', CASE WHEN no_statement THEN 'statement' END,
                           CASE WHEN no_disclosure THEN 'disclosure' END,
                           CASE WHEN alignment = 'unavailable' THEN 'context' END) AS data_gaps FROM j),
    dw AS (SELECT *, CASE WHEN data_gaps <> '' THEN 1 ELSE 0 END + CASE WHEN alignment <> 'tailwind' THEN 1 ELSE 0 END
                 + CASE WHEN event_risk_count > 0 OR evidence_status <> 'complete' THEN 1 ELSE 0 END AS warn_count FROM q),
    u AS (SELECT *, CASE WHEN evidence_status <> 'complete' OR warn_count > 0 THEN 'needs_more_evidence'
                         ELSE 'ready_for_review' END AS status,
                 round(least(greatest(CASE stance WHEN 'watchful_positive' THEN 0.66 ELSE 0.35 END
                   + CASE WHEN alignment = 'tailwind' THEN 0.08 ELSE 0 END
                   - CASE WHEN evidence_status <> 'complete' THEN 0.08 ELSE 0 END - warn_count * 0.05, 0), 0.95)::DOUBLE, 6)
                 AS confidence_score FROM dw)
    SELECT symbol, alignment, stance, evidence_status, data_gaps, event_risk_count::INTEGER AS event_risk_count,
           'pass,' || CASE WHEN data_gaps <> '' THEN 'warn' ELSE 'pass' END || ','
           || CASE WHEN alignment <> 'tailwind' THEN 'warn' ELSE 'pass' END || ','
           || CASE WHEN event_risk_count > 0 OR evidence_status <> 'complete' THEN 'warn' ELSE 'pass' END || ',pass' AS gates,
           warn_count::INTEGER AS warn_count, status, 'long' AS direction, confidence_score,
           CASE status WHEN 'needs_more_evidence' THEN 'pilot' ELSE 'starter' END AS position_size,
           CASE status WHEN 'needs_more_evidence' THEN 'probe_only' ELSE 'reviewable' END AS plan_status,
           CASE status WHEN 'needs_more_evidence' THEN 0.05 ELSE 0.1 END::DOUBLE AS suggested_gross_pct,
           CASE status WHEN 'needs_more_evidence' THEN 0.03 ELSE 0.06 END::DOUBLE AS starter_gross_pct,
           CASE status WHEN 'needs_more_evidence' THEN 0.05 ELSE 0.13 END::DOUBLE AS max_gross_pct FROM u""")
def decisions(spark, sf):
    out = security_decision(_context(spark, sf), _statements(spark, sf), disclosure_flags(_notices(spark, sf)),
                            0.05, 0.12, 2.0)
    out = out.select("symbol", "alignment", "stance", "evidence_status", F.array_join("data_gaps", ",").alias("data_gaps"),
                     "event_risk_count", F.array_join("gates.result", ",").alias("gates"), "warn_count", "status",
                     "direction", "confidence_score", "position_size", "plan_status", "suggested_gross_pct",
                     "starter_gross_pct", "max_gross_pct")
    return rounded(out, ["confidence_score", "suggested_gross_pct", "starter_gross_pct", "max_gross_pct"], 6)
