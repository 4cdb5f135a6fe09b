"""Signals read off an indicator snapshot: plain rule chains per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.operators.bars import SNAPSHOT, indicator_snapshot
from loomtable.registry import operator
from loomtable.session import cut_lineage

C = F.col
# The breakout outcomes that settle a structure.
SETTLED = ("confirmed_resistance_breakout", "confirmed_resistance_retest_hold", "confirmed_support_breakdown",
           "confirmed_support_retest_reject", "failed_resistance_breakout", "failed_support_breakdown")
WATCHED = ("resistance_breakout_watch", "resistance_retest_watch", "support_breakdown_watch", "support_retest_watch")


def _ladder(*pairs, otherwise="neutral") -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def _plain_signals() -> dict[str, Column]:
    close, band = C("close"), C("boll_width_ratio_20")
    position = _ladder((close >= C("boll_upper"), "upper_band_breakout_risk"),
                       (close <= C("boll_lower"), "lower_band_rebound_candidate"))
    inside = (close < C("boll_upper")) & (close > C("boll_lower"))
    atr_share = F.when(F.abs(close) > 2.3e-16, C("atr_14") / F.nullif(F.abs(close), F.lit(0.0))).otherwise(0.0)
    return {
        "trend_strength": _ladder((C("adx_14") >= 25, "strong"), (C("adx_14") < 20, "weak"), otherwise="moderate"),
        "money_flow_signal": _ladder((C("mfi_14") >= 80, "overbought_distribution"),
                                     (C("mfi_14") <= 20, "oversold_accumulation")),
        "mean_reversion_signal": _ladder((C("cci_20") >= 100, "overbought_reversal_risk"),
                                         (C("cci_20") <= -100, "oversold_rebound_candidate")),
        "range_position_signal": _ladder((C("williams_r_14") >= -20, "overbought_pullback_risk"),
                                         (C("williams_r_14") <= -80, "oversold_rebound_candidate")),
        "bollinger_position_signal": position,
        "bollinger_midline_signal": _ladder((inside & (close > C("boll_middle")), "midline_support_bias"),
                                            (inside & (close < C("boll_middle")), "midline_resistance_bias")),
        "bollinger_bandwidth_signal": _ladder((band >= 0.12, "expanding"), (band <= 0.05, "contracting"),
                                              otherwise="normal"),
        "momentum_signal": _ladder(((C("macd") > C("macd_signal")) & (C("rsi_14") >= 55), "positive"),
                                   ((C("macd") < C("macd_signal")) & (C("rsi_14") <= 45), "negative")),
        "timing_signal": _ladder(
            ((C("rsi_14") <= 30) & (C("k_9") > C("d_9")) & (C("j_9") > C("k_9")) & (C("macd_histogram") > 0),
             "oversold_rebound"),
            ((C("rsi_14") >= 70) & (C("k_9") < C("d_9")) & (C("j_9") < C("k_9")) & (C("macd_histogram") < 0),
             "overbought_pullback")),
        "rsrs_signal": _ladder(((C("rsrs_zscore_18_60") >= 0.7) & (C("rsrs_beta_18") >= 1), "bullish_breakout"),
                               ((C("rsrs_zscore_18_60") <= -0.7) & (C("rsrs_beta_18") <= 1), "bearish_pressure")),
        "volatility_state": _ladder(((atr_share >= 0.03) | (band >= 0.18) | ~inside, "high"), otherwise="normal")}


def _trend_bias() -> Column:
    chain = [C("close"), C("ema_10"), C("sma_50"), C("sma_200")]
    up = (chain[0] > chain[1]) & (chain[1] > chain[2]) & (chain[2] > chain[3]) & (C("plus_di_14") >= C("minus_di_14"))
    down = (chain[0] < chain[1]) & (chain[1] < chain[2]) & (chain[2] < chain[3]) & (C("minus_di_14") >= C("plus_di_14"))
    return _ladder((C("trend_strength") == "weak", "sideways"), (up, "bullish"), (down, "bearish"), otherwise="sideways")


def _volume_confirmation() -> Column:
    aligned = ((C("trend_bias") == "bullish") & (C("obv") >= 0)) | ((C("trend_bias") == "bearish") & (C("obv") < 0))
    return _ladder((aligned & (C("trend_strength") != "weak") & (C("volume_ratio_20") >= 1), "confirmed"),
                   (C("volume_ratio_20") < 0.95, "weakening"))


def _divergence() -> Column:
    """The last bar against the 19 before it, then the last 10 against the 20 before them."""
    def ends(name):
        a = C(name)
        now, near = F.element_at(a, -1), F.slice(a, -20, 19)
        late, early = F.slice(a, -10, 10), F.slice(a, -30, 20)
        return now, near, late, early

    p, pn, pl, pe = ends("closes")
    o, on, ol, oe = ends("obv_tail")
    top, low = F.array_max, F.array_min
    found = _ladder(
        ((p > top(pn)) & (o < top(on)), "bearish_divergence"), ((p < low(pn)) & (o > low(on)), "bullish_divergence"),
        ((top(pl) > top(pe)) & (top(ol) < top(oe)), "bearish_divergence"),
        ((low(pl) < low(pe)) & (low(ol) > low(oe)), "bullish_divergence"), otherwise="none")
    return F.when(F.size("closes") >= 30, found).otherwise("none")


def _anchor(buffer: Column, upward: bool) -> Column:
    """Level of the latest break 2 to 5 bars back that has held since and been touched."""
    levels = []
    for back in range(2, 6):
        at = -1 - back
        before = F.slice("closes", at - 21, 20)
        level = F.array_max(before) if upward else F.array_min(before)
        broke = F.element_at("closes", at) > level if upward else F.element_at("closes", at) < level
        since = F.slice("closes", at + 1, back - 1)
        held = F.forall(since, lambda x: (x >= level - buffer) if upward else (x <= level + buffer))
        touched = F.exists(since, lambda x: F.abs(x - level) <= buffer + 1e-9)
        levels.append(F.when((F.size("closes") >= -at + 21) & broke & held & touched, level))
    return F.coalesce(*levels)


def _breakout() -> Column:
    close, up, down = C("close"), C("resistance_level_20"), C("support_level_20")
    b, last, high, low = C("__buffer"), C("__last"), C("__high"), C("__low")
    near = lambda level: F.abs(close - level) <= b + 1e-9
    broke_up, broke_down = last > high, last < low
    held_up, held_down = C("__anchor_up"), C("__anchor_down")
    # an upward anchor, when there is one, hides a downward one
    only_down = held_up.isNull() & held_down.isNotNull()

    def stage(first_up, first_down, later_up, later_down, names):
        """One retest stage: the bar before first, then older anchors."""
        one, two = broke_up & first_up, broke_down & first_down
        rest = ~one & ~two
        return ((one, names[0]), (~one & two, names[1]), (rest & held_up.isNotNull() & later_up, names[0]),
                (rest & only_down & later_down, names[1]))

    pairs = [((C("trend_bias") == "bullish") & (close > up), "confirmed_resistance_breakout"),
             (close > up, "resistance_breakout_watch"),
             ((C("trend_bias") == "bearish") & (close < down), "confirmed_support_breakdown"),
             (close < down, "support_breakdown_watch")]
    pairs += stage(near(high) & (close < up), near(low) & (close > down),
                   near(held_up) & (close < up), near(held_down) & (close > down),
                   ("resistance_retest_watch", "support_retest_watch"))
    pairs += stage((close >= high + b) & (close < up), (close <= low - b) & (close > down),
                   (close >= held_up + b) & (close < up), (close <= held_down - b) & (close > down),
                   ("confirmed_resistance_retest_hold", "confirmed_support_retest_reject"))
    pairs += stage(close < high - b, close > low + b, close < held_up - b, close > held_down + b,
                   ("failed_resistance_breakout", "failed_support_breakdown"))
    return _ladder(*pairs, otherwise="range_bound")


def _bias() -> Column:
    s = C("breakout_signal")
    moving = C("trend_strength").isin("strong", "moderate")
    return _ladder(
        (s.isin("confirmed_resistance_breakout", "confirmed_resistance_retest_hold"), "bullish_continuation"),
        (s.isin("resistance_breakout_watch", "resistance_retest_watch"), "bullish_confirmation_watch"),
        (s.isin("confirmed_support_breakdown", "confirmed_support_retest_reject"), "bearish_continuation"),
        (s.isin("support_breakdown_watch", "support_retest_watch"), "bearish_confirmation_watch"),
        (s == "failed_resistance_breakout", "bull_trap_risk"), (s == "failed_support_breakdown", "bear_trap_risk"),
        ((C("trend_bias") == "bullish") & moving, "bullish_range_watch"),
        ((C("trend_bias") == "bearish") & moving, "bearish_range_watch"),
        ((C("divergence_signal") == "bullish_divergence") & (C("timing_signal") == "oversold_rebound"),
         "bullish_range_watch"),
        ((C("divergence_signal") == "bearish_divergence") & (C("timing_signal") == "overbought_pullback"),
         "bearish_range_watch"), otherwise="range_wait")


def expected_direction(bias: Column) -> Column:
    return (F.when(bias.isin("bullish_continuation", "bullish_confirmation_watch", "bullish_range_watch",
                             "bear_trap_risk"), "bullish")
            .when(bias.isin("bearish_continuation", "bearish_confirmation_watch", "bearish_range_watch",
                            "bull_trap_risk"), "bearish"))


def _score() -> Column:
    def points(column, plus, minus):
        return F.when(C(column) == plus, 1).when(C(column) == minus, -1).otherwise(0)

    way = expected_direction(C("bias"))
    side = lambda plus: (points("momentum_signal", *plus[0]) + points("rsrs_signal", *plus[1])
                         - F.when(C("divergence_signal") == plus[2], 1).otherwise(0))
    up = side((("positive", "negative"), ("bullish_breakout", "bearish_pressure"), "bearish_divergence"))
    down = side((("negative", "positive"), ("bearish_pressure", "bullish_breakout"), "bullish_divergence"))
    return (F.when(C("breakout_signal").isin(*SETTLED), 2).when(C("breakout_signal").isin(*WATCHED), 1).otherwise(0)
            + points("trend_strength", "strong", "weak") + points("volume_confirmation", "confirmed", "weakening")
            + F.when(way == "bullish", up).when(way == "bearish", down).otherwise(0))


def _confidence() -> Column:
    b, s = C("bias"), C("score")
    return _ladder((b == "range_wait", "low"),
                   (b.isin("bullish_range_watch", "bearish_range_watch"), F.when(s >= 1, "medium").otherwise("low")),
                   (b.endswith("_watch"), F.when(s >= 2, "medium").otherwise("low")),
                   (C("breakout_signal").isin(*SETTLED) & (s < 2), "medium"),
                   (s >= 4, "high"), (s >= 2, "medium"), otherwise="low")


SIGNALS = ("trend_strength", "trend_bias", "volume_confirmation", "money_flow_signal", "mean_reversion_signal",
           "range_position_signal", "bollinger_position_signal", "bollinger_midline_signal",
           "bollinger_bandwidth_signal", "momentum_signal", "timing_signal", "rsrs_signal", "volatility_state",
           "divergence_signal", "breakout_signal", "bias", "score", "confidence")


@operator("technical_signals")
def technical_signals(snapshot: DataFrame) -> DataFrame:
    """Adds every signal, the consultation bias, its score and confidence."""
    need_columns(snapshot, [*SNAPSHOT, "closes", "obv_tail"])
    s = snapshot.withColumns(_plain_signals())
    s = s.withColumn("trend_bias", _trend_bias())
    s = s.withColumns({"volume_confirmation": _volume_confirmation(), "divergence_signal": _divergence(),
                       "__buffer": F.greatest(C("atr_14") * 0.25, F.lit(0.15)),
                       "__last": F.element_at("closes", -2), "__high": F.array_max(F.slice("closes", -22, 20)),
                       "__low": F.array_min(F.slice("closes", -22, 20))})
    s = s.withColumns({"__anchor_up": _anchor(C("__buffer"), True), "__anchor_down": _anchor(C("__buffer"), False)})
    s = s.withColumn("breakout_signal", _breakout()).withColumn("bias", _bias())
    s = s.withColumn("score", _score()).withColumn("confidence", _confidence())
    return s.drop("__buffer", "__last", "__high", "__low", "__anchor_up", "__anchor_down")


@operator("technical_consultation_basic")
def technical_consultation(bars: DataFrame, as_of: str | None = None, lookback: int = 260,
                           min_bars: int = 200, requests: DataFrame | None = None) -> DataFrame:
    """Signals of every symbol, or of every request (symbol, as_of)."""
    return technical_signals(indicator_snapshot(bars, as_of, lookback, min_bars, requests)).drop("closes", "obv_tail")


# ---- surroundings ----

def bias_direction(bias: Column) -> Column:
    return (F.when(bias.isin("bullish_continuation", "bull_trap_risk"), "bullish")
            .when(bias.isin("bearish_continuation", "bear_trap_risk"), "bearish").otherwise("neutral"))


@operator("contextual_alignment")
def contextual_alignment(signals: DataFrame, proxies: DataFrame) -> DataFrame:
    """Stock, market proxy and sector proxy together: tailwind, headwind or mixed.

    ``proxies`` maps symbol to market_symbol and sector_symbol.  A symbol without a proxy, or whose proxy has no signal,
    stays with the alignment ``unavailable``.  Signals of many dates (column ``as_of``) meet those of the same date.
    """
    need_columns(signals, ["symbol", "bias"])
    need_columns(proxies, ["symbol", "market_symbol", "sector_symbol"])
    signals = cut_lineage(signals)  # read three times below; one row per symbol, or per symbol and date
    dates = [c for c in ("as_of",) if c in signals.columns]
    other = lambda p: signals.select(*dates, C("symbol").alias(f"{p}_symbol"), C("bias").alias(f"{p}_bias"))
    rows = (signals.join(proxies, "symbol", "left").join(other("market"), ["market_symbol", *dates], "left")
            .join(other("sector"), ["sector_symbol", *dates], "left"))
    own, market, sector = (bias_direction(C(b)) for b in ("bias", "market_bias", "sector_bias"))
    known = C("market_bias").isNotNull() & C("sector_bias").isNotNull()
    alignment = _ladder((~known, "unavailable"), (own == "neutral", "mixed"), ((own == market) & (own == sector), "tailwind"),
                        ((own != market) & (own != sector), "headwind"), otherwise="mixed")
    return rows.withColumn("alignment", alignment)


@operator("contextual_consultation")
def contextual_consultation(bars: DataFrame, requests: DataFrame, proxies: DataFrame, lookback: int = 260, min_bars: int = 200) -> DataFrame:
    """Signals and alignment of every request (symbol, as_of), each with its proxies as of the same date.

    The proxies' dates join the requests, so all three analyses come from one pass over the bars.
    """
    need_columns(requests, ["symbol", "as_of"])
    asked = cut_lineage(requests.select("symbol", "as_of").dropna().distinct())
    known = asked.join(proxies, "symbol")
    every = asked.unionByName(known.select(C("market_symbol").alias("symbol"), "as_of")).unionByName(
        known.select(C("sector_symbol").alias("symbol"), "as_of"))
    signals = technical_consultation(bars, None, lookback, min_bars, every)
    return contextual_alignment(signals, proxies).join(asked, ["symbol", "as_of"], "left_semi")
