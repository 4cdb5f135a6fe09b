import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomtable.operators.bars import SNAPSHOT, indicator_series, indicator_snapshot, short_histories
from loomtable.operators.decisions import (decision_card, disclosure_flags, evidence_quality, integrated_stance,
                                           position_plan, risk_gates, statement_signals)
from loomtable.operators.signals import contextual_alignment, technical_consultation, technical_signals
from loomtable.sources.prices import recent_bars

BAR = "symbol string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint"
START = dt.date(2025, 1, 1)


def rising(n=220, symbol="UP", step=1.35, volume=lambda i: 1_000_000 + 12_000 * i):
    out = []
    for i in range(n):
        b = 100 + step * i
        out.append((symbol, START + dt.timedelta(i), b, b + 2.4, b - 1.8, b + 1.6, b + 1.6, volume(i)))
    return out


def noisy(symbol, seed, n=300):
    rng, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o = c
        c = max(5.0, c + rng.gauss(0, 2))
        out.append((symbol, START + dt.timedelta(i), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, c,
                    rng.randrange(1000, 9000)))
    return out


def plain_snapshot(bars):
    """The indicator formulas in plain Python, one bar after the other."""
    bars = bars[-260:]
    h, low, c, v = ([b[i] for b in bars] for i in (3, 4, 5, 7))
    n, tp = len(c), [(a + b + x) / 3 for a, b, x in zip(h, low, c)]
    mean = statistics.fmean

    def ema(x, p):
        out, k = [x[0]], 2 / (p + 1)
        for y in x[1:]:
            out.append(k * y + (1 - k) * out[-1])
        return out

    def wilder(x, p=14):
        a = sum(x[:p]) / p
        for y in x[p:]:
            a = (a * (p - 1) + y) / p
        return a

    macd = [a - b for a, b in zip(ema(c, 12), ema(c, 26))]
    signal = ema(macd, 9)[-1]
    d = [b - a for a, b in zip(c, c[1:])]
    gain, loss = wilder([max(x, 0) for x in d]), wilder([max(-x, 0) for x in d])
    tr = [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, n)]
    up = [h[i] - h[i - 1] if h[i] - h[i - 1] > max(low[i - 1] - low[i], 0) else 0 for i in range(1, n)]
    dn = [low[i - 1] - low[i] if low[i - 1] - low[i] > max(h[i] - h[i - 1], 0) else 0 for i in range(1, n)]
    t, p, m, dx = sum(tr[:14]), sum(up[:14]), sum(dn[:14]), []
    for i in range(13, n - 1):
        if i >= 14:
            t, p, m = t - t / 14 + tr[i], p - p / 14 + up[i], m - m / 14 + dn[i]
        a, b = p / t * 100, m / t * 100
        dx.append(abs(a - b) / (a + b) * 100 if a + b else 0)
    obv = 0
    for i in range(1, n):
        obv += v[i] * ((c[i] > c[i - 1]) - (c[i] < c[i - 1]))
    pos = sum(tp[i] * v[i] for i in range(n - 14, n) if tp[i] > tp[i - 1])
    neg = sum(tp[i] * v[i] for i in range(n - 14, n) if tp[i] < tp[i - 1])
    tm = mean(tp[-20:])
    k = dd = 50
    for i in range(8, n):
        hh, ll = max(h[i - 8:i + 1]), min(low[i - 8:i + 1])
        k = (2 * k + (50 if hh == ll else (c[i] - ll) / (hh - ll) * 100)) / 3
        dd = (2 * dd + k) / 3
    beta = []
    for i in range(17, n):
        x, y = low[i - 17:i + 1], h[i - 17:i + 1]
        mx, my = mean(x), mean(y)
        beta.append(sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x))
    sd, mid = statistics.pstdev(c[-20:]), mean(c[-20:])
    bsd = statistics.pstdev(beta[-60:])
    hh, ll = max(h[-14:]), min(low[-14:])
    return dict(
        close=c[-1], ema_10=ema(c, 10)[-1], sma_50=mean(c[-50:]), sma_200=mean(c[-200:]), adx_14=wilder(dx),
        plus_di_14=p / t * 100, minus_di_14=m / t * 100, obv=obv, volume_sma_20=mean(v[-20:]),
        volume_ratio_20=v[-1] / mean(v[-20:]), mfi_14=100 - 100 / (1 + pos / neg) if pos and neg else 50 if pos == neg else 100 if pos else 0,
        cci_20=(tp[-1] - tm) / (0.015 * mean(abs(x - tm) for x in tp[-20:])), williams_r_14=(hh - c[-1]) / (hh - ll) * -100,
        boll_width_ratio_20=4 * sd / mid, macd=macd[-1], macd_signal=signal, macd_histogram=macd[-1] - signal,
        rsi_14=100 - 100 / (1 + gain / loss) if loss else 100, k_9=k, d_9=dd, j_9=3 * k - 2 * dd, rsrs_beta_18=beta[-1],
        rsrs_zscore_18_60=(beta[-1] - mean(beta[-60:])) / bsd if bsd > 2.3e-16 else 0, boll_upper=mid + 2 * sd, boll_middle=mid,
        boll_lower=mid - 2 * sd, support_level_20=min(c[-21:-1]), resistance_level_20=max(c[-21:-1]), atr_14=wilder(tr))


def test_snapshot_against_a_plain_model(frame):
    data = {s: noisy(s, i) for i, s in enumerate("ABC")}
    df = frame(BAR, *[b for bars in data.values() for b in bars])
    got = {r["symbol"]: r for r in indicator_snapshot(df).collect()}
    for s, bars in data.items():
        want = plain_snapshot(bars)
        assert set(want) == set(SNAPSHOT)
        for name, value in want.items():
            assert got[s][name] == pytest.approx(value, rel=1e-9, abs=1e-7), name


def test_series_end_where_the_snapshot_does_without_a_cut(frame):
    bars = noisy("A", 7, 250)
    last = indicator_series(frame(BAR, *bars)).orderBy(F.desc("trade_date")).first()
    want = plain_snapshot(bars)
    for series, name in (("close_10_ema", "ema_10"), ("macd", "macd"), ("macds", "macd_signal"), ("macdh", "macd_histogram"),
                         ("rsi", "rsi_14"), ("atr", "atr_14"), ("boll_ub", "boll_upper"), ("close_200_sma", "sma_200"), ("mfi", "mfi_14")):
        assert last[series] == pytest.approx(want[name]), series
    short = indicator_series(frame(BAR, *bars[:10]), ["rsi", "boll", "macd"]).collect()
    assert {r["rsi"] for r in short} == {None} and {r["boll"] for r in short} == {None}
    with pytest.raises(ValueError, match="unknown indicator"):
        indicator_series(frame(BAR, *bars[:3]), ["nope"])


def test_lookback_and_as_of(frame):
    df = frame(BAR, *rising(220), *rising(50, "FEW"))
    cut = recent_bars(df, 10, "2025-02-10")
    assert cut.filter("symbol = 'UP'").agg(F.min("trade_date"), F.max("trade_date"), F.count("*")).first() == (
        dt.date(2025, 2, 1), dt.date(2025, 2, 10), 10)
    assert [r["symbol"] for r in indicator_snapshot(df).collect()] == ["UP"]
    assert [tuple(r) for r in short_histories(df).collect()] == [("FEW", 50)]


def test_signals_of_a_steady_rise(frame):
    s = technical_consultation(frame(BAR, *rising())).first()
    assert (s.trend_bias, s.trend_strength, s.volume_confirmation) == ("bullish", "strong", "confirmed")
    assert s.breakout_signal == "confirmed_resistance_breakout" and s.bias == "bullish_continuation"
    assert (s.money_flow_signal, s.confidence) == ("overbought_distribution", "high")
    fading = technical_consultation(frame(BAR, *rising(220, volume=lambda i: 3_000_000 - 9_000 * i))).first()
    assert fading.volume_confirmation == "weakening"
    falling = technical_consultation(frame(BAR, *rising(220, step=-0.35))).first()
    assert (falling.trend_bias, falling.breakout_signal, falling.bias) == (
        "bearish", "confirmed_support_breakdown", "bearish_continuation")


BASE = dict(symbol="S", close=100.0, ema_10=99.0, sma_50=98.0, sma_200=96.0, adx_14=28.0, plus_di_14=24.0, minus_di_14=18.0,
            obv=1e6, volume_sma_20=950000.0, volume_ratio_20=1.0, mfi_14=50.0, cci_20=0.0, williams_r_14=-50.0,
            boll_width_ratio_20=0.08, macd=1.0, macd_signal=0.5, macd_histogram=0.5, rsi_14=50.0, k_9=50.0, d_9=50.0, j_9=50.0,
            rsrs_beta_18=1.0, rsrs_zscore_18_60=0.0, boll_upper=110.0, boll_middle=100.0, boll_lower=90.0, support_level_20=90.0,
            resistance_level_20=120.0, atr_14=2.0)


def classify(spark, closes=None, obvs=None, **changes):
    row = {**BASE, **changes, "closes": [float(x) for x in closes or [100.0] * 30], "obv_tail": [float(x) for x in obvs or [0.0] * 30]}
    schema = ", ".join(f"{k} {'string' if k == 'symbol' else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in row.items())
    return technical_signals(spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in row.values())], schema)).first()


@pytest.mark.parametrize("changes,signal,value", [
    ({"adx_14": 25.0}, "trend_strength", "strong"), ({"adx_14": 24.99}, "trend_strength", "moderate"),
    ({"adx_14": 20.0}, "trend_strength", "moderate"), ({"adx_14": 19.99}, "trend_strength", "weak"),
    ({"mfi_14": 80.0}, "money_flow_signal", "overbought_distribution"), ({"mfi_14": 79.99}, "money_flow_signal", "neutral"),
    ({"mfi_14": 20.0}, "money_flow_signal", "oversold_accumulation"), ({"cci_20": 100.0}, "mean_reversion_signal", "overbought_reversal_risk"),
    ({"cci_20": -99.9}, "mean_reversion_signal", "neutral"), ({"williams_r_14": -20.0}, "range_position_signal", "overbought_pullback_risk"),
    ({"williams_r_14": -80.0}, "range_position_signal", "oversold_rebound_candidate"),
    ({"close": 110.0}, "bollinger_position_signal", "upper_band_breakout_risk"), ({"close": 110.0}, "volatility_state", "high"),
    ({"close": 100.5}, "bollinger_midline_signal", "midline_support_bias"), ({"boll_width_ratio_20": 0.12}, "bollinger_bandwidth_signal", "expanding"),
    ({"boll_width_ratio_20": 0.05}, "bollinger_bandwidth_signal", "contracting"), ({"rsi_14": 55.0}, "momentum_signal", "positive"),
    ({"rsi_14": 54.9}, "momentum_signal", "neutral"), ({"rsi_14": 30.0, "k_9": 30.0, "d_9": 20.0, "j_9": 40.0}, "timing_signal", "oversold_rebound"),
    ({"rsrs_zscore_18_60": 0.7}, "rsrs_signal", "bullish_breakout"), ({"rsrs_zscore_18_60": 0.7, "rsrs_beta_18": 0.99}, "rsrs_signal", "neutral"),
    ({"rsrs_zscore_18_60": -0.7}, "rsrs_signal", "bearish_pressure"), ({"volume_ratio_20": 0.94}, "volume_confirmation", "weakening"),
    ({"volume_ratio_20": 0.95}, "volume_confirmation", "neutral"), ({"atr_14": 3.0}, "volatility_state", "high"),
    ({"close": 120.1}, "breakout_signal", "confirmed_resistance_breakout"), ({"close": 120.1, "adx_14": 10.0}, "breakout_signal", "resistance_breakout_watch"),
    ({"close": 89.9}, "breakout_signal", "support_breakdown_watch")])
def test_thresholds(spark, changes, signal, value):
    assert classify(spark, **changes)[signal] == value


def test_retests_of_the_bar_before(spark):
    flat = [100.0] * 28
    held = dict(resistance_level_20=103.0, support_level_20=95.0)
    assert classify(spark, flat + [103.0, 100.3], close=100.3, **held).breakout_signal == "resistance_retest_watch"
    assert classify(spark, flat + [103.0, 101.0], close=101.0, **held).breakout_signal == "confirmed_resistance_retest_hold"
    assert classify(spark, flat + [103.0, 99.0], close=99.0, **held).breakout_signal == "failed_resistance_breakout"
    down = dict(resistance_level_20=105.0, support_level_20=97.0)
    assert classify(spark, flat + [97.0, 99.8], close=99.8, **down).breakout_signal == "support_retest_watch"
    assert classify(spark, flat + [97.0, 99.0], close=99.0, **down).breakout_signal == "confirmed_support_retest_reject"
    s = classify(spark, flat + [97.0, 101.0], close=101.0, **down)
    assert (s.breakout_signal, s.bias) == ("failed_support_breakdown", "bear_trap_risk")


def test_retests_of_older_breaks(spark):
    levels = dict(resistance_level_20=104.0, support_level_20=95.0)
    # break three bars ago, held since, touched, and back at the level now
    path = [100.0] * 26 + [104.0, 101.0, 100.2, 100.4]
    assert classify(spark, path, close=100.4, **levels).breakout_signal == "resistance_retest_watch"
    assert classify(spark, path[:-1] + [101.5], close=101.5, **levels).breakout_signal == "confirmed_resistance_retest_hold"
    assert classify(spark, path[:-1] + [99.0], close=99.0, **levels).breakout_signal == "failed_resistance_breakout"
    never_touched = [100.0] * 26 + [104.0, 103.0, 102.0, 100.4]
    assert classify(spark, never_touched, close=100.4, **levels).breakout_signal == "range_bound"


def test_divergence(spark):
    up, obv = [100.0] * 29 + [105.0], [0.0] * 15 + [9.0] * 14 + [5.0]
    assert classify(spark, up, obv).divergence_signal == "bearish_divergence"
    assert classify(spark, [-x for x in up], [-x for x in obv]).divergence_signal == "bullish_divergence"
    assert classify(spark).divergence_signal == "none"


def test_context_and_decisions(frame):
    signals = frame("symbol string, bias string, as_of_date string", ("S", "bullish_continuation", "d"), ("M", "bull_trap_risk", "d"),
                    ("I", "bullish_continuation", "d"), ("X", "bearish_continuation", "d"), ("N", "range_wait", "d"), ("Q", "range_wait", "d"))
    proxies = frame("symbol string, market_symbol string, sector_symbol string", ("S", "M", "I"), ("X", "M", "I"), ("N", "M", "I"),
                    ("I", "X", "M"), ("Q", "M", "nobody"))
    context = contextual_alignment(signals, proxies)
    got = {r.symbol: r.alignment for r in context.collect()}
    assert got == {"S": "tailwind", "X": "headwind", "N": "mixed", "I": "mixed", "M": "unavailable", "Q": "unavailable"}
    st = statement_signals(frame("symbol string, statement_status string, revenue_yoy_pct double, net_profit_yoy_pct double, roe_pct double",
                                 ("S", "available", 5.0, 0.0, 12.0), ("X", "available", -1.0, -2.0, 5.0), ("N", "available", 1.0, None, 9.0)))
    assert {r.symbol: r.profit_signal for r in st.collect()} == {"S": "positive", "X": "negative", "N": "unknown"}
    di = disclosure_flags(frame("symbol string, title string, position int", ("S", "2025年年度报告", 0), ("X", "关于诉讼事项", 0), ("N", "问询函", 0)))
    rows = evidence_quality(integrated_stance(context, st, di))
    out = {r.symbol: r for r in position_plan(decision_card(risk_gates(rows, 0.05, 0.12, 2.0), 0.05, 0.12)).collect()}
    assert {s: r.stance for s, r in out.items()} == {"S": "constructive", "X": "cautious", "N": "cautious", "I": "technical_only",
                                                    "M": "technical_only", "Q": "technical_only"}
    assert out["Q"].data_gaps == ["statement", "disclosure", "context"]
    assert out["S"].status == "ready_for_review" and out["S"].confidence_score == pytest.approx(0.43)
    assert (out["S"].suggested_gross_pct, out["S"].starter_gross_pct, out["S"].max_gross_pct) == pytest.approx((0.10, 0.06, 0.13))
    assert (out["X"].status, out["X"].event_risk_count, out["X"].plan_status) == ("needs_more_evidence", 1, "probe_only")
    assert out["I"].data_gaps == ["statement", "disclosure"] and out["I"].evidence_status == "degraded"
    assert out["S"].second_target == pytest.approx(0.18)
    blocked = decision_card(risk_gates(rows, 0.10, 0.12, 2.0), 0.10, 0.12)
    assert {r.status for r in blocked.collect()} == {"blocked"}
    assert {r.suggested_gross_pct for r in position_plan(blocked).collect()} == {0.0}
