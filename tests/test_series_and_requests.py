"""Indicator series scanned in blocks, and requests of many dates."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomtable.operators.bars import INDICATORS, indicator_series, indicator_snapshot
from loomtable.operators.signals import contextual_alignment, contextual_consultation, technical_consultation
from loomtable.sources.prices import bars_as_of, packed_bars_as_of, recent_bars

BAR = "symbol string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint"


def walk(symbol, seed, n):
    rng, close, day, out = random.Random(seed), 50.0, dt.date(2015, 1, 1), []
    for i in range(n):
        close = max(1.0, close + rng.uniform(-1, 1.02))
        high, low = close + rng.random(), max(0.5, close - rng.random())
        out.append((symbol, day + dt.timedelta(days=i), close, high, low, close, close, rng.randint(1, 1000)))
    return out


def plain_folds(bars):
    """The recursive indicators of one symbol, bar by bar."""
    out, e10, fast, slow, signal, sums = {}, None, None, None, 0.0, {"gain": 0.0, "loss": 0.0, "range": 0.0}
    for i, (_, day, _, high, low, close, _, _) in enumerate(bars):
        if i == 0:
            e10 = fast = slow = close
        else:
            e10, fast, slow = (2 / (n + 1) * close + (1 - 2 / (n + 1)) * e for n, e in ((10, e10), (12, fast), (26, slow)))
            signal = 0.2 * (fast - slow) + 0.8 * signal
            before = bars[i - 1][5]
            new = {"gain": max(close - before, 0), "loss": max(before - close, 0), "range": max(high - low, abs(high - before), abs(low - before))}
            sums = {k: (v + new[k] if i < 14 else (v + new[k]) / 14 if i == 14 else (13 * v + new[k]) / 14) for k, v in sums.items()}
        rsi = None if i < 14 else 100.0 if sums["loss"] <= 1e-15 else 100 - 100 / (1 + sums["gain"] / sums["loss"])
        out[day] = {"close_10_ema": e10, "macd": fast - slow, "macds": signal, "macdh": fast - slow - signal, "rsi": rsi,
                    "atr": None if i < 14 else sums["range"]}
    return out


@pytest.mark.parametrize("block_rows,scan_rows", [(None, 512), (None, 7), (200, 512), (256, 64)])
def test_scanned_blocks_equal_a_walk(frame, block_rows, scan_rows):
    data = {"LONG": walk("LONG", 1, 1300), "MID": walk("MID", 2, 40), "ONE": walk("ONE", 3, 1), "FLAT": [
        ("FLAT", dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 5.0, 1) for i in range(30)]}
    df = frame(BAR, *[b for bars in data.values() for b in bars]).repartition(5)
    names = ["close_10_ema", "macd", "macds", "macdh", "rsi", "atr"]
    got = indicator_series(df, names, block_rows, scan_rows).collect()
    assert len(got) == sum(map(len, data.values()))
    want = {(s, day): v for s, bars in data.items() for day, v in plain_folds(bars).items()}
    for r in got:
        for n in names:
            expected = want[r.symbol, r.trade_date][n]
            assert r[n] == (None if expected is None else pytest.approx(expected, rel=1e-9, abs=1e-9)), (r.symbol, r.trade_date, n)


def test_blocks_give_the_same_of_every_indicator(frame):
    df = frame(BAR, *walk("A", 5, 900), *walk("B", 6, 230))
    whole = indicator_series(df).orderBy("symbol", "trade_date").toPandas()
    split = indicator_series(df, list(INDICATORS), block_rows=250, scan_rows=50).orderBy("symbol", "trade_date").toPandas()
    pd.testing.assert_frame_equal(whole, split, rtol=1e-9)
    with pytest.raises(ValueError, match="at least"):
        indicator_series(df, block_rows=10)


def test_a_hot_symbol_is_spread_and_needs_no_python(frame, spark):
    df = frame(BAR, *walk("HOT", 8, 3000), *walk("COLD", 9, 5))
    out = indicator_series(df, ["macds", "rsi"], block_rows=200, scan_rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert out.filter("symbol = 'HOT'").count() == 3000


# ---- many as-of dates ----

@pytest.mark.parametrize("block_rows", [None, 64])
def test_requests_get_their_own_bars(frame, block_rows):
    rng = random.Random(4)
    bars = walk("A", 1, 300) + walk("B", 2, 10)
    bars = [b for b in bars if rng.random() < 0.8]
    days = [dt.date(2014, 12, 1), dt.date(2015, 1, 3), dt.date(2015, 6, 1), dt.date(2015, 6, 2), dt.date(2015, 10, 20), dt.date(2030, 1, 1)]
    asked = [(s, d) for s in ("A", "B", "NONE") for d in days] + [("A", days[2]), (None, days[2]), ("A", None)]
    df, requests = frame(BAR, *bars, ("A", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1)), frame("symbol string, as_of date", *asked)
    for n in (1, 25, 1000):
        got = sorted((r["symbol"], r["as_of"], r["trade_date"], r["close"]) for r in bars_as_of(df, requests, n, block_rows).collect())
        want = [(s, d, b[1], b[5]) for s, d in set(asked) if s and d for b in [b for b in bars if b[0] == s and b[1] <= d][-n:]]
        assert got == sorted(want)
        assert packed_bars_as_of(df, requests, n, block_rows).filter(F.size("bars") > n).count() == 0
    with pytest.raises(ValueError, match="positive"):
        bars_as_of(df, requests, 0)


def test_no_bar_travels_more_often_than_asked(frame):
    """A request takes two blocks of look-back length, whatever the length of the history."""
    df = frame(BAR, *walk("A", 1, 2000))
    requests = frame("symbol string, as_of date", *[("A", dt.date(2015, 1, 1) + dt.timedelta(days=200 * i)) for i in range(1, 10)])
    assert rows(packed_bars_as_of(df, requests, 50).select(F.size("bars"))) == [(50,)] * 9


def test_snapshots_and_context_of_many_dates_equal_one_date_at_a_time(frame):
    bars = frame(BAR, *walk("A", 1, 420), *walk("M", 2, 420), *walk("S", 3, 330))
    days = [dt.date(2015, 9, 1), dt.date(2015, 12, 24), dt.date(2016, 2, 1)]
    requests = frame("symbol string, as_of date", *[("A", d) for d in days], ("S", days[0]))
    many = {(r.symbol, r.as_of): r for r in indicator_snapshot(bars, requests=requests).collect()}
    proxies = frame("symbol string, market_symbol string, sector_symbol string", ("A", "M", "S"))
    context = {(r.symbol, r.as_of): r for r in contextual_consultation(bars, requests, proxies).collect()}
    assert set(many) == set(context) == {("A", d) for d in days} | {("S", days[0])}
    for d in days:
        one = {r.symbol: r for r in indicator_snapshot(bars, d.isoformat()).collect()}
        assert [many["A", d][c] for c in one["A"].__fields__] == list(one["A"])
        alone = contextual_alignment(technical_consultation(bars, d.isoformat()), proxies).filter("symbol = 'A'").first()
        assert (context["A", d].alignment, context["A", d].bias, context["A", d].market_bias) == (alone.alignment, alone.bias, alone.market_bias)
    assert context["S", days[0]].alignment == "unavailable"
    assert recent_bars(bars, 5, days[0].isoformat()).count() == 15
