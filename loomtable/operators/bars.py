"""Price indicators for all symbols at once.

``indicator_snapshot`` cuts every symbol to its look-back window first (the
recursive indicators start at the first bar of that window), packs those few
hundred bars into arrays with one shuffle, and folds over the arrays.
``indicator_series`` gives the values of named indicators on every date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns
from loomtable.operators.windows import number_rows
from loomtable.registry import operator
from loomtable.sources.prices import packed_bars_as_of, recent_bars

MIN_BARS = 200
LOOKBACK = 260
EPS = 2.220446049250313e-16
# Bars kept next to the snapshot for the signal rules.
TAIL = 30


# ---- small array expressions ----

def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _last(a: Column, k: int) -> Column:
    return F.slice(a, -k, k)


def _mean(a: Column, k: int) -> Column:
    return _sum(_last(a, k)) / k


def _deviation(a: Column, mean: Column, k: int) -> Column:
    return F.sqrt(F.aggregate(_last(a, k), F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / k)


def _rest(a: Column, skip: int) -> Column:
    return F.slice(a, skip + 1, F.greatest(F.size(a) - skip, F.lit(0)))


def _steps(n: Column, make) -> Column:
    """``make(i)`` for every bar i = 2..n (1-based) against its predecessor."""
    return F.transform(F.sequence(F.lit(2), n), make)


def _at(a: Column, i: Column) -> Column:
    return F.element_at(a, i)


def _ema_last(a: Column, period: int) -> Column:
    k = 2.0 / (period + 1)
    return F.aggregate(_rest(a, 1), F.get(a, F.lit(0)), lambda e, x: k * x + (1 - k) * e)


def _macd(c: Column) -> Column:
    fast, slow, smooth = (2.0 / (n + 1) for n in (12, 26, 9))
    start = F.struct(F.get(c, F.lit(0)).alias("f"), F.get(c, F.lit(0)).alias("s"), F.lit(0.0).alias("g"))

    def move(e: Column, x: Column) -> Column:
        f, s = fast * x + (1 - fast) * e["f"], slow * x + (1 - slow) * e["s"]
        return F.struct(f.alias("f"), s.alias("s"), (smooth * (f - s) + (1 - smooth) * e["g"]).alias("g"))

    return F.aggregate(_rest(c, 1), start, move)


def _wilder(a: Column, period: int) -> Column:
    """Mean of the first values, then ``(before * (period - 1) + value) / period``."""
    seed = _sum(F.slice(a, 1, period)) / period
    return F.aggregate(_rest(a, period), seed, lambda m, x: (m * (period - 1) + x) / period)


def _rsi(d: Column) -> Column:
    gain = _wilder(F.transform(d, lambda x: F.greatest(x, F.lit(0.0))), 14)
    loss = _wilder(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))), 14)
    return F.when(loss <= EPS, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))


def _money_flow(up: Column, down: Column) -> Column:
    return (F.when((up <= EPS) & (down <= EPS), 50.0).when(down <= EPS, 100.0).when(up <= EPS, 0.0)
            .otherwise(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0)))))


def _index(part: Column, whole: Column) -> Column:
    return F.when(F.abs(whole) <= EPS, 0.0).otherwise(part / F.nullif(whole, F.lit(0.0)) * 100.0)


def _adx(moves: Column, period: int = 14) -> Column:
    """Folds array(struct(tr, up, down)) into struct(adx, plus, minus)."""
    first = F.slice(moves, 1, period)
    total = lambda f: _sum(F.transform(first, lambda m: m[f]))

    def indexed(tr, up, down, adx, n):
        plus, minus = _index(up, tr), _index(down, tr)
        both = plus + minus
        dx = F.when(both <= EPS, 0.0).otherwise(F.abs(plus - minus) / F.nullif(both, F.lit(0.0)) * 100.0)
        new = (F.when(n < period - 1, adx + dx).when(n == period - 1, (adx + dx) / period)
               .otherwise((adx * (period - 1) + dx) / period))
        return F.struct(tr.alias("tr"), up.alias("up"), down.alias("down"), new.alias("adx"),
                        (n + 1).cast("int").alias("n"))

    start = indexed(total("tr"), total("up"), total("down"), F.lit(0.0), F.lit(0))
    keep = 1.0 - 1.0 / period
    end = F.aggregate(_rest(moves, period), start, lambda s, m: indexed(
        s["tr"] * keep + m["tr"], s["up"] * keep + m["up"], s["down"] * keep + m["down"], s["adx"], s["n"]))
    return F.transform(F.array(end), lambda e: F.struct(
        e["adx"].alias("adx"), _index(e["up"], e["tr"]).alias("plus"),
        _index(e["down"], e["tr"]).alias("minus")))[0]


def _kdj(h: Column, low: Column, c: Column, n: Column, period: int = 9) -> Column:
    def raw(i: Column) -> Column:
        top = F.array_max(F.slice(h, i - (period - 1), F.lit(period)))
        bottom = F.array_min(F.slice(low, i - (period - 1), F.lit(period)))
        v = (_at(c, i) - bottom) / F.nullif(top - bottom, F.lit(0.0)) * 100.0
        return F.when(F.abs(top - bottom) <= EPS, 50.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)))

    def move(s: Column, v: Column) -> Column:
        k = (2.0 * s["k"] + v) / 3.0
        return F.struct(k.alias("k"), ((2.0 * s["d"] + k) / 3.0).alias("d"))

    start = F.struct(F.lit(50.0).alias("k"), F.lit(50.0).alias("d"))
    return F.aggregate(F.transform(F.sequence(F.lit(period), n), raw), start, move)


def _slopes(h: Column, low: Column, n: Column, period: int = 18, count: int = 60) -> Column:
    """Least-squares slopes of high on low over the latest windows."""
    def slope(i: Column) -> Column:
        x0, y0 = _at(low, i), _at(h, i)
        pairs = F.zip_with(F.slice(low, i - (period - 1), F.lit(period)),
                           F.slice(h, i - (period - 1), F.lit(period)),
                           lambda x, y: F.struct((x - x0).alias("x"), (y - y0).alias("y")))
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "xy")])
        s = F.aggregate(pairs, zero, lambda a, p: F.struct(
            (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"),
            (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["xy"] + p["x"] * p["y"]).alias("xy")))
        return F.transform(F.array(s), lambda a: (a["xy"] - a["x"] * a["y"] / period)
                           / F.nullif(a["xx"] - a["x"] * a["x"] / period, F.lit(0.0)))[0]

    return F.transform(F.sequence(n - (count - 1), n), slope)


SNAPSHOT = ("close", "ema_10", "sma_50", "sma_200", "adx_14", "plus_di_14", "minus_di_14", "obv", "volume_sma_20",
            "volume_ratio_20", "mfi_14", "cci_20", "williams_r_14", "boll_width_ratio_20", "macd", "macd_signal",
            "macd_histogram", "rsi_14", "k_9", "d_9", "j_9", "rsrs_beta_18", "rsrs_zscore_18_60", "boll_upper",
            "boll_middle", "boll_lower", "support_level_20", "resistance_level_20", "atr_14")


@operator("indicator_snapshot")
def indicator_snapshot(bars: DataFrame, as_of: str | None = None, lookback: int = LOOKBACK,
                       min_bars: int = MIN_BARS, requests: DataFrame | None = None) -> DataFrame:
    """Latest indicator values of every symbol with enough bars, with the tail
    of closes and OBV that the signal rules look at.  With ``requests`` (symbol, as_of) there is a row for every request."""
    need_columns(bars, ["symbol", "trade_date", "high", "low", "close", "volume"])
    used = bars.select("symbol", "trade_date", "high", "low", "close", "volume")
    if requests is None:
        keys = ["symbol"]
        packed = recent_bars(used, lookback, as_of).groupBy("symbol").agg(
            F.sort_array(F.collect_list(F.struct("trade_date", "high", "low", "close", "volume"))).alias("b"))
    else:
        keys, packed = ["symbol", "as_of"], packed_bars_as_of(used, requests, lookback).withColumnRenamed("bars", "b")
    packed = packed.filter(F.size("b") >= min_bars)
    s = packed.select(
        *keys, F.element_at("b", -1)["trade_date"].alias("as_of_date"), F.size("b").alias("n"),
        F.col("b.high").alias("h"), F.col("b.low").alias("l"), F.col("b.close").alias("c"),
        F.transform("b.volume", lambda v: v.cast("double")).alias("v"),
        F.transform("b", lambda x: (x["high"] + x["low"] + x["close"]) / 3.0).alias("tp"))
    h, low, c, v, tp, n = (F.col(k) for k in ("h", "l", "c", "v", "tp", "n"))
    s = s.withColumns({
        "diff": _steps(n, lambda i: _at(c, i) - _at(c, i - 1)),
        "moves": _steps(n, lambda i: F.struct(
            F.greatest(_at(h, i) - _at(low, i), F.abs(_at(h, i) - _at(c, i - 1)),
                       F.abs(_at(low, i) - _at(c, i - 1))).alias("tr"),
            F.when((_at(h, i) - _at(h, i - 1) > _at(low, i - 1) - _at(low, i)) & (_at(h, i) > _at(h, i - 1)),
                   _at(h, i) - _at(h, i - 1)).otherwise(0.0).alias("up"),
            F.when((_at(low, i - 1) - _at(low, i) > _at(h, i) - _at(h, i - 1)) & (_at(low, i - 1) > _at(low, i)),
                   _at(low, i - 1) - _at(low, i)).otherwise(0.0).alias("down"))),
        "slopes": _slopes(h, low, n)})
    signed = F.zip_with(F.col("diff"), _rest(v, 1), lambda d, x: F.signum(d) * x)
    flows = F.transform(F.sequence(n - 13, n), lambda i: F.struct(
        (_at(tp, i) - _at(tp, i - 1)).alias("d"), (_at(tp, i) * _at(v, i)).alias("f")))
    s = s.withColumns({
        "obvs": F.aggregate(signed, F.array(F.lit(0.0)),
                            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))),
        "flows": flows, "m": _macd(c), "x": _adx(F.col("moves")), "kd": _kdj(h, low, c, n),
        "mid": _mean(c, 20), "tpm": _mean(tp, 20), "bm": _mean(F.col("slopes"), 60), "vm": _mean(v, 20),
        "top14": F.array_max(_last(h, 14)), "low14": F.array_min(_last(low, 14))})
    s = s.withColumns({
        "sd": _deviation(c, F.col("mid"), 20), "bsd": _deviation(F.col("slopes"), F.col("bm"), 60),
        "md": F.aggregate(_last(tp, 20), F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tpm"))) / 20})
    flow = lambda test: F.aggregate(F.filter("flows", test), F.lit(0.0), lambda a, f: a + f["f"])
    close, beta = F.element_at(c, -1), F.element_at("slopes", -1)
    width, before = F.col("top14") - F.col("low14"), F.slice(c, n - 20, F.lit(20))
    mid, sd, kd = F.col("mid"), F.col("sd"), F.col("kd")
    safe = lambda top, bottom, otherwise: F.when(F.abs(bottom) <= EPS, otherwise).otherwise(
        top / F.nullif(bottom, F.lit(0.0)))
    return s.select(
        *keys, "as_of_date", n.cast("bigint").alias("bar_count"), close.alias("close"),
        _ema_last(c, 10).alias("ema_10"), _mean(c, 50).alias("sma_50"), _mean(c, 200).alias("sma_200"),
        F.col("x.adx").alias("adx_14"), F.col("x.plus").alias("plus_di_14"), F.col("x.minus").alias("minus_di_14"),
        F.element_at("obvs", -1).alias("obv"), F.col("vm").alias("volume_sma_20"),
        safe(F.element_at(v, -1), F.col("vm"), 0.0).alias("volume_ratio_20"),
        _money_flow(flow(lambda f: f["d"] > 0), flow(lambda f: f["d"] < 0)).alias("mfi_14"),
        safe(F.element_at(tp, -1) - F.col("tpm"), 0.015 * F.col("md"), 0.0).alias("cci_20"),
        safe((F.col("top14") - close) * -100.0, width, -50.0).alias("williams_r_14"),
        safe(4.0 * sd, F.abs(mid), 0.0).alias("boll_width_ratio_20"),
        (F.col("m.f") - F.col("m.s")).alias("macd"), F.col("m.g").alias("macd_signal"),
        (F.col("m.f") - F.col("m.s") - F.col("m.g")).alias("macd_histogram"), _rsi(F.col("diff")).alias("rsi_14"),
        kd["k"].alias("k_9"), kd["d"].alias("d_9"), (3.0 * kd["k"] - 2.0 * kd["d"]).alias("j_9"),
        beta.alias("rsrs_beta_18"), safe(beta - F.col("bm"), F.col("bsd"), 0.0).alias("rsrs_zscore_18_60"),
        (mid + 2.0 * sd).alias("boll_upper"), mid.alias("boll_middle"), (mid - 2.0 * sd).alias("boll_lower"),
        F.array_min(before).alias("support_level_20"), F.array_max(before).alias("resistance_level_20"),
        _wilder(F.transform("moves", lambda m: m["tr"]), 14).alias("atr_14"),
        _last(c, TAIL).alias("closes"), _last(F.col("obvs"), TAIL).alias("obv_tail"))


@operator("short_histories")
def short_histories(bars: DataFrame, as_of: str | None = None, min_bars: int = MIN_BARS) -> DataFrame:
    """Symbols that do not have enough bars for a snapshot."""
    rows = bars.filter(F.col("trade_date") <= F.lit(as_of).cast("date")) if as_of else bars
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bar_count")).filter(F.col("bar_count") < min_bars)


# ---- series on every date ----

# Names of the indicator series.
INDICATORS = ("close_50_sma", "close_200_sma", "close_10_ema", "macd", "macds", "macdh", "rsi", "boll", "boll_ub",
              "boll_lb", "atr", "vwma", "mfi")
_FOLDED = ("close_10_ema", "macd", "macds", "macdh", "rsi", "atr")


# Rows of a scanned block; rows that rolling windows need from the block before.
SCAN_ROWS, CONTEXT = 512, 200


def _decayed(k: int, macd: tuple[float, float, float] = (2 / 13, 2 / 27, 2 / 10)) -> dict[str, tuple[float, Column]]:
    """Running values x = decay * x + input from x = 0: their decays and inputs at row ``i``, with Wilder period ``k``.

    An exponential mean starts at its first value.  A Wilder mean is the plain mean of its first k values at row k + 1; their inputs are
    scaled up so that the decay leaves just that.  The signal line, a mean of the difference of two means, needs the inputs of both under its own decay.
    """
    first, close = F.col("i") == 1, F.col("close").cast("double")
    mean = lambda a: F.when(first, close).otherwise(a * close)
    fast, slow, signal = macd
    keep = 1 - 1 / k
    early = F.when(F.col("i") <= k + 1, F.pow(F.lit(1 / keep), F.lit(k + 1) - F.col("i"))).otherwise(1.0) / k
    wilder = lambda v: F.when(first, 0.0).otherwise(v * early)
    return {"e10": (1 - 2 / 11, mean(2 / 11)), "fast": (1 - fast, mean(fast)), "slow": (1 - slow, mean(slow)),
            "fast9": (1 - signal, mean(fast)), "slow9": (1 - signal, mean(slow)),
            "gain": (keep, wilder(F.greatest(F.col("move"), F.lit(0.0)))), "loss": (keep, wilder(F.greatest(-F.col("move"), F.lit(0.0)))),
            "range": (keep, wilder(F.col("true_range")))}


def _scanned(rows: DataFrame, series: dict[str, tuple[float, Column]], scan_rows: int) -> DataFrame:
    """The rows (symbol, i, ...) with the running values of the series.

    Each block of rows is summed with weights decay ** -place, which composes its affine maps.  Blocks then hand on their end values:
    the value before a block is made of the ends of as many blocks before it as matter, which are all full; what lies before these
    would be multiplied by less than 2 ** -60.
    """
    place = F.pmod(F.col("i") - 1, F.lit(scan_rows)).cast("double")
    blocked = rows.withColumn("__b", F.floor((F.col("i") - 1) / scan_rows))
    inside = Window.partitionBy("symbol", "__b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[(F.pow(F.lit(a), place) * F.sum(b * F.pow(F.lit(a), -place)).over(inside)).alias(f"__{n}")
                                  for n, (a, b) in series.items()])
    ends = local.groupBy("symbol", "__b").agg(F.max_by(F.struct(*[f"__{n}" for n in series]), "i").alias("end"))
    order = Window.partitionBy("symbol").orderBy("__b")

    def before(name: str, decay: float) -> Column:
        depth = max(1, math.ceil(60 * math.log(2) / (-math.log(decay) * scan_rows)))
        return sum(F.coalesce(F.lag(f"end.__{name}", d).over(order), F.lit(0.0)) * decay ** (scan_rows * (d - 1)) for d in range(1, depth + 1))

    carried = ends.select("symbol", "__b", *[before(n, a).alias(f"__{n}_before") for n, (a, _) in series.items()])
    joined = local.join(carried, ["symbol", "__b"])
    return joined.select(*rows.columns, *[(F.col(f"__{n}") + F.pow(F.lit(a), place + 1) * F.col(f"__{n}_before")).alias(n) for n, (a, _) in series.items()])


def _folded(rows: DataFrame, scan_rows: int) -> DataFrame:
    """Recursive indicators of the rows (symbol, trade_date, i, close, move, true_range)."""
    fast, slow, signal = 2 / 13, 2 / 27, 2 / 10
    x = _scanned(rows, _decayed(14), scan_rows)
    macd = F.col("fast") - F.col("slow")
    # decays p and q: the q-sum of a running p-sum is (p * p-sum - q * q-sum of its inputs) / (p - q)
    nested = lambda name, p, q: (p * F.col(name) - q * F.col(f"{name}9")) / (p - q)
    macds = signal * (nested("fast", 1 - fast, 1 - signal) - nested("slow", 1 - slow, 1 - signal))
    rsi = F.when(F.col("loss") <= EPS, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0))))
    full = lambda c: F.when(F.col("i") >= 15, c)
    return x.select("symbol", "trade_date", F.col("e10").alias("close_10_ema"), macd.alias("macd"), macds.alias("macds"), (macd - macds).alias("macdh"),
                    full(rsi).alias("rsi"), full(F.col("range")).alias("atr"))


@operator("indicator_series")
def indicator_series(bars: DataFrame, names: list[str] | None = None, block_rows: int | None = None, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Named indicators on every date of every symbol; null until a window is full.

    Rolling ones are Spark windows, recursive ones a scan over blocks of rows.  A symbol is one window group; with ``block_rows`` its bars
    are numbered chunk by chunk and spread over tasks in blocks of so many rows, each with the rows before it that its windows need.
    """
    names = list(names or INDICATORS)
    unknown = [n for n in names if n not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicator {unknown[0]!r}")
    need_columns(bars, ["symbol", "trade_date", "high", "low", "close", "volume"])
    if block_rows is not None and block_rows < CONTEXT:
        raise ValueError(f"block_rows must be at least {CONTEXT}")
    rows = bars.select("symbol", "trade_date", "high", "low", "close", "volume")
    if block_rows:
        numbered = number_rows(rows, ["symbol"], ["trade_date"], "i", block_rows).withColumn("__own", F.floor((F.col("i") - 1) / block_rows))
        late = F.pmod(F.col("i") - 1, F.lit(block_rows)) >= block_rows - CONTEXT
        rows = numbered.withColumn("__k", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
        w = Window.partitionBy("symbol", "__k").orderBy("i")
    else:
        w = Window.partitionBy("symbol").orderBy("trade_date")
        rows = rows.withColumns({"i": F.row_number().over(w).cast("bigint"), "__own": F.lit(0), "__k": F.lit(0)})
    before = F.lag("close").over(w)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    rows = rows.withColumns({"tp": tp, "move": F.col("close") - before,
                             "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    rows = rows.withColumn("step", F.col("tp") - F.lag("tp").over(w))
    roll = lambda k: w.rowsBetween(-(k - 1), 0)
    full = lambda k, value: F.when(F.col("i") >= k, value)
    mid, sd = F.avg("close").over(roll(20)), F.stddev_pop("close").over(roll(20))
    flow = lambda test: F.coalesce(F.sum(F.when(test, F.col("tp") * F.col("volume"))).over(roll(14)), F.lit(0.0))
    made = {"close_50_sma": full(50, F.avg("close").over(roll(50))),
            "close_200_sma": full(200, F.avg("close").over(roll(200))),
            "boll": full(20, mid), "boll_ub": full(20, mid + 2 * sd), "boll_lb": full(20, mid - 2 * sd),
            "vwma": full(14, F.sum(F.col("tp") * F.col("volume")).over(roll(14))
                         / F.nullif(F.sum("volume").over(roll(14)), F.lit(0))),
            "mfi": full(15, _money_flow(flow(F.col("step") > 0), flow(F.col("step") < 0)))}
    rolling, folded = [n for n in names if n in made], [n for n in names if n in _FOLDED]
    out = (rows.select("symbol", "trade_date", "i", "close", "move", "true_range", "__own", "__k", *[made[n].alias(n) for n in rolling])
           .filter("__own = __k"))
    if folded:
        x = _folded(out.select("symbol", "trade_date", "i", "close", "move", "true_range"), scan_rows)
        out = x.select("symbol", "trade_date", *folded) if not rolling else out.join(x.select("symbol", "trade_date", *folded), ["symbol", "trade_date"])
    return out.select("symbol", "trade_date", *names)
