"""Value conventions: blanks, placeholders, numbers, keys, dates, names.

The three notions of "missing" are kept apart on purpose:
null; blank text; placeholder text (profiling only).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtable.functions.checks import NUMERIC_TYPES, dtype_of

# Characters stripped by a text trim (the Unicode white space set).
WHITE_SPACE = ("\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Text that counts as missing in column profiling.
PLACEHOLDER_TEXT = ("N/A", "NA", "null", "NULL")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4,6}[-/][0-9]{1,2}[-/][0-9]{1,2}$"
_TIME = r"^[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$"
_DAY_ZERO = "1970-01-01"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_of(df: DataFrame, name: str) -> Column:
    """A cell as text (the form rules and equality tests work on)."""
    c = F.col(f"`{name}`")
    return c if isinstance(dtype_of(df, name), T.StringType) else c.cast("string")


def is_blank(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(dtype_of(df, name), T.StringType):
        return c.isNull() | (strip(c) == "")
    return c.isNull()


def is_placeholder(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(dtype_of(df, name), T.StringType):
        return c.isNull() | strip(c).isin("", *PLACEHOLDER_TEXT)
    return c.isNull()


def parse_number(c: Column) -> Column:
    """Plain decimal text -> double; anything else -> null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(dtype_of(df, name), NUMERIC_TYPES):
        return c.cast("double")
    return parse_number(text_of(df, name))


def parse_loose_number(c: Column) -> Column:
    """``1,234`` -> 1234.0 and ``83%`` -> 0.83."""
    t = strip(c.cast("string"))
    pct = t.endswith("%")
    v = parse_number(strip(F.regexp_replace(t, "[,%]", "")))
    return F.when(pct, v / 100.0).otherwise(v)


def join_key(df: DataFrame, name: str, match_blank: bool = False) -> Column:
    """Trimmed key text; floating and decimal keys lose zeros after the point, so 1 meets 1.0 and 1.00."""
    c = F.col(f"`{name}`")
    dt = dtype_of(df, name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        t = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif isinstance(dt, T.DecimalType) and dt.scale > 0:
        t = F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    elif isinstance(dt, T.StringType):
        t = strip(c)
    else:
        t = c.cast("string")
    t = F.when(F.lower(t).isin("", "null"), F.lit(None)).otherwise(t)
    return F.coalesce(t, F.lit("")) if match_blank else t


def trimmed_number(c: Column, digits: int) -> Column:
    """Integer when whole, else ``digits`` decimals without trailing zeros."""
    fixed = F.format_string(f"%.{digits}f", c.cast("double"))
    short = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return (F.when(c.isNull(), F.lit(None))
            .when(c == F.floor(c), c.cast("decimal(38,0)").cast("string"))
            .otherwise(short))


def two_decimal_number(c: Column) -> Column:
    """Integer when whole, else exactly two decimals."""
    return (F.when(c.isNull(), F.lit(None))
            .when(c == F.floor(c), c.cast("decimal(38,0)").cast("string"))
            .otherwise(F.format_string("%.2f", c.cast("double"))))


def _calendar_date(t: Column) -> Column:
    return F.when(t.rlike(_DATE), F.replace(t, F.lit("/"), F.lit("-")).try_cast("date"))


def date_from_text(c: Column) -> Column:
    """Date of ``y-m-d`` or ``y/m/d`` text, with or without a time after it."""
    return _calendar_date(F.regexp_replace(strip(c), "(?s)[ T].*$", ""))


def time_from_text(c: Column) -> Column:
    """``h:m`` or ``h:m:s`` text -> that time on day zero, else null."""
    t = strip(c)
    return F.when(t.rlike(_TIME), F.concat(F.lit(_DAY_ZERO + " "), t).try_cast("timestamp_ntz"))


def time_of_day(c: Column) -> Column:
    """Time from the last piece of a time or date-time text, on day zero."""
    return time_from_text(F.regexp_replace(strip(c), "(?s)^.*[ T]", ""))


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss")


def clock_of_seconds(seconds: Column) -> Column:
    return clock(F.timestamp_add("SECOND", seconds, F.lit(_DAY_ZERO).cast("timestamp_ntz")))


def any_date(c: Column) -> Column:
    """The five date texts a date bucket accepts."""
    t = strip(c)
    tail = r"( [0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?|T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$"
    has_tail = t.rlike("-" + "[0-9]{1,2}" + tail)
    clock_text = F.regexp_extract(t, r"[ T]([0-9:]+)$", 1)
    dated = _calendar_date(F.regexp_replace(t, r"[ T][0-9:]+$", ""))
    return (F.when(has_tail & time_from_text(clock_text).isNotNull(), dated)
            .otherwise(_calendar_date(t)))


# Names of the four parts of a day.
DAY_PERIODS = ("凌晨", "上午", "下午", "晚上")


def day_period(hour: Column) -> Column:
    night, morning, afternoon, evening = DAY_PERIODS
    return (F.when(hour <= 5, night).when(hour <= 11, morning)
            .when(hour <= 17, afternoon).otherwise(evening))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


# ---- column-name semantics (driver side, plain strings) ----

# Name parts that mark a column's meaning.
DATE_WORDS = ("日期", "date")
TIME_WORDS = ("时间", "time")
AMOUNT_WORDS = ("金额", "amount", "amt", "price", "fee", "total", "实付", "应收", "收入", "支出")
IDENTIFIER_WORDS = ("编号", "编码", "代码")
IDENTIFIER_TOKENS = ("id", "code", "no")
IDENTIFIER_COMPACT = ("uid", "userid", "orderid", "customerid", "clientid", "memberid")


def _plain_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def looks_like_date_name(name: str) -> bool:
    n = _plain_name(name)
    return any(w in n for w in DATE_WORDS) or n.endswith("day") or "_day" in n


def looks_like_time_name(name: str) -> bool:
    n = _plain_name(name)
    return any(w in n for w in TIME_WORDS) or n.endswith("hour") or "_hour" in n


def looks_like_amount_name(name: str) -> bool:
    return any(w in _plain_name(name) for w in AMOUNT_WORDS)


def looks_like_identifier_name(name: str) -> bool:
    n = _plain_name(name)
    return (any(w in n for w in IDENTIFIER_WORDS)
            or bool(set(n.split("_")) & set(IDENTIFIER_TOKENS))
            or re.sub("[_-]", "", n) in IDENTIFIER_COMPACT)


def resolve_column(columns: list[str], aliases: list[str], explicit: str | None = None) -> str | None:
    """Explicit name, else the first alias met exactly, else a column holding an alias."""
    def plain(name: str) -> str:
        return re.sub("[ _-]", "", name.strip().lower())

    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(plain(c), c)
    for name in ([explicit] if explicit else []) + list(aliases):
        if plain(name) in by_name:
            return by_name[plain(name)]
    return next((c for c in columns if any(plain(a) in plain(c) for a in aliases)), None)
