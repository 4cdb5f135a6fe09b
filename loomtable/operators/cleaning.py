"""Text normalisation, date parsing and filling of blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from loomtable.functions.checks import dtype_of, need_columns, need_distinct, need_some
from loomtable.functions.values import (clock, clock_of_seconds, date_from_text, is_blank,
                                        parse_number, strip, text_of, time_of_day)
from loomtable.registry import operator


@operator("normalize_text_columns")
def normalize_text_columns(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Fixed order: trim, collapse white space, lower, upper, remove, replace."""
    need_some(rules, "rule")
    need_columns(df, [r["column"] for r in rules])
    need_distinct([r["column"] for r in rules], "column rule")
    out = {}
    for r in rules:
        c = text_of(df, r["column"])
        if r.get("trim"):
            c = strip(c)
        if r.get("collapse_whitespace"):
            c = F.regexp_replace(strip(c), r"(?U)\s+", " ")
        if r.get("lowercase"):
            c = F.lower(c)
        if r.get("uppercase"):
            c = F.upper(c)
        for piece in r.get("remove_chars", []):
            c = F.replace(c, F.lit(piece), F.lit(""))
        for pair in r.get("replace_pairs", []):
            c = F.replace(c, F.lit(pair["from"]), F.lit(pair["to"]))
        out[r["column"]] = c
    return df.withColumns(out)


@operator("parse_datetime_columns")
def parse_datetime_columns(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Date texts and spreadsheet serial days -> ISO text; anything else is an error.

    The pieces are made in steps of their own, so each is worked out once a row.
    """
    need_some(rules, "rule")
    need_columns(df, [r["column"] for r in rules])
    need_distinct([r["column"] for r in rules], "column rule")
    for r in rules:
        if r["target_type"] not in ("date", "datetime"):
            raise ValueError(f"unknown target type {r['target_type']!r}")
    n = range(len(rules))
    out = df.withColumns({f"__t{i}": strip(text_of(df, rules[i]["column"])) for i in n})
    # the usual form needs no pattern groups, and only what is not a date is tried as a number
    usual = lambda t: F.when((F.length(t) == 10) & t.rlike(r"^\d{4}-\d\d-\d\d$"), t.try_cast("date"))
    out = out.withColumns({f"__d{i}": F.coalesce(usual(F.col(f"__t{i}")), date_from_text(F.col(f"__t{i}"))) for i in n})
    out = out.withColumns({
        **{f"__n{i}": F.when(F.col(f"__d{i}").isNull(), parse_number(F.col(f"__t{i}"))) for i in n},
        **{f"__w{i}": F.regexp_extract(f"__t{i}", r"(?s)^[^\sT]+[\sT](.*)$", 1)
           for i in n if rules[i]["target_type"] == "datetime"}})
    out = out.withColumns({f"__s{i}": F.round((F.col(f"__n{i}") - F.floor(f"__n{i}")) * 86400).cast("int") for i in n})
    final = {}
    for i, r in enumerate(rules):
        t, day, serial, second = (F.col(f"__{k}{i}") for k in "tdns")
        late = second >= 86400
        serial_day = F.when(serial >= 0, F.date_add(
            F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int") + F.when(late, 1).otherwise(0)))
        if r["target_type"] == "date":
            parsed = F.coalesce(day, serial_day).cast("string")
        else:
            tail = F.col(f"__w{i}")
            time = F.when(tail == "", "00:00:00").otherwise(clock(time_of_day(tail)))
            parsed = F.coalesce(
                F.concat(day.cast("string"), F.lit(" "), time),
                F.concat(serial_day.cast("string"), F.lit(" "), clock_of_seconds(F.when(late, 0).otherwise(second))))
        problem = F.raise_error(F.concat(
            F.lit(f"column {r['column']}: not a {r['target_type']}: "), t)).cast("string")
        blank = t.isNull() | (t == "")
        final[r["column"]] = F.when(blank, text_of(df, r["column"])).otherwise(F.coalesce(parsed, problem))
    return out.withColumns(final).select(*df.columns)


@operator("fill_missing_values")
def fill_missing_values(df: DataFrame, rules: list[dict], order_by: list[str] | None = None,
                        block_rows: int | None = None) -> DataFrame:
    """Strategies constant, zero and forward_fill; blank text counts as missing.

    forward_fill follows ``order_by``, which must be a unique order of the rows.
    """
    need_some(rules, "rule")
    need_columns(df, [r["column"] for r in rules])
    need_distinct([r["column"] for r in rules], "column rule")
    out = {}
    for r in rules:
        name, strategy = r["column"], r["strategy"]
        if strategy == "constant" and r.get("value") is None:
            raise ValueError(f"column {name!r}: a constant fill needs a value")
        if strategy in ("constant", "zero"):
            value = r["value"] if strategy == "constant" else 0
            typed = F.lit(value).cast(dtype_of(df, name))
            if isinstance(dtype_of(df, name), T.StringType):
                typed = F.lit(str(value))
            out[name] = F.when(is_blank(df, name), typed).otherwise(F.col(f"`{name}`"))
        elif strategy != "forward_fill":
            raise ValueError(f"unknown strategy {strategy!r}")
    filled = df.withColumns(out) if out else df
    forward = [r["column"] for r in rules if r["strategy"] == "forward_fill"]
    if forward:
        from loomtable.operators.windows import forward_fill
        filled = forward_fill(filled, forward, [], order_by or [], block_rows)
    return filled
