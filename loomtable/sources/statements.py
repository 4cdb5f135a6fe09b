"""Landed statement and announcement payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import parse_number, strip
from loomtable.registry import operator

# Field names of a statement row, first match wins.
PERIOD_FIELDS = ("REPORT_DATE", "REPORTDATE", "REPORT_DATE_NAME", "date")
NOTICE_FIELDS = ("NOTICE_DATE", "NOTICEDATE", "latestNoticeDate")
NUMBER_FIELDS = {
    "revenue": ("TOTAL_OPERATE_INCOME", "TOTALOPERATEINCOME", "营业总收入", "yyzsr"),
    "revenue_yoy_pct": ("YSTZ", "YYZSR_GTHR", "营业总收入同比"),
    "net_profit": ("PARENT_NETPROFIT", "PARENTNETPROFIT", "归母净利润", "gsjlr"),
    "net_profit_yoy_pct": ("SJLTZ", "NETPROFIT_GTHR", "归母净利润同比"),
    "roe_pct": ("ROEJQ", "ROE_WEIGHTED", "jqjzcsyl")}


def _first_text(row: Column, fields) -> Column:
    texts = [strip(F.try_element_at(row, F.lit(f))) for f in fields]
    return F.coalesce(*[F.when(t != "", t) for t in texts])


@operator("latest_statement")
def latest_statement(landed: DataFrame, key: str = "symbol", payload: str = "payload") -> DataFrame:
    """First row of each payload (an array, or ``data`` inside an object)."""
    need_columns(landed, [key, payload])
    row = "map<string,string>"
    plain = F.from_json(F.col(payload), f"array<{row}>")
    wrapped = F.from_json(F.col(payload), f"struct<data:array<{row}>>")["data"]
    starts = F.substring(strip(F.col(payload)), 1, 1)
    first = F.get(F.when(starts == "[", plain).otherwise(wrapped), F.lit(0))
    rows = landed.select(key, first.alias("row"))
    # the first field that is present decides, even when its text is no number
    number = lambda fields: parse_number(strip(F.regexp_replace(
        F.coalesce(*[F.try_element_at(F.col("row"), F.lit(f)) for f in fields]), ",", "")))
    return rows.select(
        key, F.when(F.col("row").isNotNull(), "available").otherwise("unavailable").alias("statement_status"),
        F.substring(_first_text(F.col("row"), PERIOD_FIELDS), 1, 10).alias("report_period"),
        F.substring(_first_text(F.col("row"), NOTICE_FIELDS), 1, 10).alias("notice_date"),
        *[number(fields).alias(name) for name, fields in NUMBER_FIELDS.items()])


@operator("announcements")
def announcements(landed: DataFrame, key: str = "symbol", payload: str = "payload", limit: int = 8) -> DataFrame:
    """The first announcements of each payload, blank titles left out."""
    need_columns(landed, [key, payload])
    doc = F.from_json(F.col(payload), "struct<data:struct<list:array<struct<notice_date:string,title:string,"
                                      "art_code:string,columns:array<struct<column_name:string>>>>>>")
    kept = F.filter(doc["data"]["list"], lambda a: F.coalesce(strip(a["title"]) != "", F.lit(False)))
    rows = landed.select(key, F.posexplode(F.slice(kept, 1, limit)).alias("position", "a"))
    return rows.select(
        key, F.col("position").cast("bigint").alias("position"),
        F.substring("a.notice_date", 1, 10).alias("published_at"), strip(F.col("a.title")).alias("title"),
        F.col("a.art_code").alias("article_code"),
        F.get("a.columns", F.lit(0))["column_name"].alias("category"))
