"""Disclosure records: ingest, identity, storage order and exchange payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.values import strip
from loomtable.operators.reconcile import plain_title
from loomtable.registry import operator
from loomtable.sources.prices import upsert_bars

ZONE = "Asia/Shanghai"
# Site addresses that complete relative links.
STATIC_HOST = "https://static.cninfo.com.cn"
DETAIL_HOST = "https://www.cninfo.com.cn/new"
EXCHANGE_HOST = "https://www.sse.com.cn"
# Title words of each category, first match wins.
CATEGORIES = (("annual_report", ("年度报告",)), ("interim_report", ("半年度报告",)),
              ("quarterly_report", ("第一季度报告", "第三季度报告")),
              ("earnings_preannouncement", ("业绩预告", "业绩快报")), ("board_meeting", ("董事会",)),
              ("shareholder_meeting", ("股东大会",)), ("suspension_resume", ("停牌", "复牌")),
              ("buyback", ("回购",)), ("dividend", ("分红", "利润分配")),
              ("material_contract", ("重大合同",)), ("mna_restructuring", ("重组", "收购", "并购")))
# Media type of a file ending.
MEDIA_TYPES = {
    "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "csv": "text/csv"}
# Names of a market and the ticker ending and width they mean.
MARKETS = ((("CN-SH", "SH", "SSE", "CN-A-SH"), "SH", 6), (("CN-SZ", "SZ", "SZSE", "CN-A-SZ"), "SZ", 6),
           (("CN-BJ", "BJ", "BSE", "CN-A-BJ"), "BJ", 6), (("HK", "HKEX", "HK-SEHK"), "HK", 4))


def _padded(code: Column, width: int) -> Column:
    return F.when(F.length(code) >= width, code).otherwise(F.lpad(code, width, "0"))


def _compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z.]", ""))


def normalize_ticker(market: Column, raw: Column) -> Column:
    """``600000`` on SH -> ``600000.SH``; null when the market is not known."""
    t, m = _compact(raw), F.upper(strip(market))
    code = F.regexp_replace(t, r"\.(SH|SZ|HK|BJ)$", "")
    own = F.regexp_extract(t, r"\.(SH|SZ|HK|BJ)$", 1)
    out = F.when(own == "HK", F.concat(_padded(code, 4), F.lit(".HK"))).when(
        own != "", F.concat(_padded(code, 6), F.lit("."), own))
    for names, ending, width in MARKETS:
        out = out.when((t != "") & m.isin(*names), F.concat(_padded(t, width), F.lit(f".{ending}")))
    return out


def market_route(ticker: Column) -> Column:
    """Struct(market, exchange, ticker, verifier) from the ending, else the first digit."""
    t = _compact(ticker)
    ending = F.regexp_extract(t, r"\.([^.]*)$", 1)
    code = F.regexp_replace(t, r"\.[^.]*$", "")
    route = lambda market, exchange, name, check: F.struct(
        F.lit(market).alias("market"), F.lit(exchange).alias("exchange"), name.alias("ticker"),
        F.lit(check).cast("string").alias("verifier"))
    return (F.when(ending == "SH", route("CN-SH", "SSE", t, "sse"))
            .when(ending == "SZ", route("CN-SZ", "SZSE", t, None))
            .when(ending == "BJ", route("CN-BJ", "BSE", t, None))
            .when(ending == "HK", route("HK", "HKEX", t, None))
            .when(code.rlike("^[48]"), route("CN-BJ", "BSE", code, None))
            .when(code.rlike("^[0123]"), route("CN-SZ", "SZSE", code, None))
            .when(code.rlike("^[5679]"), route("CN-SH", "SSE", code, "sse")))


def dedupe_key(market: Column, exchange: Column, ticker: Column, title: Column,
               published: Column, url: Column) -> Column:
    """SHA-256 of market, exchange, ticker, title, hour and file name."""
    upper = lambda c: F.upper(strip(F.coalesce(c, F.lit(""))))
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")
    return F.sha2(F.concat_ws("|", upper(market), upper(exchange), upper(ticker), plain_title(title),
                              F.concat(F.substring(published, 1, 10), F.lit("T"), F.substring(published, 12, 2)),
                              F.lower(F.element_at(F.split(path, "/"), -1))), 256)


def category(title: Column) -> Column:
    t, out = strip(F.coalesce(title, F.lit(""))), None
    for name, words in CATEGORIES:
        test = t.contains(words[0])
        for w in words[1:]:
            test |= t.contains(w)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other_disclosure")


def _https(c: Column, host: str) -> Column:
    t = strip(c)
    return (F.when(t.isNull() | (t == ""), None)
            .when(t.startswith("http://"), F.regexp_replace(t, "^http://", "https://"))
            .when(t.startswith("https://"), t)
            .otherwise(F.concat(F.lit(host + "/"), F.ltrim(F.regexp_replace(t, "^/+", "")))))


@operator("build_disclosures")
def build_disclosures(landed: DataFrame) -> DataFrame:
    """Landed announcement rows -> disclosure events.

    Input columns: announcement_id, announcement_time (epoch ms), market,
    exchange, sec_code, sec_name, org_id, title, file_url, adjunct_type, content.
    """
    need_columns(landed, ["announcement_id", "announcement_time", "market", "exchange", "sec_code",
                          "sec_name", "org_id", "title", "file_url", "adjunct_type", "content"])
    # wall-clock text in the home zone, whatever the zone of the session
    ms, day = F.col("announcement_time"), F.lit(86_400_000)
    utc = F.timestamp_add("SECOND", F.floor(F.pmod(ms, day) / 1000).cast("int"),
                          F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / day).cast("int")).cast("timestamp_ntz"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc).cast("string")
    rows = landed.withColumns({
        "document_date": F.substring(local, 1, 10),
        "published_at": F.concat(F.substring(local, 1, 10), F.lit("T"), F.substring(local, 12, 8), F.lit("+08:00")),
        "ticker_normalized": normalize_ticker(F.col("market"), F.col("sec_code")),
        "document_url": _https(F.col("file_url"), STATIC_HOST),
        "title": strip(F.coalesce("title", F.lit("")))})
    name = F.element_at(F.split("document_url", "/"), -1)
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    ending = F.lower(F.regexp_extract(F.col("document_url"), r"\.([^./]+)$", 1))
    attachment = F.struct(name.alias("name"), F.col("document_url").alias("url"),
                          F.try_element_at(media, ending).alias("media_type"))
    none = F.array().cast("array<struct<name:string,url:string,media_type:string>>")
    return rows.select(
        F.concat(F.lit("cninfo-"), F.col("announcement_id").cast("string")).alias("event_id"),
        F.lit("CN-A").alias("market"), "exchange", F.col("sec_code").alias("ticker_raw"), "ticker_normalized",
        F.col("sec_name").alias("issuer_name"), "title", category(F.col("title")).alias("category"),
        "published_at", "document_date", F.lit("zh-CN").alias("language"), F.lit("cninfo").alias("source_name"),
        F.concat(F.lit(f"{DETAIL_HOST}/disclosure/detail?orgId="), F.col("org_id"), F.lit("&announcementId="),
                 F.col("announcement_id").cast("string"), F.lit("&announcementTime="),
                 F.col("document_date")).alias("source_url"),
        "document_url", F.lower(F.coalesce("adjunct_type", F.lit("pdf"))).alias("document_type"),
        F.col("content").alias("content_text"),
        dedupe_key(F.lit("CN-A"), F.col("exchange"), F.col("ticker_normalized"), F.col("title"),
                   F.col("published_at"), F.col("document_url")).alias("dedupe_key"),
        F.when(F.col("document_url").isNotNull(), F.array(attachment)).otherwise(none).alias("attachments"))


@operator("upsert_events")
def upsert_events(batches: list[DataFrame]) -> DataFrame:
    """The latest batch that has an ``event_id`` wins."""
    return upsert_bars(batches, ["event_id"])


@operator("events_in_range")
def events_in_range(events: DataFrame, start: str, end: str, tickers: list[str] | None = None) -> DataFrame:
    rows = events.filter(F.col("document_date").between(start, end))
    if tickers is not None:
        rows = rows.filter(F.col("ticker_normalized").isin(*tickers))
    return rows.orderBy(F.desc("document_date"), F.desc("event_id"))


# ---- exchange bulletins ----

def unwrap_jsonp(c: Column) -> Column:
    """``callback({...})`` -> the JSON inside; null when it has no such shape."""
    rx = r"(?s)^[^(]+\((.*)\)\s*$"
    return F.when(c.rlike(rx), F.regexp_extract(c, rx, 1))


@operator("exchange_bulletins")
def exchange_bulletins(landed: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """JSONP payloads whose ``result`` holds rows, or lists of rows."""
    need_columns(landed, [payload, *(keep or [])])
    row = ("struct<SECURITY_CODE:string,SECURITY_NAME:string,TITLE:string,SSEDATE:string,URL:string,"
           "ORG_BULLETIN_ID:string,BULLETIN_TYPE_DESC:string>")
    items = F.from_json(unwrap_jsonp(F.col(payload)), "struct<result:array<string>>")["result"]
    rows = F.flatten(F.transform(items, lambda s: F.when(
        strip(s).startswith("["), F.from_json(s, f"array<{row}>")).otherwise(F.array(F.from_json(s, row)))))
    flat = landed.select(*(keep or []), F.explode(rows).alias("r"))
    text = lambda name: strip(F.coalesce(F.col(f"r.{name}"), F.lit("")))
    link = text("URL")
    return flat.select(
        *(keep or []), F.coalesce("r.ORG_BULLETIN_ID", F.lit("")).alias("bulletin_id"),
        text("SECURITY_CODE").alias("ticker_raw"),
        normalize_ticker(F.lit("CN-SH"), text("SECURITY_CODE")).alias("ticker_normalized"),
        text("SECURITY_NAME").alias("issuer_name"), text("TITLE").alias("title"),
        text("SSEDATE").alias("document_date"),
        F.when(link.rlike("^https?://"), link)
        .otherwise(F.concat(F.lit(EXCHANGE_HOST + "/"), F.regexp_replace(link, "^/+", ""))).alias("document_url"),
        F.when(text("BULLETIN_TYPE_DESC") != "", text("BULLETIN_TYPE_DESC")).alias("bulletin_type"))
