"""Disclosure ingest, identity, upserts, exchange payloads and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.plans.suite.base import Tables, query
from loomtable.sources.disclosures import (build_disclosures, events_in_range, exchange_bulletins, market_route,
                                           upsert_events)
from loomtable.sources.news import distinct_news, news_in_range, parse_articles

WORDS = ("年度报告", "半年度报告", "第一季度报告", "业绩预告", "董事会决议", "股东大会通知", "停牌公告", "回购进展", "利润分配",
         "重大合同", "收购资产", "其他公告")
_KINDS = ("annual_report", "annual_report", "quarterly_report", "earnings_preannouncement", "board_meeting",
          "shareholder_meeting", "suspension_resume", "buyback", "dividend", "material_contract", "mna_restructuring",
          "other_disclosure")
_TEXTS = "['" + "', '".join(WORDS) + "']"
_CATEGORIES = "['" + "', '".join(_KINDS) + "']"


def _landed(spark, sf):
    """One announcement per document, every five minutes from the end of 2023."""
    d = Tables(spark, sf).documents
    k = F.col("doc_id")
    market = F.element_at(F.array(*[F.lit(m) for m in ("CN-SH", "SZ", "BSE", "HKEX")]), (k % 4 + 1).cast("int"))
    words = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % 12 + 1).cast("int"))
    url = (F.when(k % 5 == 0, F.concat(F.lit("http://static.example.com/a/"), k.cast("string"), F.lit(".PDF")))
           .when(k % 5 == 1, F.concat(F.lit("/final/"), k.cast("string"), F.lit(".docx?x=1")))
           .when(k % 5 == 2, F.concat(F.lit("https://static.example.com/"), k.cast("string"), F.lit(".csv"))))
    return d.select(k.alias("announcement_id"), (F.lit(1704036000000) + k * 300000).alias("announcement_time"),
                    market.alias("market"), F.concat(F.lit("X"), (k % 3).cast("string")).alias("exchange"),
                    (k % 997).cast("string").alias("sec_code"), F.col("source").alias("sec_name"),
                    F.lit("org1").alias("org_id"),
                    F.concat(F.lit("  "), F.col("source"), F.lit("  关于 "), words, F.lit(" ")).alias("title"),
                    url.alias("file_url"), F.when(k % 2 == 0, "PDF").alias("adjunct_type"), F.col("text").alias("content"))


_EVENTS_SQL = f"""
    WITH b AS (SELECT doc_id AS k, source, text, TIMESTAMP '1970-01-01 08:00:00' + to_milliseconds(1704036000000 + doc_id * 300000) AS t,
                      source || '  关于 ' || ({_TEXTS})[(doc_id % 12 + 1)::INTEGER] AS title,
                      ({_CATEGORIES})[(doc_id % 12 + 1)::INTEGER] AS category,
                      CASE doc_id % 4 WHEN 0 THEN printf('%06d', doc_id % 997) || '.SH' WHEN 1 THEN printf('%06d', doc_id % 997) || '.SZ'
                           WHEN 2 THEN printf('%06d', doc_id % 997) || '.BJ' ELSE printf('%04d', doc_id % 997) || '.HK' END AS ticker,
                      CASE doc_id % 5 WHEN 0 THEN 'https://static.example.com/a/' || doc_id || '.PDF'
                           WHEN 1 THEN 'https://static.cninfo.com.cn/final/' || doc_id || '.docx?x=1'
                           WHEN 2 THEN 'https://static.example.com/' || doc_id || '.csv' END AS url FROM documents),
         e AS (SELECT 'cninfo-' || k AS event_id, 'X' || k % 3 AS exchange, ticker AS ticker_normalized, title, category,
                      strftime(t, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS published_at, strftime(t, '%Y-%m-%d') AS document_date,
                      url AS document_url, 'pdf' AS document_type,
                      'https://www.cninfo.com.cn/new/disclosure/detail?orgId=org1&announcementId=' || k
                      || '&announcementTime=' || strftime(t, '%Y-%m-%d') AS source_url, md5(text) AS content_md5,
                      sha256('CN-A|X' || k % 3 || '|' || ticker || '|' || lower(replace(title, '  ', ' ')) || '|'
                             || strftime(t, '%Y-%m-%dT%H') || '|' || CASE k % 5 WHEN 0 THEN k || '.pdf' WHEN 1 THEN k || '.docx'
                             WHEN 2 THEN k || '.csv' ELSE '' END) AS dedupe_key,
                      CASE k % 5 WHEN 0 THEN k || '.PDF application/pdf' WHEN 1 THEN k || '.docx?x=1'
                           WHEN 2 THEN k || '.csv text/csv' ELSE '' END AS attachment FROM b)"""
_COLUMNS = ("event_id, exchange, ticker_normalized, title, category, published_at, document_date, document_url, "
            "document_type, source_url, content_md5, dedupe_key, attachment")


def _events(spark, sf):
    out = build_disclosures(_landed(spark, sf))
    attachment = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["name"], a["media_type"])), ",")
    return out.withColumns({"content_md5": F.md5("content_text"), "attachment": attachment})


@query("disclosure_events", _EVENTS_SQL + f" SELECT {_COLUMNS} FROM e")
def events(spark, sf):
    return _events(spark, sf).select(*_COLUMNS.split(", "))


@query("upserted_events", _EVENTS_SQL + """
    SELECT event_id, CASE WHEN contains(title, '回购') THEN title || ' (2)' ELSE title END AS title FROM e""")
def upserted(spark, sf):
    e = _events(spark, sf).select("event_id", "title")
    changed = e.filter(F.col("title").contains("回购")).withColumn("title", F.concat("title", F.lit(" (2)")))
    return upsert_events([e, changed])


@query("events_in_range", _EVENTS_SQL + """
    SELECT event_id, ticker_normalized, document_date FROM e WHERE document_date BETWEEN '2024-01-01' AND '2024-01-02'
    ORDER BY document_date DESC, event_id DESC""")
def range_of_events(spark, sf):
    return events_in_range(_events(spark, sf), "2024-01-01", "2024-01-02").select(
        "event_id", "ticker_normalized", "document_date")


@query("market_routes", """
    SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'CN-SH' WHEN doc_id % 6 = 1 THEN 'HK'
        WHEN code[1] IN ('4', '8') THEN 'CN-BJ' WHEN code[1] IN ('0', '1', '2', '3') THEN 'CN-SZ' ELSE 'CN-SH' END AS market,
      CASE WHEN doc_id % 6 = 0 THEN 'SSE' WHEN doc_id % 6 = 1 THEN 'HKEX' WHEN code[1] IN ('4', '8') THEN 'BSE'
        WHEN code[1] IN ('0', '1', '2', '3') THEN 'SZSE' ELSE 'SSE' END AS exchange,
      CASE WHEN doc_id % 6 = 0 THEN code || '.SH' WHEN doc_id % 6 = 1 THEN code || '.HK' ELSE code END AS ticker,
      CASE WHEN doc_id % 6 = 0 OR (doc_id % 6 <> 1 AND code[1] IN ('5', '6', '7', '9')) THEN 'sse' END AS verifier
    FROM (SELECT doc_id, printf('%06d', (doc_id * 7919) % 1000000) AS code FROM documents)""")
def routes(spark, sf):
    k = F.col("doc_id")
    code = F.format_string("%06d", (k * 7919) % 1000000)
    ticker = F.when(k % 6 == 0, F.concat(code, F.lit(".sh"))).when(k % 6 == 1, F.concat(F.lit(" "), code, F.lit(".HK"))).otherwise(code)
    return Tables(spark, sf).documents.select(k, market_route(ticker).alias("r")).select("doc_id", "r.*")


@query("exchange_bulletins", """
    SELECT conv_id, 'B' || turn AS bulletin_id, printf('%d', conv_id % 700) AS ticker_raw,
           printf('%06d.SH', conv_id % 700) AS ticker_normalized, role AS issuer_name, trim(text, chr(10) || ' ') AS title,
           '2024-02-01' AS document_date, CASE WHEN turn % 2 = 0 THEN 'https://www.sse.com.cn/d/' || turn || '.pdf'
                                               ELSE 'https://x.example.com/' || turn END AS document_url,
           CASE WHEN turn % 3 <> 0 THEN 'notice' END AS bulletin_type FROM conversations""")
def bulletins(spark, sf):
    """One payload per conversation; its turns are rows, some inside lists."""
    c = Tables(spark, sf).conversations
    row = F.to_json(F.struct(
        (F.col("conv_id") % 700).cast("string").alias("SECURITY_CODE"), F.col("role").alias("SECURITY_NAME"),
        F.col("text").alias("TITLE"), F.lit("2024-02-01").alias("SSEDATE"),
        F.concat(F.lit("B"), F.col("turn").cast("string")).alias("ORG_BULLETIN_ID"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/d/"), F.col("turn").cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("https://x.example.com/"), F.col("turn").cast("string"))).alias("URL"),
        F.when(F.col("turn") % 3 == 0, " ").otherwise("notice").alias("BULLETIN_TYPE_DESC")))
    item = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), row, F.lit("]"))).otherwise(row)
    packed = c.groupBy("conv_id").agg(F.concat(F.lit('jsonpCallback1({"result":['), F.array_join(F.collect_list(item), ","),
                                               F.lit("]})\n")).alias("payload"))
    return exchange_bulletins(packed, "payload", ["conv_id"])


_NEWS_SQL = """
    WITH n AS (SELECT page_id, 'Title ' || page_id % 40 AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'sum ' || page_id END
                      AS summary, CASE WHEN page_id % 3 = 0 THEN 'Unknown' ELSE 'Wire' END AS publisher,
                      CASE WHEN page_id % 3 = 2 THEN '' ELSE url END AS link,
                      CASE WHEN page_id % 3 = 1 THEN TIMESTAMP '2024-01-01 10:30:00' + to_days((page_id % 60)::INTEGER) END AS pub
               FROM pages)"""
_NEWS_COLUMNS = "page_id, title, summary, publisher, link, strftime(pub, '%Y-%m-%d %H:%M:%S') AS pub_date"


def _news(spark, sf):
    p = Tables(spark, sf).pages
    k = F.col("page_id")
    title = F.concat(F.lit("Title "), (k % 40).cast("string"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd")
    summary = F.concat(F.lit("sum "), k.cast("string"))
    nested = F.to_json(F.struct(F.struct(
        title.alias("title"), summary.alias("summary"), F.struct(F.lit("Wire").alias("displayName")).alias("provider"),
        F.struct(F.col("url").alias("url")).alias("canonicalUrl"),
        F.concat(day, F.lit("T10:30:00Z")).alias("pubDate")).alias("content")))
    bare = F.to_json(F.struct(title.alias("title"), F.col("url").alias("link")))
    flat = F.to_json(F.struct(title.alias("title"), summary.alias("summary"), F.lit("Wire").alias("publisher")))
    payload = F.when(k % 3 == 1, nested).when(k % 3 == 0, bare).otherwise(flat)
    return parse_articles(p.select("page_id", payload.alias("payload")), "payload", ["page_id"])


def _dated(df):
    return df.withColumn("pub_date", F.date_format("pub_date", "yyyy-MM-dd HH:mm:ss"))


@query("news_articles", _NEWS_SQL + f" SELECT {_NEWS_COLUMNS} FROM n")
def articles(spark, sf):
    return _dated(_news(spark, sf))


@query("news_in_range", _NEWS_SQL + f""" SELECT {_NEWS_COLUMNS} FROM n
    WHERE pub IS NULL OR pub BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-21'""")
def recent_articles(spark, sf):
    return _dated(news_in_range(_news(spark, sf), "2024-01-10", "2024-01-20"))


@query("distinct_news", _NEWS_SQL + f""", d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id) AS r FROM n)
    SELECT {_NEWS_COLUMNS} FROM d WHERE r = 1 ORDER BY page_id LIMIT 30""")
def first_articles(spark, sf):
    return _dated(distinct_news(_news(spark, sf), ["page_id"], 30))
