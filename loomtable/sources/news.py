"""Landed news payloads, nested or flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.operators.ordering import keep_one_per_key
from loomtable.registry import operator

_LINK = "struct<url:string>"
ARTICLE = (f"struct<title:string,summary:string,publisher:string,link:string,content:struct<title:string,"
           f"summary:string,provider:struct<displayName:string>,canonicalUrl:{_LINK},clickThroughUrl:{_LINK},"
           f"pubDate:string>>")


@operator("parse_articles")
def parse_articles(landed: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One article per row: title, summary, publisher, link, pub_date."""
    need_columns(landed, [payload, *(keep or [])])
    rows = landed.select(*(keep or []), F.from_json(F.col(payload), ARTICLE).alias("a"))
    nested = F.col("a.content").isNotNull()
    pick = lambda inner, flat, otherwise: F.coalesce(
        F.when(nested, inner).otherwise(flat), F.lit(otherwise))
    when = F.regexp_replace(F.col("a.content.pubDate"), "Z$", "+00:00")
    # the clock time of the article's own zone is kept, the zone is dropped
    local = F.regexp_replace(when, r"[+-]\d{2}:?\d{2}$", "").try_cast("timestamp_ntz")
    link = F.coalesce("a.content.canonicalUrl", "a.content.clickThroughUrl")["url"]
    return rows.select(
        *(keep or []), pick(F.col("a.content.title"), F.col("a.title"), "No title").alias("title"),
        pick(F.col("a.content.summary"), F.col("a.summary"), "").alias("summary"),
        pick(F.col("a.content.provider.displayName"), F.col("a.publisher"), "Unknown").alias("publisher"),
        pick(link, F.col("a.link"), "").alias("link"), F.when(nested, local).alias("pub_date"))


@operator("news_in_range")
def news_in_range(articles: DataFrame, start: str, end: str) -> DataFrame:
    """From the start to one day past the end; articles without a date stay."""
    low = F.lit(start).cast("timestamp_ntz")
    high = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return articles.filter(F.col("pub_date").isNull() | F.col("pub_date").between(low, high))


@operator("distinct_news")
def distinct_news(articles: DataFrame, order_by: list[str], limit: int | None = None) -> DataFrame:
    """First article of each title in the given order, then at most ``limit``."""
    need_columns(articles, ["title", *order_by])
    order = [F.asc(c) for c in order_by]
    one = keep_one_per_key(articles.filter(F.col("title") != ""), [F.col("title")], order)
    return one.orderBy(*order).limit(limit) if limit else one
