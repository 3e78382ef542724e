"""Articles from landed feeds: RSS and Atom, JSON of several kinds, registered adapters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.functions.html import plain_text as plain
from presswell.functions.text import strip
from presswell.functions.urls import allowed_url

RSS_ITEM = "struct<title:string,link:string,guid:string,pubDate:string,date:string,description:string,encoded:string>"
RSS = f"struct<channel:struct<item:array<{RSS_ITEM}>>,item:array<{RSS_ITEM}>>"
ATOM_TEXT = "struct<_VALUE:string,_type:string>"
ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,created:string,summary:string,content:string>>>"
WORDPRESS = "array<struct<title:struct<rendered:string>,excerpt:struct<rendered:string>,link:string,date:string,date_gmt:string>>"
PRESSCORNER = "struct<docuLanguageListResources:array<struct<title:string,refCode:string,leadText:string,eventDate:string>>>"
SITECORE = "struct<source_url:string,scope:array<string>,articles:array<struct<template:string,areas:array<string>,path:string,title:string,summary:string,date:string>>>"
PRESSCORNER_URL = "https://ec.europa.eu/commission/presscorner/detail/en/"
COLUMNS = ("source_id", "pos", "title", "url", "summary", "raw_date", "date_source", "date_confidence", "fetched_via")


@F.pandas_udf(T.StringType())
def plain_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: plain(v) if v else "")


def text_of(c: Column) -> Column:
    """Plain text; only values with markup or entities reach Python."""
    return F.when(c.rlike("[<&]"), plain_text(c)).otherwise(strip(F.coalesce(c, F.lit(""))))


def looks_like_json(body: Column) -> Column:
    return F.left(body, F.lit(100)).rlike(r"^\s*[{\[]")


def _rows(items: DataFrame, kind: str, via: str) -> DataFrame:
    out = items.withColumns({"url": strip(F.col("url")), "title": text_of(F.col("title")), "summary": text_of(F.col("summary")), "date_source": F.lit(kind), "date_confidence": F.lit("high"), "fetched_via": F.concat(F.lit(f"{via}:"), F.col("page"))})
    return out.filter((F.col("title") != "") & (F.coalesce("url", F.lit("")) != "")).select(*COLUMNS)


def rss(payloads: DataFrame) -> DataFrame:
    """Items of landed RSS and Atom feeds (source_id, url, body); a body that is no XML gives no rows.

    The date is that of publication, else the update, else the creation; the summary the description, else the content.
    """
    clean = F.regexp_replace("body", r"(?s)<!DOCTYPE.*?>|<\?xml.*?\?>", "")
    # prefixes would need namespaces of their own; the local names are enough
    clean = F.regexp_replace(clean, r"<(/?)(?:dc|content|atom|media):", "<$1")
    base = payloads.filter(~F.coalesce(looks_like_json(F.col("body")), F.lit(True))).select("source_id", F.col("url").alias("page"), clean.alias("x"))
    is_atom = F.col("x").rlike(r"^\s*<feed[\s>]")
    options = {"mode": "PERMISSIVE", "rowTag": "x"}
    r = base.filter(~is_atom).withColumn("f", F.from_xml("x", RSS, options)).select("source_id", "page", F.posexplode(F.coalesce("f.channel.item", "f.item")).alias("pos", "i"))
    r = r.select("source_id", "page", "pos", F.col("i.title").alias("title"), F.trim(F.coalesce("i.link", "i.guid")).alias("url"), F.coalesce("i.description", "i.encoded").alias("summary"), F.coalesce("i.pubDate", "i.date").alias("raw_date"))
    a = base.filter(is_atom).withColumn("f", F.from_xml("x", ATOM, options)).select("source_id", "page", F.posexplode("f.entry").alias("pos", "e"))
    link = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    a = a.select("source_id", "page", "pos", F.col("e.title").alias("title"), F.get(link, 0)["_href"].alias("url"), F.coalesce("e.summary", "e.content").alias("summary"), F.coalesce("e.published", "e.updated", "e.created").alias("raw_date"))
    return _rows(r.unionByName(a), "feed-published", "feed")


def _json(payloads: DataFrame) -> DataFrame:
    return payloads.filter(looks_like_json(F.col("body"))).withColumnRenamed("url", "page")


def wordpress(payloads: DataFrame) -> DataFrame:
    """Posts of landed WordPress lists; the GMT date, where there is one, is UTC."""
    p = _json(payloads).select("source_id", "page", F.posexplode(F.from_json("body", WORDPRESS)).alias("pos", "p"))
    utc = F.when(F.coalesce("p.date_gmt", F.lit("")) != "", F.concat(F.col("p.date_gmt"), F.lit("Z"))).otherwise(F.col("p.date"))
    return _rows(p.select("source_id", "page", "pos", F.col("p.title.rendered").alias("title"), F.col("p.link").alias("url"), F.col("p.excerpt.rendered").alias("summary"), utc.alias("raw_date")), "json-api", "json")


def presscorner(payloads: DataFrame) -> DataFrame:
    p = _json(payloads).select("source_id", "page", F.posexplode(F.from_json("body", PRESSCORNER)["docuLanguageListResources"]).alias("pos", "p"))
    url = F.when(F.col("p.refCode") != "", F.concat(F.lit(PRESSCORNER_URL), F.lower(F.replace(F.col("p.refCode"), F.lit("/"), F.lit("_")))))
    return _rows(p.select("source_id", "page", "pos", F.col("p.title").alias("title"), url.alias("url"), F.col("p.leadText").alias("summary"), F.col("p.eventDate").alias("raw_date")), "json-api", "json")


def sitecore(payloads: DataFrame, template: str) -> DataFrame:
    """Items of one template whose areas meet the scope of the payload, on the page's own host, with a date."""
    same = lambda c: F.upper(F.regexp_replace(c, "[{}-]", ""))
    p = _json(payloads).withColumn("f", F.from_json("body", SITECORE)).select("source_id", "page", F.transform("f.scope", same).alias("scope"), F.posexplode("f.articles").alias("pos", "p"))
    p = p.filter((same(F.col("p.template")) == template.upper().replace("-", "").strip("{}")) & F.arrays_overlap("scope", F.transform("p.areas", same)) & ~F.coalesce(F.col("p.date"), F.lit("00010101")).startswith("00010101"))
    url = F.when(F.col("p.path").startswith("/"), F.concat(F.regexp_extract("page", "^(https?://[^/?#]+)", 1), F.col("p.path"))).otherwise(F.col("p.path"))
    p = p.withColumn("url", url).filter(F.regexp_extract("url", "^https?://([^/?#]+)", 1) == F.regexp_extract("page", "^https?://([^/?#]+)", 1))
    return _rows(p.select("source_id", "page", "pos", F.col("p.title").alias("title"), "url", F.col("p.summary").alias("summary"), F.col("p.date").alias("raw_date")), "json-api", "public-sitecore")


def json_list(payloads: DataFrame, schema: str, items: str, title: str, url: str, summary: str, date: str, where: str = "true") -> DataFrame:
    """Items of any JSON list, by expressions over its item `p`; for publishers whose feed differs only in names."""
    p = _json(payloads).withColumn("f", F.from_json("body", schema)).select("source_id", "page", F.posexplode(F.expr(items)).alias("pos", "p")).filter(where)
    return _rows(p.select("source_id", "page", "pos", F.expr(title).alias("title"), F.expr(url).alias("url"), F.expr(summary).alias("summary"), F.expr(date).alias("raw_date")), "json-api", "json")


class Adapters:
    """Named parsers for feeds and listings. A name is registered once; a payload with a name has no other parser."""

    def __init__(self):
        self._known: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        if kind not in ("feed", "listing") or not name or (kind, name) in self._known:
            raise ValueError(f"adapter {kind} {name!r} is unknown in kind, unnamed or registered twice")
        self._known[kind, name] = parser

    def parse(self, kind: str, payloads: DataFrame, other: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Each payload (with an `adapter` column) by the parser of its name, those without a name by `other`."""
        names = [n for k, n in self._known if k == kind]
        out = other(payloads.filter(~F.coalesce(F.col("adapter").isin(*names), F.lit(False))) if names else payloads)
        for n in names:
            out = out.unionByName(self._known[kind, n](payloads.filter(F.col("adapter") == n)))
        return out


def within_policy(items: DataFrame, sources: DataFrame) -> DataFrame:
    """The items whose address their source allows."""
    spec = sources.select(F.col("id").alias("_id"), "allow_domains", "include_patterns", "exclude_patterns")
    met = items.join(spec, F.col("source_id") == F.col("_id"))
    return met.filter(allowed_url(F.col("url"), F.col("allow_domains"), F.col("include_patterns"), F.col("exclude_patterns"))).select(*items.columns)


def listing_pages(sources: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """source_id, pos, url: yearly listings from the last year back, each followed by its pages; every address once."""
    years = F.reverse(F.sequence(F.lit(first_year), F.lit(last_year)))
    pages = F.when(F.coalesce("max_pages", F.lit(1)) > 1, F.sequence(F.lit(1), F.col("max_pages") - 1)).otherwise(F.array().cast("array<int>"))
    yearly = F.transform(years, lambda y: F.replace(F.coalesce("yearly_listing_url", F.lit("")), F.lit("{year}"), y.cast("string")))
    starts = F.when(F.coalesce("yearly_listing_url", F.lit("")) != "", yearly).otherwise(F.array("listing_url"))
    numbered = F.transform(pages, lambda n: F.replace(F.replace(F.coalesce("pagination_url", F.lit("")), F.lit("{page}"), n.cast("string")), F.lit("{year}"), F.lit(str(last_year))))
    urls = F.array_distinct(F.filter(F.concat(starts, numbered), lambda u: u.isNotNull() & (u != "")))
    return sources.select(F.col("id").alias("source_id"), F.posexplode(urls).alias("pos", "url"))
