"""Audits of sources, catalogs, inventories and rechecks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.urls import host_of, identity_key
from presswell.operators.relations import suffix_join

#: Links read from one directory page.
MAX_LINKS = 500
#: What shows a challenge page, and what a qualifying run must reach.
CHALLENGES = ("captcha", "cf-challenge", "just a moment", "checking your browser", "access denied", "attention required", "enable javascript and cookies")
HIGH, CONFLICT = 0.75, 0.05


def content_error(body: Column, least_bytes: Column) -> Column:
    """challenge_page, undersized or empty for a landed page, null for one that may be parsed."""
    text = F.lower(F.coalesce(body, F.lit("")))
    hit = F.lit(False)
    for c in CHALLENGES:
        hit = hit | F.contains(text, F.lit(c))
    title = F.regexp_extract(text, "(?s)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.trim(text) == "", "empty").when(F.octet_length(body) < least_bytes, "undersized").when(F.contains(title, F.lit("access denied")) | (hit & (F.length(text) < 20000)), "challenge_page")


def parse_assessment(parsed: DataFrame, observed: Column) -> DataFrame:
    """Per source: raw, high_rate, conflict_rate, future, undated over all parsed rows (published_at, date_confidence, conflict)."""
    n = lambda c, name: F.count_if(c).alias(name)
    ts = F.col("published_at")
    out = parsed.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw"), n(ts.isNotNull() & (F.col("date_confidence") == "high"), "high"), n(F.col("conflict"), "conflicts"), n(ts > observed, "future"), n(ts.isNull(), "undated"))
    return out.withColumns({"high_rate": F.round(F.col("high") / F.col("raw"), 6), "conflict_rate": F.round(F.col("conflicts") / F.col("raw"), 6)}).drop("high", "conflicts")


def qualifies(required: Column) -> Column:
    """Whether an assessed observation (healthy, endpoints_healthy, success, fresh, request_failures and the rates) counts for promotion."""
    c = F.col
    return F.coalesce(c("healthy") & c("endpoints_healthy") & c("success") & c("fresh") & (c("raw") > 0) & (c("assessed") == c("raw")) & (c("high_rate") >= HIGH) & (c("conflict_rate") <= CONFLICT) & (c("future") == 0) & (~required | (c("undated") == 0)) & (c("request_failures") == 0), F.lit(False))


def inventory_report(rows: DataFrame) -> DataFrame:
    """Per country: entries by status. rows: country, canonical_id, status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("entries"), n("registered"), n("unresolved"), n("excluded"), n("pending"))


def inventory_problems(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """canonical_id and problem: a registered entry whose source is unknown, or belongs to another country."""
    s = sources.select(F.col("id").alias("source_id"), F.col("country").alias("_country"))
    met = rows.filter("source_id is not null").join(s, "source_id", "left")
    problem = F.when(F.col("_country").isNull(), "unknown_source").when(F.col("_country") != F.col("country"), "other_country")
    return met.select("canonical_id", problem.alias("problem")).filter("problem is not null")


def shared_urls(rows: DataFrame) -> DataFrame:
    """url_key and how many entries use it, for addresses that several entries share."""
    return rows.withColumn("url_key", identity_key(F.col("url"))).groupBy("url_key").agg(F.count_distinct("canonical_id").alias("entries")).filter("entries > 1")


def coverage_gaps(catalog: DataFrame, countries: DataFrame, topics: list[str]) -> DataFrame:
    """Per country: the topics of the list that no catalog entry (country, topics) has, in list order."""
    have = catalog.select("country", F.explode("topics").alias("t")).distinct().groupBy("country").agg(F.collect_set("t").alias("have"))
    wanted = F.array(*map(F.lit, topics))
    return countries.select("country").distinct().join(have, "country", "left").select("country", F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))


def already_registered(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """Catalog entries whose news address is that of a source, query and www. aside."""
    return catalog.withColumn("_k", identity_key(F.col("url"))).join(sources.select(identity_key(F.col("listing_url")).alias("_k")), "_k", "left_semi").drop("_k")


def catalog_problems(catalog: DataFrame, countries: list[str], topics: list[str]) -> DataFrame:
    """canonical_id and the codes of what is wrong with a catalog entry."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = (
        ("blank_id", blank("canonical_id")),
        ("country", ~F.coalesce(F.col("country").isin(*countries), F.lit(False))),
        ("https", ~F.coalesce(F.col("url").startswith("https://"), F.lit(False))),
        ("topics", (F.coalesce(F.size("topics"), F.lit(0)) <= 0) | (F.size(F.array_except("topics", F.array(*map(F.lit, topics)))) > 0)),
    )
    twice = catalog.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("_n"))
    found = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests], F.when(F.col("_n") > 1, F.lit("repeated_id"))))
    return catalog.join(twice, "canonical_id", "left").select("canonical_id", found.alias("problems")).filter(F.size("problems") > 0).distinct()


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import urljoin

    from presswell.functions.html import parse

    for pdf in batches:
        rows = []
        for page, body in zip(pdf["url"], pdf["body"], strict=True):
            anchors = parse(body or "").all("a[href]")[:MAX_LINKS]
            rows += [(page, i, urljoin(page, a.get("href")), a.text()[:240]) for i, a in enumerate(anchors) if a.get("href") and not a.get("href").startswith("#")]
        yield pd.DataFrame(rows, columns=["page", "pos", "link", "label"])


def discover(pages: DataFrame, domains: DataFrame, known: DataFrame) -> DataFrame:
    """url_key, url, label, country, discovered_from of links that landed directory pages (url, body) give for declared domains.

    domains: domain, pos, country; the first that fits decides. Links to hosts that `known` (url) has are no candidates.
    What an inventory makes of them is candidate_inventory's.
    """
    links = pages.select("url", "body").mapInPandas(_links, "page string, pos int, link string, label string").filter(F.col("link").startswith("https://"))
    links = links.withColumn("host", host_of(F.col("link")))
    declared = suffix_join(links, "host", domains).filter("domain is not null").join(domains.groupBy("domain").agg(F.min_by("country", "pos").alias("country")), "domain")
    bare = F.regexp_replace("host", "^www\\.", "")
    hosts = known.select(F.regexp_replace(host_of(F.col("url")), "^www\\.", "").alias("_bare")).distinct()
    fresh = declared.withColumn("_bare", bare).join(hosts, "_bare", "left_anti").withColumn("url_key", identity_key(F.col("link")))
    first = F.min(F.struct("page", "pos", "link", "label", "country")).alias("r")
    return fresh.groupBy("url_key").agg(first, F.array_sort(F.collect_set("page")).alias("discovered_from")).select("url_key", F.col("r.link").alias("url"), "r.label", "r.country", "discovered_from")


def audited(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """The sources that an audit looks at: all, or the first `limit` in the order of their ids."""
    return sources if limit is None else sources.orderBy("id").limit(limit)
