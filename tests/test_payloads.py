"""The payload queries carry every titled article, whatever signs its texts hold."""

import re
from collections import Counter
from html import escape
from urllib.parse import urljoin

import pytest

from presswell.functions.html import plain_text
from presswell.plans import queries
from presswell.sources import listings
from presswell.tables import read_table

ENDS = re.compile(r"^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$")
PAGE = "https://page.example/news"


def text(value):
    """A text with single blanks, as the queries show it, by brute force: what a feed escapes is markup again once it is read."""
    clean = plain_text(escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value or "")))
    return ENDS.sub("", re.sub(r"[\s\u200b\ufeff]+", " ", clean))


def titled(spark, d):
    return [r for r in read_table(spark, d, "articles").collect() if r["title"]]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Articles with line ends of both kinds, several parameters, quotes, markup and blank ends."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [
        ("s", "\thttps://a.eu/news/1?id=1&lang=de\n", "Fish & chips\nare back again", "first line\r\nsecond line\n\nthird"),
        ("s", "https://a.eu/news/it's?a=1&b=2&c=3", "A plain headline here", "said <b>in bold</b> & more\nnext"),
        ("s", " https://a.eu/news/3", "  Ends in blanks\n\n", None),
        ("s", "https://a.eu/news/4", None, "no title"),
        ("s", "https://a.eu/news/5", "", "no title"),
    ]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "article_id long, source_id string, url string, title string, summary string").coalesce(1).write.parquet(f"{d}/articles.parquet")
    spark.createDataFrame([("s", ["a.eu"], ["/news/"], [])], "id string, allow_domains array<string>, include_patterns array<string>, exclude_patterns array<string>").write.parquet(f"{d}/sources.parquet")
    return d


URLS = ["https://a.eu/news/1?id=1&lang=de", "https://a.eu/news/3", "https://a.eu/news/it's?a=1&b=2&c=3"]
TITLES = ["Fish & chips\nare back again", "Ends in blanks", "A plain headline here"]


@pytest.mark.parametrize("query", ["rss_items", "wordpress_posts"])
def test_odd_texts_survive_the_feed(spark, odd, query):
    got = sorted((r["url"], r["title"], r["summary"], r["n"]) for r in getattr(queries, query)(spark, odd).collect())
    assert got == [(u, t, s, 1) for u, t, s in zip(URLS, map(text, TITLES), ["first line second line third", "", "said in bold & more next"], strict=True)]


def test_odd_texts_survive_the_page(spark, odd):
    assert sorted((r["url"], r["title"]) for r in queries.listing_cards(spark, odd).collect()) == list(zip(URLS, TITLES, strict=True))


@pytest.mark.parametrize("query", ["rss_items", "wordpress_posts"])
def test_feeds_carry_all_titled_articles(spark, data, query):
    want = Counter((r["source_id"], ENDS.sub("", r["url"]), text(r["title"]), text(r["summary"])) for r in titled(spark, data) if text(r["title"]))
    got = {(r["source_id"], r["url"], r["title"], r["summary"]): r["n"] for r in getattr(queries, query)(spark, data).collect()}
    assert got == dict(want)


def test_pages_carry_all_titled_articles(spark, data):
    specs = {r["id"]: r.asDict() for r in read_table(spark, data, "sources").collect()}
    want = Counter()
    for r in titled(spark, data):
        url, title = urljoin(PAGE, r["url"].strip()), plain_text(r["title"].strip())
        if r["source_id"] in specs and listings.allowed(url, specs[r["source_id"]]) and len(title) >= listings.LEAST_TITLE and not listings.navigation(title):
            want[r["source_id"], url, title] += 1
    assert {(r["source_id"], r["url"], r["title"]): r["n"] for r in queries.listing_cards(spark, data).collect()} == dict(want)
