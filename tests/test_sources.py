import json

import pytest
from pyspark.sql import functions as F

from presswell.functions.html import parse, plain_text
from presswell.operators.periods import resolve_period
from presswell.plans import pipeline
from presswell.sinks import articles as sink
from presswell.sources import config, corpus, feeds, listings, robots
from presswell.streaming import ingest

LANDED = "source_id string, url string, body string"
SPEC = {"allow_domains": ["a.eu"], "include_patterns": ["/news/"], "exclude_patterns": []}


def landed(spark, *bodies):
    return spark.createDataFrame([("s", "https://a.eu/feed", b) for b in bodies], LANDED)


def test_rss_and_atom(spark):
    rss = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="x"><channel><title>c</title>
      <item><title>First &amp; best</title><link>https://a.eu/news/1</link><pubDate>Fri, 25 Feb 2022 14:08:35 +0100</pubDate><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description></item>
      <item><title>Second</title><link>https://a.eu/other/2</link><dc:date>2022-02-25</dc:date></item><item><title></title><link>https://a.eu/news/3</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Third one</title><link rel="self" href="https://a.eu/self"/><link href="https://a.eu/news/4"/><updated>2022-02-24T00:00:00Z</updated><summary>s</summary></entry></feed>"""
    got = sorted(feeds.rss(landed(spark, rss, atom, "no xml", None, "", '{"a":1}')).select("title", "url", "summary", "raw_date").collect())
    assert [tuple(r) for r in got] == [("First & best", "https://a.eu/news/1", "Some text", "Fri, 25 Feb 2022 14:08:35 +0100"), ("Second", "https://a.eu/other/2", "", "2022-02-25"), ("Third one", "https://a.eu/news/4", "s", "2022-02-24T00:00:00Z")]
    sources = spark.createDataFrame([("s", ["a.eu"], ["/news/"], None)], "id string, allow_domains array<string>, include_patterns array<string>, exclude_patterns array<string>")
    assert feeds.within_policy(feeds.rss(landed(spark, rss)), sources).count() == 1


def test_json_feeds(spark):
    posts = json.dumps([{"title": {"rendered": "A <i>post</i>"}, "excerpt": {"rendered": "<p>x</p>"}, "link": "https://a.eu/1", "date": "2022-01-01T00:00:00", "date_gmt": "2021-12-31T23:00:00"}, {"title": {"rendered": ""}, "link": "https://a.eu/2"}])
    got = feeds.wordpress(landed(spark, "\n " + posts, "<rss/>")).select("title", "summary", "raw_date").collect()
    assert [tuple(r) for r in got] == [("A post", "x", "2021-12-31T23:00:00Z")]
    press = json.dumps({"docuLanguageListResources": [{"title": "T", "refCode": "IP/22/1", "leadText": "l", "eventDate": "2022-01-01"}, {"title": "no ref"}]})
    assert feeds.presscorner(landed(spark, press)).first()["url"].endswith("/detail/en/ip_22_1")
    core = json.dumps({"source_url": "https://a.eu/feed", "scope": ["{ab-1}"], "articles": [{"template": "t-1", "areas": ["AB1"], "path": "/n/1", "title": "T", "date": "20220101T000000Z"}, {"template": "t1", "areas": ["zz"], "path": "/n/2", "title": "T", "date": "20220101T000000Z"}, {"template": "T1", "areas": ["ab1"], "path": "https://b.eu/n", "title": "T", "date": "20220101T000000Z"}, {"template": "T1", "areas": ["ab1"], "path": "/n/3", "title": "T", "date": "00010101"}]})
    assert [r["url"] for r in feeds.sitecore(landed(spark, core), "T1").collect()] == ["https://a.eu/n/1"]


def test_adapters_dispatch_once(spark):
    a = feeds.Adapters()
    a.register("feed", "own", lambda df: feeds.rss(df).withColumn("title", F.lit("own")))
    with pytest.raises(ValueError):
        a.register("feed", "own", feeds.rss)
    item = "<rss><channel><item><title>plain title</title><link>https://a.eu/1</link></item></channel></rss>"
    df = spark.createDataFrame([("s", "u", item, "own"), ("s", "u", item, ""), ("s", "u", item, None)], LANDED + ", adapter string")
    assert sorted(r["title"] for r in a.parse("feed", df, feeds.rss).collect()) == ["own", "plain title", "plain title"]


PAGE = """<html><head><base href="https://a.eu/base/"><link rel="alternate" type="application/rss+xml" href="/feed.xml"></head><body>
 <nav><article><a href="/news/nav">A navigation article</a></article></nav><main>
 <article class="x"><h2><a href="../news/1?utm_source=q">A first headline</a></h2><time datetime="2022-02-25T10:00:00Z">25 Feb</time><p>Sum <b>mary</b></p></article>
 <article><a href="/news/1">A first headline again</a></article><li class="teaser"><a href="/news/2">Go</a><h3>Second headline here</h3> 3. März 2022<p>two</article>
 <article><a href="/other/3">Not allowed by policy</a></article><article><a href="/news/4">Next page</a></article></main></body></html>"""


def test_listing_pages(spark):
    sources = spark.createDataFrame([("s", ["a.eu"], ["/news/"], [])], "id string, allow_domains array<string>, include_patterns array<string>, exclude_patterns array<string>")
    got = listings.parse_listings(landed(spark, PAGE, None, "", "<a"), sources).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["summary"], r["raw_date"], r["date_source"], r["date_confidence"]) for r in got] == [
        ("A first headline", "https://a.eu/news/1?utm_source=q", "Sum mary", "2022-02-25T10:00:00Z", "time-element", "high"),
        ("Second headline here", "https://a.eu/news/2", "two", "3. März 2022", "visible-text", "low"),
    ]
    assert listings.discover_feeds(PAGE, "https://a.eu/x") == ["https://a.eu/feed.xml"]
    assert len(listings.directory_links(PAGE, "https://a.eu/", ["a.eu"], 2)) == 2


def test_selectors():
    root = parse('<div id="m" class="card big" data-x="Ab"><p>one<p>two<ul><li>a<li>b</ul><a href=x>l</a><br>tail</div>')
    assert [n.text() for n in root.all("div.card > p")] == ["one", "two"] and len(root.all("li")) == 2
    assert root.first("[data-x='ab' i]").get("id") == "m" and root.first("div a[href]").text() == "l" and root.first("span, #m").name == "div"
    assert root.first("[class~='big']") and not root.first("[class='big']") and not root.first("p > a")
    assert plain_text("a &amp; <b>b</b>") == "a & b" and plain_text(None) == ""


def test_detail_pages(spark):
    page = """<html><title>Fallback 01.02.2022</title><meta property="og:description" content="long description"><meta property="article:published_time" content="2022-02-03">
      <script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["NewsArticle"],"headline":"The headline","datePublished":"2022-02-02"}]}</script><main><h1>Other heading</h1><time>4.2.2022</time></main></html>"""
    got = listings.parse_details(spark.createDataFrame([("u", page), ("v", None)], "url string, body string")).orderBy("url", "pos").collect()
    assert [(r["title"], r["raw_date"], r["date_source"]) for r in got] == [("The headline", "2022-02-02", "json-ld"), ("The headline", "2022-02-03", "article-meta"), ("The headline", "4.2.2022", "time-element"), ("The headline", "01.02.2022", "title-text"), ("", None, None)]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nuser-agent: presswell\nallow: /a\ndisallow: /a/b\nCrawl-delay: 3\nUser-agent: PRESSWELL # again\nDisallow: /*.pdf$\nDisallow: /%7Ex"
    policy, delay = robots.rules(text)
    assert delay == 3.0
    assert {u: robots.allows(policy, "https://h" + u) for u in ("/a", "/a/b", "/a/bc", "/z", "/x.pdf", "/x.pdf?q", "/~x", "/robots.txt")} == {"/a": True, "/a/b": False, "/a/bc": False, "/z": True, "/x.pdf": False, "/x.pdf?q": True, "/~x": False, "/robots.txt": True}
    urls = spark.createDataFrame([("h", "https://h/a/b"), ("none", "https://none/x")], "host string, url string")
    files = spark.createDataFrame([("h", text)], "host string, body string")
    assert sorted(map(tuple, robots.decisions(urls, files).collect())) == [("https://h/a/b", False), ("https://none/x", True)]


def module(cid, sid, **extra):
    source = {"id": sid, "country": "DE", "name_zh": "z", "name": "n", "institution_type": "ministry", "language": "de", "homepage": "https://a.eu", "listing_url": "https://a.eu/news"}
    topic = "量子技術"
    return {"schema_version": 1, "module_version": "1", "canonical_id": cid, "names": {}, "sources": [source], "filter": {"topics": [topic]}, "health": {}, "history": {}, "responsibility_by_topic": {topic: "owner"}} | extra


def test_registry_layers(spark, tmp_path):
    own, more = tmp_path / "own", tmp_path / "more"
    own.mkdir()
    more.mkdir()
    (own / "a.json").write_text(json.dumps(module("a", "s1")), encoding="utf-8")
    (own / "b.json").write_text(json.dumps(module("b", "s2")), encoding="utf-8")
    (own / "c.json").write_text("{broken", encoding="utf-8")
    (more / "b.json").write_text(json.dumps(module("b", "s1")), encoding="utf-8")
    (more / "d.json").write_text(json.dumps(module("d", "s3", filter={"topics": ["unknown"]})), encoding="utf-8")
    r = config.load_registry(own, more)
    # the external b takes a source of a, so the built-in b comes back
    assert [(m.canonical_id, m.external, m.source_ids) for m in r.modules] == [("a", False, ["s1"]), ("b", False, ["s2"])]
    assert len(r.errors) == 3 and r.overrides == ("b",)
    row = config.module_table(spark, r).filter("source_id = 's1'").first()
    assert row["allowed"] == ["QUANTUM"] and row["owners"] == {"QUANTUM": "owner"}


def test_source_settings(spark, tmp_path):
    p = tmp_path / "s.toml"
    base = {k: v for k, v in module("a", "s1")["sources"][0].items()}
    p.write_text(config.sources_toml([base | {"critical": True}, base | {"id": "s2", "allow_domains": ["b.eu"], "country": "XX"}]), encoding="utf-8")
    df = config.read_sources_toml(spark, p)
    got = {r["id"]: r for r in df.collect()}
    assert (got["s1"]["freshness_days"], got["s2"]["freshness_days"], got["s1"]["timezone"], got["s1"]["date_policy"]) == (45, 90, "Europe/Berlin", "required")
    assert {r["id"]: r["problems"] for r in config.source_problems(df).collect()} == {"s2": ["outside_domains", "country"]}
    assert config.date_setting_problems("de", "Europe/Nowhere", "XYZ", ["%d.%m"]) == ["timezone", "date_order", "date_formats"]
    assert feeds.listing_pages(df.withColumns({"yearly_listing_url": F.lit("https://a.eu/{year}"), "pagination_url": F.lit("https://a.eu/p{page}"), "max_pages": F.lit(3)}), 2021, 2022).filter("source_id = 's1'").orderBy("pos").select("url").toPandas()["url"].tolist() == ["https://a.eu/2022", "https://a.eu/2021", "https://a.eu/p1", "https://a.eu/p2"]


def test_strict_json_files(tmp_path):
    p = tmp_path / "c.json"
    for text in ('{"a":1,"a":2}', "[1]", " " * 100 + "{}"):
        p.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError):
            config.load_catalog(p, limit=50)


LINE = {"source_id": "s", "country": "DE", "source_name": "n", "institution_type": "ministry", "language": "en", "title": "NIS2 incident reporting", "summary": "NIS2 rules", "published_at": "2022-02-20T10:00:00+00:00"}


def test_corpus_index_and_search(spark, tmp_path):
    f = tmp_path / "one.corpus.jsonl"
    lines = [LINE | {"url": "https://a.eu/1", "title": "old"}, LINE | {"url": "https://a.eu/1"}, LINE | {"url": "https://a.eu/2", "published_at": "2022-03-20T10:00:00+00:00"}, *[LINE | {"url": f"https://a.eu/x{i}", "title": "other", "summary": "words"} for i in range(8)]]
    f.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n", encoding="utf-8")
    c = corpus.read_corpus(spark, str(tmp_path))
    assert c.count() == 10
    p = resolve_period("2022-02-01", "2022-02-28")
    assert [r["url"] for r in pipeline.search(c, p, ["s"]).collect()] == ["https://a.eu/1"]
    assert pipeline.search(c, p, []).count() == 0 and pipeline.search(c, p, ["s"], topics=["AI"]).count() == 0
    index = spark.createDataFrame(c.collect(), c.schema)
    (tmp_path / "two.corpus.jsonl").write_text(json.dumps(LINE | {"url": "https://a.eu/9"}), encoding="utf-8")
    f.unlink()
    now = corpus.refreshed(index, corpus.corpus_files(spark, str(tmp_path)))
    assert [r["url"] for r in now.collect()] == ["https://a.eu/9"]


def test_search_coverage(spark):
    p = resolve_period("2022-02-01", "2022-02-28")
    day = 86_400_000_000
    at = int(p.since.timestamp() * 1_000_000)
    good = [("r1", at - day, at + 9 * day), ("r2", at + 9 * day, at + 40 * day)]
    m = [(r, s, e, True, True, x, True) for r, s, e in good for x in ("a", "b")] + [("r3", at, at + day, True, False, "a", True)]
    df = spark.createDataFrame(m, "run_id string, start long, end long, complete boolean, passed boolean, source_id string, ok boolean")
    wanted = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert pipeline.search_coverage(df, wanted, p).first()["complete"]
    assert not pipeline.search_coverage(df.filter("not (run_id = 'r2' and source_id = 'b')"), wanted, p).first()["complete"]


def test_bundle_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, "=danger", "x" * 600, ["AI"], 0.5)], "article_id long, title string, summary string, topics array<string>, bm25 double")
    staged, out = tmp_path / "staged", tmp_path / "out"
    staged.mkdir()
    book = sink.write_workbook(staged / "report.xlsx", {"all": sink.sheet_data(a), "empty": (["h"], [])})
    assert sink.workbook_sheets(book) == ["all", "empty"]
    (staged / "lines.jsonl").write_text("\n".join(r[0] for r in sink.article_lines(a, "r").collect()), encoding="utf-8")
    row = json.loads((staged / "lines.jsonl").read_text(encoding="utf-8"))
    assert list(row)[:3] == ["schema_version", "run_id", "source_id"] and len(row) == 35 and row["matched_topics"] == ["AI"] and row["bm25_score"] == 0.5 and row["published_at"] is None
    sink.publish(staged, out, {"run_id": "r"})
    assert sink.bundle_problems(out) == []
    (out / "lines.jsonl").write_text("changed", encoding="utf-8")
    (out / "more").write_text("", encoding="utf-8")
    assert sink.bundle_problems(out) == ["extra more", "size lines.jsonl"]
    assert sink.sheet_rows(a).first()["title"] == "'=danger" and sink.markdown_table(["a"], [["x|y"]]).splitlines()[-1] == "| x\\|y |"


def test_streams(spark, tmp_path):
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    folder.mkdir()

    def run():
        q = ingest.distinct_urls(ingest.corpus_stream(spark, str(folder))).select("url", "title").writeStream.format("parquet").option("checkpointLocation", str(check)).trigger(availableNow=True).start(str(out))
        q.awaitTermination(120)
        return sorted(r["url"] for r in spark.read.parquet(str(out)).collect())

    (folder / "a.jsonl").write_text("\n".join(json.dumps(LINE | {"url": u}) for u in ("https://a.eu/1", "https://a.eu/1/#x", "https://a.eu/2")), encoding="utf-8")
    assert len(run()) == 2
    (folder / "b.jsonl").write_text("\n".join(json.dumps(LINE | {"url": u}) for u in ("https://a.eu/2", "https://a.eu/3")), encoding="utf-8")
    assert len(run()) == 3


def test_streaming_health(spark, tmp_path):
    schema = "source_id string, at timestamp, raw_count long, success boolean, failed boolean"
    src = tmp_path / "obs"
    spark.createDataFrame([("s", "2022-01-0%d" % (i + 1), c, True, c < 5) for i, c in enumerate([20, 24, 22, 2])], "source_id string, at string, raw_count long, success boolean, failed boolean").selectExpr("source_id", "cast(at as timestamp) at", "raw_count", "success", "failed").coalesce(1).write.parquet(str(src))
    q = ingest.trailing_health(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("health_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [(r["raw_count"], r["median_count"]) for r in spark.table("health_out").orderBy("at").collect()] == [(20, 0.0), (24, 20.0), (22, 22.0), (2, 22.0)]


def test_rechecks(spark, tmp_path):
    from presswell.sources import rechecks

    attempt = {"url": "https://a.eu", "observed_at": "2022-01-02T00:00:00+00:00", "http_status": 200}
    check = lambda i, result="blocked", **k: {"canonical_id": i, "country": "DE", "result": result, "next_action": "wait", "attempts": [attempt]} | k
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value), encoding="utf-8")
    write("ministry_round1_baseline.json", {"observed_on": "2022-01-01", "remaining_count": 4, "ministries": [{"canonical_id": i, "country": "DE"} for i in "abcd"]})
    write("ministry_round1_x.json", {"schema_version": 1, "group": "x", "observed_on": "2022-01-02", "checks": [check("a", "registered"), check("b"), check("c", "odd", country="FR", attempts=[]), check("z")]})
    write("ministry_round1_fixture.json", {"other": 1})
    write("ministry_round2_baseline.json", {"observed_on": "2022-02-01", "remaining_count": 1, "ministries": [{"canonical_id": "c", "country": "DE"}]})
    write("ministry_round2_y.json", {"schema_version": 1, "group": "y", "observed_on": "2022-01-15", "checks": [check("c")]})
    base, reports = rechecks.baselines(spark, str(tmp_path)), rechecks.checks(spark, str(tmp_path))
    assert base.count() == 5 and reports.count() == 5
    got = sorted(map(tuple, rechecks.recheck_problems(base, reports).collect()))
    assert got == sorted([(1, "d", "unreported"), (1, "z", "unexpected"), (1, "c", "country"), (1, "c", "result"), (1, "c", "attempts"), (2, "c", "too_early"), (2, "b", "dropped"), (2, "z", "dropped")])
    assert {r["canonical_id"]: r["round"] for r in rechecks.latest_checks(reports).collect()} == {"a": 1, "b": 1, "c": 2, "z": 1}
