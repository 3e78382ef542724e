"""Sheets, manifests, state, names and the composed flow from payloads."""

import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from presswell.operators import audit, dedupe, relations, status
from presswell.operators.classify import classify
from presswell.operators.lexicon import DEFAULT, load_lexicon, save_lexicon
from presswell.operators.periods import date_language, default_name, display_dates, observation_key, resolve_period
from presswell.plans import pipeline
from presswell.sinks import articles as sink
from presswell.sinks import reports
from presswell.sources import config, publishers
from presswell.streaming import ingest

PERIOD = resolve_period("2022-02-01", "2022-02-28")
SOURCE = "id string, country string, name string, name_zh string, institution_type string, language string, timezone string, critical boolean, freshness_days int, date_policy string, detail_pages int, max_pages int, observation_runs int, allow_domains array<string>, include_patterns array<string>, exclude_patterns array<string>, date_formats array<string>, date_order string, feed_urls array<string>, homepage string, listing_url string"


def sources(spark):
    row = lambda i, name: (i, "DE", "n", "名", "監理機關", "de", "Europe/Berlin", True, 45, "required", 5, 1, 3, [f"{name}.eu"], [], [], [], "DMY", [], f"https://{name}.eu", f"https://{name}.eu/news")
    return spark.createDataFrame([row("s1", "a"), row("s2", "b")], SOURCE)


def test_names_and_keys(spark):
    assert display_dates(PERIOD.since, PERIOD.until) == (date(2022, 2, 1), date(2022, 2, 28))
    assert default_name(PERIOD.since, PERIOD.until, "x") == "x_20220201-20220228.xlsx"
    assert observation_key("e", "m", {"a": 1}) == observation_key("e", "m", {"a": 1}) != observation_key("e", "m", {"a": 2})
    rows = spark.createDataFrame([("no-NO",), ("de-AT",), ("xx",), (None,), ("",)], "l string").select(date_language(F.col("l"))).collect()
    assert [r[0] for r in rows] == ["nb", "de", "", "", ""]
    assert audit.audited(sources(spark), 1).count() == 1 and audit.audited(sources(spark)).count() == 2
    assert relations.selected_sources(sources(spark), ids=["s1"]).count() == 1
    with pytest.raises(ValueError):
        relations.selected_sources(sources(spark), ids=["s1", "nobody"])


def test_lexicon_files(spark, tmp_path):
    save_lexicon(DEFAULT, tmp_path / "l.json")
    assert load_lexicon(tmp_path / "l.json") == DEFAULT
    one = {"name": "r", "weight": 2, "keywords": ["sbom", "supply chain"], "by_hit": [{"topic": "PRODUCT", "words": ["sbom"]}, {"topic": "SUPPLY", "words": ["supply chain"]}]}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "rules": [one]}), encoding="utf-8")
    a = spark.createDataFrame([("an sbom for the supply chain", None), ("supply chain", None), (None, None)], "title string, summary string")
    # both hits belong to one rule of weight 2, and each leads to its own topic
    assert [(r["topics"], r["score"]) for r in classify(a, load_lexicon(tmp_path / "m.json")).collect()] == [(["PRODUCT", "SUPPLY"], 3), (["SUPPLY"], 2), ([], 0)]
    for broken in ({"weight": 0}, {"keywords": []}, {"by_hit": []}, {"by_hit": [{"topic": "NONE", "words": ["x"]}]}):
        (tmp_path / "b.json").write_text(json.dumps({"schema_version": 1, "rules": [one | broken]}), encoding="utf-8")
        with pytest.raises(ValueError):
            load_lexicon(tmp_path / "b.json")


def test_patterns_and_modules(spark):
    bad = sources(spark).withColumn("include_patterns", F.when(F.col("id") == "s1", F.array(F.lit("(open"))).otherwise(F.array(F.lit("/ok/[0-9]+"))))
    assert {r["id"]: r["problems"] for r in config.source_problems(bad).collect()} == {"s1": ["pattern"]}
    assert config.date_setting_problems("qq", "UTC", "DMY", ["%Y-%m-%d %Q"]) == ["language", "date_formats"]


def test_merge_of_all_fields(spark):
    kind = "array<struct<raw_value:string,utc_micros:long,date_source:string,timezone:string>>"
    at = datetime(2022, 2, 20, tzinfo=timezone.utc)
    micros = int(at.timestamp()) * 1_000_000
    rows = [(1, "s", "DE", "de", "https://a.eu/x", "A title", at, "high", "", None, None, 1, ["AI"], ["x"], [("r1", micros, "time", "UTC")], "time", "r1"), (2, "t", "DE", "de", "https://a.eu/x/", "A title", None, "low", "more", ["f"], None, 4, ["AI", "DATA"], ["y", "x"], [("r1", micros, "time", "UTC"), ("r2", 5, "text", "UTC")], None, None)]
    a = spark.createDataFrame(rows, f"article_id long, source_id string, country string, language string, url string, title string, published_at timestamp, date_confidence string, summary string, discovered_by array<string>, alternate_urls array<string>, score int, topics array<string>, keywords array<string>, date_candidates {kind}, date_source string, raw_value string")
    r = dedupe.merged(a).first()
    assert (r["score"], r["topics"], r["keywords"], r["summary"], r["discovered_by"]) == (4, ["AI", "DATA"], ["x", "y"], "more", ["s", "f"])
    assert [(c["raw_value"], c["selected"]) for c in r["date_candidates"]] == [("r1", True), ("r2", False)]


def test_run_workbook_manifest_and_bundle(spark, tmp_path):
    src = sources(spark)
    at = datetime(2022, 2, 20, tzinfo=timezone.utc)
    a = spark.createDataFrame([(1, "s1", "SBOM rules", "", "https://a.eu/1", at, "high", "監理機關")], "article_id long, source_id string, title string, summary string, url string, published_at timestamp, date_confidence string, institution_type string")
    found = pipeline.analysed(a)
    assert {r["sheet"]: r["n"] for r in reports.sheet_sizes(found).collect()} == {"全部命中新聞": 1, "CRA_CSA_NIS2_CER": 1, "官方規範與執法": 1}
    st = status.source_status(a, src, PERIOD.since.isoformat(), PERIOD.until.isoformat())
    staged, out = tmp_path / "staged", tmp_path / "out"
    staged.mkdir()
    book = reports.run_workbook(staged / "run.xlsx", found, st, src, src.select("id", "country"), "r1", PERIOD)
    assert len(sink.workbook_sheets(book)) == 9
    (staged / "articles.jsonl").write_text("\n".join(r[0] for r in sink.article_lines(a, "r1").collect()) + "\n", encoding="utf-8")
    manifest = reports.run_manifest("r1", PERIOD, st, status.source_summary(st), status.date_summary(a), "complete", {"articles.jsonl": 1})
    assert manifest["source_summary"]["total"] == 2 and manifest["date_quality"]["by_confidence"] == "high=1"
    sink.publish(staged, out, manifest)
    kept = json.loads((out / sink.MANIFEST).read_text(encoding="utf-8"))
    assert sink.bundle_problems(out) == [] and reports.content_problems(out, kept, (".xlsx", ".jsonl")) == []
    assert reports.content_problems(out, kept | {"run_id": "other", "row_counts": {"articles.jsonl": 2}}, (".pdf",)) == ["required .pdf", "run_id articles.jsonl", "rows articles.jsonl"]
    settings = reports.settings_sheet(spark)
    assert [reports.cached_search(tmp_path / "cache", {"q": 1}, a, settings)[1] for _ in range(2)] == [False, True]


def test_kept_state_and_scheduled_run(spark, tmp_path):
    schema, path = "day string, source_id string, n long", str(tmp_path / "state")
    assert reports.load_state(spark, path, schema).count() == 0
    for rows in ([("d1", "s", 1), ("d2", "s", 2)], [("d2", "s", 5)]):
        reports.save_state(spark.createDataFrame(rows, schema), path, "day")
    assert sorted((r["day"], r["n"]) for r in reports.load_state(spark, path, schema).collect()) == [("d1", 1), ("d2", 5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"url": "https://a.eu/1", "title": "t"}), encoding="utf-8")
    for _ in range(2):
        assert ingest.run_available(ingest.corpus_stream(spark, str(tmp_path / "in")).select("url"), str(tmp_path / "rows"), str(tmp_path / "check"), 120)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1


def test_only_explicit_publication_dates():
    url, who = publishers.REFORMS[0] + "/it/comunicazione/notizie/x/", publishers.REFORMS[2]
    page = "<html><head><meta property='og:url' content='{}'><meta property='og:site_name' content='{}'>{}</head><body><h1>A headline here</h1></body></html>"
    date_ = "<meta property='article:published_time' content='2022-02-03'>"
    assert publishers.published_detail(page.format(url, who, date_), url) == ("A headline here", "2022-02-03")
    for other in (page.format(url, who, date_ * 2), page.format(url, "x", date_), page.format(url + "y/", who, date_), page.format(url, who, "<meta property='og:updated_time' content='2022-02-03'>")):
        assert publishers.published_detail(other, url) is None
    with pytest.raises(ValueError):
        publishers.published_detail("", "https://evil.example/")


def test_scrape_from_payloads_in_list_order(spark):
    landed = "source_id string, url string, body string"
    item = "<item><title>{0}</title><link>https://a.eu/{1}</link><pubDate>Sun, 20 Feb 2022 10:00:00 GMT</pubDate><description>{2}</description></item>"
    feed = "<rss><channel>" + item.format("Artificial intelligence act", "1", "short") + item.format("Not allowed here", "1", "x").replace("a.eu", "evil.eu") + "</channel></rss>"
    page = "<main><article><h2><a href='https://a.eu/1'>Artificial intelligence act</a></h2><p>a much longer summary of it</p></article><article><h2><a href='https://a.eu/2'>An undated entry on the ai act</a></h2></article></main>"
    own = "<html><head><meta property='article:published_time' content='2022-02-21T10:00:00Z'><meta name='description' content='from its own page'></head><main><h1>An undated entry on the ai act</h1></main></html>"
    frame = lambda *rows: spark.createDataFrame([*rows], landed)
    found = pipeline.scrape(frame(("s1", "https://a.eu/rss", feed)), frame(("s1", "https://a.eu/news", page)), frame(("s1", "https://a.eu/2", own)), sources(spark), PERIOD, "2022-03-01T00:00:00Z")
    rows = found.orderBy("article_id").collect()
    assert [(r["url"][-1], r["summary"], str(r["published_at"])[:10]) for r in rows] == [("1", "short", "2022-02-20"), ("1", "a much longer summary of it", "None"), ("2", "from its own page", "2022-02-21")]
    run = pipeline.collect(found, sources(spark), PERIOD, "2022-03-01T00:00:00Z")
    assert [(r["url"][-1], r["summary"]) for r in run.corpus.orderBy("article_id").collect()] == [("1", "a much longer summary of it"), ("2", "from its own page")]
