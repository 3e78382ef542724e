from datetime import datetime, timedelta, timezone
from random import Random

import pytest
from pyspark.sql import functions as F

from presswell.operators import audit, dedupe, health, relations, status, translate

T0 = datetime(2022, 3, 1, tzinfo=timezone.utc)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def fold(items):
    """The sequential merge that the entities must reproduce."""
    urls, titles, out = {}, {}, {}
    for i, u, t in items:
        e = urls.get(u) if u else None
        if e is None and t:
            e = titles.get(t)
        if e is None:
            e = i
        if u:
            urls[u] = e
        if t:
            titles[t] = e
        out[i] = e
    return sorted(out.items())


@pytest.mark.parametrize("seed", range(6))
def test_entities_equal_the_sequential_merge(spark, seed, monkeypatch):
    monkeypatch.setattr(dedupe, "RUN", 7)
    r = Random(seed)
    items = [(i, r.choice([None, "", *"abcdefgh"[: r.randint(2, 8)]]), r.choice([None, *"uvwxyz"[: r.randint(2, 6)]])) for i in range(r.randint(0, 60))]
    got = dedupe.entities(spark.createDataFrame(items, "ord long, url_key string, title_key string"))
    assert rows(got) == sorted(fold(items), key=str)


A = "article_id long, source_id string, country string, language string, title string, url string, published_at timestamp, date_confidence string, summary string, discovered_by array<string>, alternate_urls array<string>"


def test_merged_records(spark):
    a = spark.createDataFrame([
        (1, "s", "DE", "de", "Title", "https://a.eu/x?utm_a=1", None, "", "short", None, None),
        (2, "t", "DE", "de", "Title longer", "https://a.eu/x/", T0, "high", "shorter", ["q", "t"], ["https://a.eu/z"]),
        (3, "u", "FR", "fr", "title LONGER", "https://b.eu/y", T0 + timedelta(hours=3), "low", None, [], None),
        (4, "v", "FR", "fr", None, None, None, None, None, None, None),
    ], A)
    got = {r["entity"]: r for r in dedupe.merged(a).collect()}
    assert set(got) == {1, 4}
    e = got[1]
    assert (e["rows"], e["title"], e["summary"], e["published_at"].replace(tzinfo=timezone.utc), e["date_confidence"]) == (3, "Title longer", "shorter", T0, "high")
    assert e["discovered_by"] == ["s", "q", "t", "u"] and e["alternate_urls"] == ["https://a.eu/z", "https://b.eu/y"]
    assert dedupe.merged(a.limit(0)).count() == 0


def test_titles_on_different_days_stay_apart(spark):
    a = spark.createDataFrame([(i, "s", "DE", "de", "Same title", f"https://a.eu/{i}", T0 + timedelta(days=i), "", "", None, None) for i in range(2)], A)
    assert dedupe.merged(a).count() == 2


SRC = "id string, critical boolean, freshness_days int, date_policy string"


def test_status_summary_and_gates(spark):
    s = spark.createDataFrame([("a", True, 45, "required"), ("b", False, 1, "unavailable"), ("empty", True, 45, "required")], SRC)
    rowset = [("a", "t1", T0, "high"), ("a", " T1 ", None, ""), ("b", "x", T0 - timedelta(days=40), "low"), ("b", "y", None, None), ("b", None, None, None)]
    a = spark.createDataFrame(rowset, "source_id string, title string, published_at timestamp, date_confidence string")
    st = status.source_status(a, s, "2022-02-15T00:00:00Z", "2022-03-02T00:00:00Z")
    got = {r["source_id"]: r for r in st.collect()}
    assert (got["a"]["raw"], got["a"]["undated_ratio"], got["a"]["unique_title_ratio"], got["a"]["parse_status"], got["a"]["lag_days"]) == (2, 0.5, 0.5, "attention", 1.0)
    assert (got["b"]["parse_status"], got["b"]["freshness_status"]) == ("exception", "stale")
    assert (got["empty"]["raw"], got["empty"]["parse_status"], got["empty"]["freshness_status"], got["empty"]["unique_title_ratio"]) == (0, "empty", "unknown", 1.0)
    gate = status.quality_gate(st, status.date_quality(a), {"max_empty": 0, "min_date": 0.5, "min_critical_date": 0.3, "min_high": 0.9}).first()
    # the critical rate is the mean of 0.5 and 0, the overall rate 2 of 5
    assert gate["critical_rate"] == 0.25 and gate["date_rate"] == 0.4
    assert gate["failures"] == "EMPTY_SOURCE_LIMIT_EXCEEDED,OVERALL_DATE_RATE_LOW,CRITICAL_DATE_RATE_LOW,HIGH_CONFIDENCE_DATE_RATE_LOW"
    none = status.quality_gate(st.limit(0), status.date_quality(a.limit(0)), {"min_source_success": 0.5, "min_date": 0.5, "min_high": 0.5}).first()
    assert none["failures"] == "SOURCE_SUCCESS_RATE_LOW"


def test_future_dates(spark):
    a = spark.createDataFrame([(T0 + timedelta(hours=23), "high"), (T0 + timedelta(hours=25), "high"), (T0 + timedelta(days=9), " LOW "), (None, None)], "published_at timestamp, date_confidence string")
    got = rows(status.without_future(a, F.lit(T0)).select("future", "unexplained", F.col("published_at").isNull(), "date_confidence"))
    assert got == sorted([(False, False, False, "high"), (True, True, True, "invalid"), (True, False, True, "invalid"), (False, False, True, None)], key=str)


def test_run_status_and_error_codes(spark):
    h = spark.createDataFrame([(False, True, "healthy"), (False, True, "attention")], "critical boolean, success boolean, health_status string")
    ok = spark.createDataFrame([("",)], "failures string")
    assert status.run_status(h, ok).first()[0] == "attention" and status.run_status(h.limit(1), ok).first()[0] == "complete"
    assert status.run_status(h, ok.replace("", "X")).first()[0] == "degraded" and status.run_status(h.limit(0), ok, translated=0.5).first()[0] == "attention"
    assert status.state_may_be_written(h, ok).first()[0]
    e = spark.createDataFrame([(["RobotsDeniedError: x"], False, True), (["ChallengePageError"], False, False), (None, False, True), ([], False, False), (None, True, True)], "e array<string>, s boolean, t boolean")
    assert [r[0] for r in e.select(status.error_code(F.col("e"), F.col("s"), F.col("t"))).collect()] == ["ROBOTS_DENIED", "HTTP_CHALLENGE", "PARSE_EMPTY", "FETCH_FAILED", ""]


def test_discovery_of_directory_links(spark):
    pages = spark.createDataFrame([("https://dir.eu/list", "<a href='https://new.de/news?x'>New</a><a href='/own'>Own</a><a href='https://www.old.de/other'>Known host</a><a href='https://far.us/'>Far</a><a href='https://new.de/news/'>Again</a>"), ("https://dir.eu/two", "<a href='https://sub.new.de/x'>Sub</a><a href='https://new.de/news'>New</a>"), ("https://dir.eu/none", None)], "url string, body string")
    domains = spark.createDataFrame([("new.de", 0, "DE"), ("old.de", 1, "DE")], "domain string, pos int, country string")
    known = spark.createDataFrame([("https://old.de/start",)], "url string")
    got = {r["url_key"]: (r["country"], r["discovered_from"]) for r in audit.discover(pages, domains, known).collect()}
    assert got == {"new.de/news": ("DE", ["https://dir.eu/list", "https://dir.eu/two"]), "sub.new.de/x": ("DE", ["https://dir.eu/two"])}


def test_kept_profiles(spark):
    p = spark.createDataFrame([(str(i), i) for i in range(40)], "fingerprint string, updated_at int")
    kept, archived = health.retained_profiles(p)
    assert sorted(r["updated_at"] for r in kept.collect()) == list(range(32, 40)) and sorted(r["updated_at"] for r in archived.collect()) == list(range(24))


def history(spark, counts, source="s", fails=()):
    return spark.createDataFrame([(source, i, c > 0, c, i in fails) for i, c in enumerate(counts)], "source_id string, at int, success boolean, raw_count int, failed boolean")


def test_a_drop_against_the_trailing_median(spark):
    h = health.trailing(history(spark, [20, 24, 22, 2])).withColumns({"critical": F.lit(False), "observation_runs": F.lit(3)})
    last = health.states(h).orderBy("at").collect()[-1]
    assert last["median_count"] == 22 and last["dropped"] and last["health_status"] == "attention"


@pytest.mark.parametrize(("critical", "before", "want"), [(True, 0, "attention"), (True, 1, "degraded"), (False, 1, "attention"), (False, 2, "degraded")])
def test_streaks_degrade(spark, critical, before, want):
    n = 6
    h = health.trailing(history(spark, [20] * (n - 1) + [1], fails=range(n - 1 - before, n - 1))).withColumns({"critical": F.lit(critical), "observation_runs": F.lit(3)})
    last = health.states(h).orderBy("at").collect()[-1]
    assert (last["failures_before"], last["health_status"]) == (before, want)


def test_slow_sources_only_alert(spark):
    h = history(spark, [20] * 6).withColumn("duration_seconds", F.when(F.col("at") == 5, 30.0).otherwise(10.0))
    rows_ = health.states(health.performance(health.trailing(h), ("duration_seconds",)).withColumns({"critical": F.lit(True), "observation_runs": F.lit(3)})).orderBy("at").collect()
    assert rows_[-1]["slow"] and not rows_[-1]["failed_now"] and rows_[-1]["health_status"] == "attention" and rows_[2]["health_status"] == "healthy"


def test_assessment_leaves_out_its_own_observation(spark):
    h = history(spark, [20, 24, 22]).withColumns({"fingerprint": F.lit("f"), "observation_key": F.concat(F.lit("k"), F.col("at"))})
    now = spark.createDataFrame([("s", "f", "k2", 9, True, 2, False, 2)], "source_id string, fingerprint string, observation_key string, at int, success boolean, raw_count int, critical boolean, observation_runs int")
    got = health.assess(now, h).first()
    assert (got["counts"], got["median_count"], got["health_status"]) == (2, 22.0, "attention")


def test_promotion_streak(spark):
    runs = [("s", "1", 1, "a", True), ("s", "2", 2, "a", False), ("s", "3", 3, "b", True), ("s", "4", 4, "b", False), ("s", "4", 5, "b", True), ("s", "6", 6, "b", True), ("t", "1", 1, "a", True)]
    df = spark.createDataFrame(runs, "source_id string, run_id string, at int, fingerprint string, qualifies boolean")
    assert rows(health.qualifying_streak(df)) == [("s", 5, 3, True), ("t", 1, 1, False)]


def test_interval_coverage(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 7, 12), ("b", 0, 4), ("b", 5, 12), ("c", 3, 12), ("d", -9, -5), ("d", 0, 12)], "g string, start long, end long")
    assert rows(health.interval_coverage(i, 1, 10, ["g"])) == [("a", 10, True), ("b", 4, False), ("c", 1, False), ("d", 10, True)]


def test_inventory_merge_and_limit(spark):
    old = spark.createDataFrame([("https://www.a.eu/x", ["p"], "d1", "d2")], "url string, discovered_from array<string>, first_seen_at string, last_seen_at string")
    new = spark.createDataFrame([("https://a.eu/x/?q", ["o"]), ("https://b.eu/", ["p"]), ("https://c.eu/", ["p"])], "url string, discovered_from array<string>")
    got = {r["url_key"]: r for r in relations.candidate_inventory(old, new, "d3", limit=2).collect()}
    assert set(got) == {"a.eu/x", "b.eu/"}
    assert got["a.eu/x"]["discovered_from"] == ["o", "p"] and got["a.eu/x"]["first_seen_at"] == "d1" and got["a.eu/x"]["last_seen_at"] == "d3"


def test_eviction_keeps_the_newest(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(hours=7 * i), 10) for i in range(20)], "id long, at timestamp, size long")
    assert sorted(r["id"] for r in relations.evicted(df, "size", 55, ["at", "id"]).collect()) == [15, 16, 17, 18, 19]


def test_joins_that_are_not_plain(spark):
    hosts = spark.createDataFrame([("a.b.eu",), ("b.eu",), ("xb.eu",)], "host string")
    domains = spark.createDataFrame([("b.eu", 1), ("a.b.eu", 0)], "domain string, pos int")
    assert rows(relations.suffix_join(hosts, "host", domains)) == [("a.b.eu", "a.b.eu"), ("b.eu", "b.eu"), ("xb.eu", None)]
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, x string, y int")
    e = spark.createDataFrame([(1, "a", 1), (2, "z", None), (4, "c", 3)], "k int, x string, y int")
    assert rows(relations.differences(d, e, "k", ["x", "y"])) == [(2, "x,y"), (3, "missing"), (4, "extra")]
    pr = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, f boolean")
    assert rows(relations.precision_recall(pr, "t", "f")) == [(1, 1, 1, 0.5, 0.5)]


def test_date_choice_prefers_priority_then_the_later(spark):
    c = spark.createDataFrame([(1, 0, 10, "time-element", "high", 0, "UTC"), (1, 1, 11, "json-ld", "high", 86_400_000_000, "UTC"), (1, 2, 12, "json-ld", "high", 90_000_000_000, "UTC"), (2, 0, 13, "title-text", "low", 0, "UTC"), (2, 1, 14, "time-element", "high", 99 * 86_400_000_000, None), (3, 0, 15, "json-ld", "high", None, "UTC")], "article_id long, cand_pos int, candidate_id long, date_source string, confidence string, utc_micros long, zone string")
    got = {r["article_id"]: (r["candidate_id"], r["readable"], r["conflict"]) for r in relations.date_choice(c, relations.DATE_SOURCES).collect()}
    assert got == {1: (12, 3, True), 2: (14, 2, False)}


def test_translation_with_injected_providers(spark):
    a = spark.createDataFrame([(1, "de", "Haus"), (2, "de", "Haus"), (3, "fr", "Maison"), (4, "xx", "中文"), (5, "de", "Fehler")], "article_id long, language string, title string")
    cache = spark.createDataFrame([(None, "Maison", "房子")], "language string, title string, title_zh_tw string")

    def broken(title, language):
        raise RuntimeError

    words = {"Haus": "房屋"}
    out, answers = translate.translate_titles(a, cache, [("broken", broken), ("words", lambda t, lang: words.get(t))])
    assert rows(out.select("article_id", "title_zh_tw", "translated_by")) == [(1, "房屋", "words"), (2, "房屋", "words"), (3, "房子", "cache"), (4, "中文", "original"), (5, "", "none")]
    assert rows(translate.provider_stats(answers)) == [("broken", 2, 0, 2), ("words", 2, 1, 1)]
    issues = spark.createDataFrame([("Haus NIS2", "error")], "s string, t string").select(translate.quality_issues(F.col("s"), F.col("t"), ["NIS2"])).first()[0]
    assert issues == ["not_traditional_chinese_translation", "missing_terms:NIS2", "provider_error_text"]


def test_pages_that_must_not_be_parsed(spark):
    df = spark.createDataFrame([("<html>" + "x" * 200,), ("",), (None,), ("x",), ("<title>Access denied</title>" + "x" * 99,), ("Just a moment... Checking your browser" + "x" * 99,)], "b string")
    assert [r[0] for r in df.select(audit.content_error(F.col("b"), F.lit(50))).collect()] == [None, "empty", "empty", "undersized", "challenge_page", "challenge_page"]
