from pyspark.sql import functions as F

from presswell.functions import text as t
from presswell.functions import urls as u
from presswell.operators import classify, rank, relations
from presswell.operators.lexicon import Overlay, OverlayTopic, Term, load_overlay

import json

import pytest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_normalised_text_and_tokens(spark):
    assert one(spark, " ＮＩＳ２ –  Straße’s x ", t.normalised) == t.normalise(" ＮＩＳ２ –  Straße’s x ") == "nis2 - strasse's x"
    assert one(spark, "The state-of-the-art AI and die KI für Énergie_x", lambda c: t.tokens(t.normalised(c))) == ["state-of-the-art", "ai", "ki", "énergie", "x"]
    assert one(spark, None, t.normalised) is None


def test_canonical_urls(spark):
    assert u.canonical("HTTPS://Example.eu/news/a/?utm_source=x&id=2#top") == "https://example.eu/news/a?id=2"
    assert u.canonical("https://e.eu?b=2&a=1&GCLID=3") == "https://e.eu/?b=2&a=1"
    assert u.canonical("https://e.eu//x//?b=2&a=1&fbclid=3", sort_query=True, tracking=()) == "https://e.eu/x?a=1&b=2&fbclid=3"
    assert u.canonical(None) is None and u.canonical("http://[x") == "http://[x"
    rows = spark.createDataFrame([("HTTPS://A.eu/x/",), (None,), ("",)], "v string").select(u.canonical_url("v")).collect()
    assert [r[0] for r in rows] == ["https://a.eu/x", None, "/"]
    assert one(spark, "https://www.A.eu/f%C3%BCr/?q=1", u.identity_key) == "a.eu/für"


def test_url_policy(spark):
    rows = spark.createDataFrame([("https://www.a.eu/news/1", True), ("https://xa.eu/news/1", False), ("ftp://a.eu/news/1", False), ("https://a.eu/NEWS/archive/1", False), ("https://a.eu/other", False), (None, False)], "u string, want boolean")
    got = rows.select("want", u.allowed_url(F.col("u"), F.array(F.lit("a.eu")), F.array(F.lit("/news/")), F.array(F.lit("/archive/"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    codes = {"https://a.eu/x": None, "http://a.eu": "https_required", "https://u:p@a.eu": "url_credentials", "https://a.eu:8443/": "malformed_url", "https://localhost/": "nonpublic_host", "https://10.0.0.1/": "nonpublic_host", "https://8.8.8.8/": None, "https://a b/": "malformed_url", "https://srv.internal/": "nonpublic_host"}
    rows = spark.createDataFrame([(k,) for k in codes], "u string").select("u", relations.unsafe_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == codes


def test_cells_and_small_helpers(spark):
    assert one(spark, "=1+1", t.safe_cell) == "'=1+1" and one(spark, "a\x00b", t.safe_cell) == "ab"
    assert one(spark, "x" * 600, t.shortened) == "x" * 499 + "…" and one(spark, "x" * 500, t.shortened) == "x" * 500
    assert one(spark, "{ab-cd}", t.guid) == "ABCD"
    assert one(spark, "https://u:p@a.eu/x?api_token=1&b=2#f", t.redacted_url) == "https://a.eu/x?api_token=[redacted]&b=2"
    assert one(spark, "« Next page »".replace("« ", ""), relations.is_navigation) is True and one(spark, "Seite 12", relations.is_navigation) is True and one(spark, "Next steps", relations.is_navigation) is False
    assert one(spark, "https://a.eu/x.PDF?y", relations.is_html_url) is False


ARTICLE = "article_id long, source_id string, country string, source_name string, institution_type string, language string, title string, summary string"


def articles(spark, *texts):
    return spark.createDataFrame([(i, "s", "DE", "n", "ministry", "en", a, b) for i, (a, b) in enumerate(texts)], ARTICLE)


def test_guarded_short_forms(spark):
    rows = classify.classify(articles(spark, ("CRA publishes its annual finance report", ""), ("CRA compliance for secure software products", None), (None, None), ("NIS2 and incident reporting", "supply chain, SBOM and a vulnerability"))).orderBy("article_id").collect()
    assert [r["topics"] for r in rows] == [[], ["PRODUCT"], [], ["NIS2", "PRODUCT", "SUPPLY"]]
    assert [r["score"] for r in rows] == [0, 2, 0, 4 + (2 + 2) + 1]  # product and supply words are hits of one rule
    assert [r["confidence"] for r in rows] == ["未命中", "中", "未命中", "高"]
    assert rows[1]["keywords"] == ["CRA"]


def test_signals_and_defaults(spark):
    rows = classify.classify(articles(spark, ("GDPR and digital identity", ""), ("A quantum chip production", ""), ("The gatekeeper", ""))).orderBy("article_id").collect()
    assert [r["topics"] for r in rows] == [["IDENTITY", "PRIVACY"], ["CHIPS", "QUANTUM"], ["COMPETITION"]]


def test_overlay(spark):
    o = Overlay((OverlayTopic("NIS2", (Term("reporting", 5, "en", "r"), Term("incident reporting", 3, "*", "r")), (Term("duty"),), (Term("draft"),), (Term("sport"),)), OverlayTopic("new", (Term("zebra", 2.5, "fr"), Term("lion", 2.5)))))
    base = classify.classify(articles(spark, ("NIS2 incident reporting duty", ""), ("nis2 draft", ""), ("nis2 reporting sport lion", ""), ("zebra", ""), ("nothing", "")))
    rows = classify.overlay(base, o).orderBy("article_id").collect()
    assert [r["topics"] for r in rows] == [["NIS2"], [], ["new"], [], []]
    assert [r["score"] for r in rows] == [7, 0, 2, 0, 0]
    assert rows[1]["keywords"] == [] and set(rows[0]["keywords"]) >= {"nis2", "incident reporting", "reporting", "duty"}


def test_overlay_files(tmp_path):
    p = tmp_path / "o.json"
    p.write_text("﻿" + json.dumps({"schema_version": 2, "mode": "merge", "remove_topics": ["a"], "topics": [{"name": "b", "keywords": [{"term": "x", "weight": 2}], "synonyms": ["y"]}]}), encoding="utf-8")
    base = Overlay((OverlayTopic("a"), OverlayTopic("c")))
    assert [x.name for x in load_overlay(p, base).topics] == ["c", "b"]
    for bad in ({"schema_version": 3, "topics": []}, {"schema_version": 1, "topics": [{"name": "a", "keywords": [{"term": "x", "weight": 0}]}]}, {"schema_version": 2, "mode": "merge", "remove_topics": ["zz"], "topics": []}):
        p.write_text(json.dumps(bad), encoding="utf-8")
        with pytest.raises((ValueError, KeyError)):
            load_overlay(p, base)


def test_ranking_with_modules(spark):
    a = classify.classify(articles(spark, *[("Artificial intelligence rules", "artificial intelligence act"), ("Open data", "A report on open data"), ("x", "y"), *[("other news", "words")] * 6]))
    modules = spark.createDataFrame([("s", ["AI"], {"AI": "office"})], "source_id string, allowed array<string>, owners map<string,string>")
    rows = rank.rank(a, modules).orderBy("article_id").collect()
    assert rows[0]["topics"] == ["AI"] and rows[0]["responsibility_owner"] == ["office"] and rows[0]["bm25"] > 0.15
    assert rows[1]["topics"] == [] and rows[1]["boolean_score"] == 0 and rows[1]["confidence"] == "未命中"
    free = rank.rank(a).orderBy("article_id").collect()
    assert free[1]["topics"] == ["DATA"] and free[1]["responsibility_owner"] == ["未設定"]
    assert {r["article_id"] for r in rank.relevant(rank.rank(a)).collect()} == {0, 1}
    assert rank.rank(a.limit(0)).count() == 0


def test_bm25_equals_the_formula(spark):
    import math

    docs = [(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "c", "c", "c"])]
    d = spark.createDataFrame(docs, "id long, words array<string>").withColumn("length", F.size("words"))
    q = spark.createDataFrame([("t", "a"), ("t", "b")], "topic string, term string")
    got = {r["id"]: r["score"] for r in rank.bm25(d, q, ["a", "b"]).collect()}
    n, mean = 3, 8 / 3
    w = lambda tf, df, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == {1: round(w(2, 1, 3) + w(1, 2, 3), 4), 2: round(w(1, 2, 1), 4)}
