"""Articles without a date get it from their candidates before a run or a search looks at the period."""

import os

import pytest
from pyspark.sql import functions as F

from presswell.operators.dates import normalised_dates
from presswell.operators.relations import DATE_SOURCES
from presswell.plans import pipeline, queries
from presswell.tables import read_table


def test_resolved_dates_against_brute_force(spark, data):
    articles, candidates, sources = (read_table(spark, data, t) for t in ("articles", "date_candidates", "sources"))
    per = {}
    for r in normalised_dates(candidates, sources).collect():
        per.setdefault(r["article_id"], []).append(r)
    want = {}
    for a in articles.select("article_id", F.unix_micros("published_at").alias("at"), "date_confidence").collect():
        at, sure = a["at"], a["date_confidence"]
        if at is None and any((r["raw_value"] or "").strip(" ") for r in per.get(a["article_id"], [])):
            readable = [r for r in per[a["article_id"]] if r["utc_micros"] is not None]
            best = max(readable, key=lambda r: (DATE_SOURCES.get(r["date_source"], 0), r["cand_pos"], r["candidate_id"]), default=None)
            at, sure = (best["utc_micros"], best["confidence"]) if best else (None, "low")
        want[a["article_id"]] = (at, sure)
    got = pipeline.resolved(articles, candidates, sources).select("article_id", F.unix_micros("published_at").alias("at"), "date_confidence").collect()
    assert {r["article_id"]: (r["at"], r["date_confidence"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("query", ["collection_run", "search_results"])
def test_a_date_that_only_a_candidate_has_counts(spark, data, tmp_path, query):
    run = getattr(queries, query)
    expected = sorted(map(tuple, run(spark, data).collect()))
    urls = {r["url"] for r in run(spark, data).select("url").collect()}
    assert expected
    for name in ("sources", "documents"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    articles, candidates = read_table(spark, data, "articles"), read_table(spark, data, "date_candidates")
    hit = F.col("url").isin(*urls) & F.col("published_at").isNotNull()
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    own = articles.filter(hit).select((-F.col("article_id")).alias("candidate_id"), "article_id", F.lit(0).alias("cand_pos"), "source_id", iso.alias("raw_value"), F.lit(None).cast("string").alias("timezone"), F.lit("json-api").alias("date_source"), F.col("date_confidence").alias("confidence"))
    candidates.join(own, "article_id", "left_anti").unionByName(own).write.parquet(str(tmp_path / "date_candidates.parquet"))
    articles.withColumn("published_at", F.when(~F.coalesce(hit, F.lit(False)), F.col("published_at"))).write.parquet(str(tmp_path / "articles.parquet"))
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == expected
