"""The composed flows: articles from landed payloads, a collection run over articles and their date candidates, and a search over a saved corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.operators.classify import authority_level, classify, content_kind, overlay
from presswell.operators.dates import normalised_dates
from presswell.operators.dedupe import last_wins, merged
from presswell.operators.health import interval_coverage
from presswell.operators.lexicon import DEFAULT, Lexicon, Overlay
from presswell.operators.periods import Period
from presswell.operators.rank import MINIMUM, rank, relevant
from presswell.operators.relations import DATE_SOURCES, containing, date_choice, detail_candidates, output_order
from presswell.operators.status import date_quality, in_range, quality_gate, source_status, without_future
from presswell.sources.feeds import rss, within_policy, wordpress
from presswell.sources.listings import parse_details, parse_listings
from presswell.tables import work_table


@dataclass(frozen=True)
class Run:
    """The results of a collection run: everything parsed and merged, what is relevant in the period, and the reports."""

    corpus: DataFrame
    selected: DataFrame
    status: DataFrame
    gate: DataFrame


def feed_and_listing(feed: DataFrame, listing: DataFrame) -> DataFrame:
    """Parsed items of feeds and of listings as one list: per source, all of its feeds come before its listings (stage)."""
    columns = ["source_id", "pos", "title", "url", "summary", "raw_date", "date_source", "date_confidence", "fetched_via"]
    return feed.select(*columns, F.lit(0).alias("stage")).unionByName(listing.select(*columns, F.lit(1).alias("stage")))


def in_list_order(items: DataFrame, sources: DataFrame) -> DataFrame:
    """items with article_id, their place in the list of a run: by source, stage and page, then position on the page.

    The order of the sources is their column ord, else that of their ids. Places leave gaps, so nothing is numbered over
    all items: sources and pages are, and the items of each page; a page that was landed twice has all its items one after
    the other, so places are unique. They lie within one run of the entity windows.
    """
    stage = items if "stage" in items.columns else items.withColumn("stage", F.lit(0))
    by = "ord" if "ord" in sources.columns else "lower(id), id"
    at = sources.select(F.col("id").alias("source_id"), F.expr(f"row_number() over (order by {by})").alias("_s")).dropDuplicates(["source_id"])
    pages = stage.select("source_id", "stage", "fetched_via").distinct().withColumn("_p", F.expr("row_number() over (partition by source_id order by stage, fetched_via)"))
    placed = stage.join(at, "source_id").join(pages, ["source_id", "stage", "fetched_via"])
    ties = [c for c in ("url", "title") if c in items.columns]
    placed = placed.withColumn("_i", F.expr(f"row_number() over (partition by source_id, stage, fetched_via order by {', '.join(['pos', *ties])}) - 1"))
    return placed.withColumn("article_id", (F.col("_s").cast("long") * (1 << 20) + F.col("_p")) * (1 << 20) + F.col("_i")).drop("_s", "_p", "_i")


def dated(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed items (source_id, pos, url, title, summary, raw_date, date_confidence …) as articles with instants, in list order."""
    own = sources.select(F.col("id").alias("source_id"), "country", F.col("name_zh").alias("source_name"), "institution_type", "language", "timezone").dropDuplicates(["source_id"])
    rows = in_list_order(items, sources).join(own, "source_id").withColumn("raw_value", F.col("raw_date"))
    read = normalised_dates(rows, sources)
    return read.withColumns({"published_at": F.timestamp_micros("utc_micros"), "date_confidence": F.when(F.col("utc_micros").isNull(), "low").otherwise(F.col("date_confidence")), "discovered_by": F.array("source_id"), "alternate_urls": F.array().cast("array<string>")})


def with_details(articles: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """articles after a look at their own pages (url, body): longer titles and summaries, and dates that were missing."""
    read = work_table(parse_details(pages), "details")
    texts = read.groupBy("url").agg(F.max("title").alias("_title"), F.max("summary").alias("_summary"))
    ids = articles.select("url", "article_id", "source_id")
    candidates = read.filter("pos >= 0").join(ids, "url").select(F.xxhash64("article_id", "pos").alias("candidate_id"), "article_id", F.col("pos").alias("cand_pos"), "source_id", F.col("raw_date").alias("raw_value"), F.lit(None).cast("string").alias("timezone"), "date_source", F.col("date_confidence").alias("confidence"))
    longer = lambda own, new: F.when(F.length(F.coalesce(new, F.lit(""))) > F.length(F.coalesce(own, F.lit(""))), F.col(new)).otherwise(F.col(own))
    found = articles.join(texts, "url", "left").withColumns({"title": longer("title", "_title"), "summary": longer("summary", "_summary")})
    return resolved(found.select(*articles.columns), candidates, sources)


def scrape(feeds: DataFrame, listings: DataFrame, details: DataFrame, sources: DataFrame, period: Period, observed: str) -> DataFrame:
    """Articles from landed payloads (source_id, url, body): feeds, listing pages and articles' own pages.

    Feeds and listings are parsed and united, addresses that a source doesn't allow dropped, dates read, dates in the future
    taken out; of each source, as many own pages as its quota allows then complete what is missing. collect goes on from here.
    """
    items = feed_and_listing(rss(feeds).unionByName(wordpress(feeds)), parse_listings(listings, sources))
    found = work_table(without_future(dated(within_policy(items, sources), sources), F.lit(observed).cast("timestamp")), "scraped")
    wanted = detail_candidates(found, sources, period.since.isoformat(), period.until.isoformat()).select("url").distinct()
    return with_details(found, details.join(wanted, "url", "left_semi"), sources)


def resolved(articles: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """articles whose missing published_at is the chosen one of their date candidates, with that candidate's confidence.

    Where none of the candidates can be read, the confidence is low. Known dates stay, and their candidates are not read.
    """
    undated = articles.filter("published_at is null").select("article_id")
    own = candidates.join(undated, "article_id", "left_semi")
    zones = sources.select(F.col("id").alias("source_id"), F.col("timezone").alias("zone")).dropDuplicates(["source_id"])
    read = normalised_dates(own, sources).join(zones, "source_id", "left")
    sure = read.select("candidate_id", F.col("confidence").alias("_sure")).dropDuplicates(["candidate_id"])
    chosen = date_choice(read, DATE_SOURCES).join(sure, "candidate_id", "left").select("article_id", F.timestamp_micros("utc_micros").alias("_at"), "_sure")
    tried = read.filter(F.trim("raw_value") != "").select("article_id").distinct()
    found = tried.join(chosen, "article_id", "left").select(F.col("article_id").alias("_id"), "_at", F.when(F.col("_at").isNull(), "low").otherwise(F.col("_sure")).alias("_sure"))
    found = work_table(found, "resolved")
    open_ = F.col("published_at").isNull() & F.col("_id").isNotNull()
    rows = articles.join(found, F.col("article_id") == F.col("_id"), "left")
    return rows.withColumns({"published_at": F.coalesce("published_at", "_at"), "date_confidence": F.when(open_, F.col("_sure")).otherwise(F.col("date_confidence"))}).select(*articles.columns)


def analysed(articles: DataFrame, lexicon: Lexicon = DEFAULT, profile: Overlay | None = None) -> DataFrame:
    """Articles with topics, scores, kind of content and level of authority."""
    out = classify(articles, lexicon)
    if profile is not None:
        out = overlay(out, profile)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return out.withColumns({"content_kind": content_kind(text), "authority_level": authority_level(F.col("institution_type"))})


def collect(articles: DataFrame, sources: DataFrame, period: Period, observed: str, modules: DataFrame | None = None, lexicon: Lexicon = DEFAULT, profile: Overlay | None = None, limits: dict[str, float] | None = None) -> Run:
    """Merge, classify and rank parsed articles, their dates resolved; statistics cover all of them, the selection only the period."""
    since, until = period.since.isoformat(), period.until.isoformat()
    clean = without_future(articles, F.lit(observed).cast("timestamp"))
    status = source_status(clean, sources, since, until)
    one = merged(clean).withColumnRenamed("entity", "article_id")
    one = one.join(sources.select(F.col("id").alias("source_id"), "institution_type", F.col("name_zh").alias("source_name")).dropDuplicates(["source_id"]), "source_id", "left")
    corpus = work_table(rank(analysed(one, lexicon, profile), modules, lexicon), "corpus")
    selected = relevant(corpus).filter(in_range(F.col("published_at"), since, until)).orderBy(*output_order(corpus, since))
    return Run(corpus, selected, status, quality_gate(status, date_quality(selected), limits or {}))


def search(corpus: DataFrame, period: Period, source_ids: list[str] | DataFrame, modules: DataFrame | None = None, lexicon: Lexicon = DEFAULT, profile: Overlay | None = None, topics: list[str] | None = None, minimum: float = MINIMUM) -> DataFrame:
    """Relevant corpus rows of a period and some sources, newest first; scores come anew, from these rows alone.

    Published dates of a corpus are ISO texts in UTC, so that the period is a range of texts and reaches the scan. Of
    several rows with one url, the last by (file, line) counts. An empty list of sources finds nothing; sources may be a
    table with source_id as well.
    """
    since, until = period.since.isoformat(), period.until.isoformat()
    rows = corpus.filter((F.col("published_at") >= since) & (F.col("published_at") < until))
    if isinstance(source_ids, DataFrame):
        rows = rows.join(source_ids.select("source_id"), "source_id", "left_semi")
    else:
        rows = rows.filter(F.col("source_id").isin(*source_ids) if source_ids else F.lit(False))
    rows = last_wins(rows, ["url"], ["file", "line"]).drop("first_at")
    rows = rows.withColumns({"article_id": F.xxhash64("url"), "published_at": F.col("published_at").cast("timestamp")})
    found = relevant(rank(analysed(rows, lexicon, profile), modules, lexicon, minimum), minimum)
    if topics:
        found = found.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    return found.orderBy(F.col("published_at").desc(), F.col("url").asc())


def search_coverage(manifests: DataFrame, wanted: DataFrame, period: Period) -> DataFrame:
    """covered_to and complete: whether the runs that succeeded for all wanted sources cover the period.

    manifests: run_id, start, end (microseconds), complete, passed, source_id, ok – one row per run and source.
    """
    good = manifests.filter("complete and passed and ok")
    runs = containing(good, "run_id", "source_id", wanted)
    spans = good.join(runs, "run_id", "left_semi").select("run_id", F.col("start"), F.col("end")).distinct()
    micros = lambda t: int(t.timestamp() * 1_000_000)
    return interval_coverage(spans, micros(period.since), micros(period.until))
