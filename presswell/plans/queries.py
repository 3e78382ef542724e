"""Queries of the core operators, each over whole tables. Where SQL can say the same, oracles.py does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.functions import text as t
from presswell.functions import urls as u
from presswell.operators import audit, classify, dates, dedupe, health, rank, relations, status
from presswell.operators.lexicon import Overlay, OverlayTopic, Term
from presswell.operators.periods import calendar_day_column, date_language, resolve_period
from presswell.plans import pipeline
from presswell.sinks import articles as sink
from presswell.sinks import reports
from presswell.sources import config, feeds, listings
from presswell.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
SINCE, UNTIL, OBSERVED = "2022-02-01T00:00:00Z", "2022-03-01T00:00:00Z", "2022-03-01T00:00:00Z"

#: The topics of the flagship query.
FLAGSHIP = {"cloud": ["cloud", "nuages", "rechenzentren", "nube"], "identity": ["identity", "identité", "ausweis", "identidad"], "supply": ["supply", "chains", "lieferketten", "cadenas", "approvisionnement"]}
OVERLAY = Overlay(
    (
        OverlayTopic("cloud", (Term("cloud security", 3, "en", "cloud"), Term("sichere rechenzentren", 3, "de", "cloud"), Term("working group", 1)), (Term("programme"),), (Term("complaints"),), (Term("advisory"),)),
        OverlayTopic("NIS2", (Term("incident reporting", 2, "en"),), (), (), (Term("lorem ipsum"),)),
        OverlayTopic("money", (Term("million euros", 2, "en", "sum"), Term("millions d'euros", 2, "fr", "sum")), (Term("fine"),), (), (), True, None, False),
    )
)
LIMITS = {"min_source_success": 0.95, "min_parse_success": 0.95, "max_empty": 0, "min_date": 0.75, "min_critical_date": 0.95, "max_future": 0, "min_high": 0.75, "max_conflict": 0.05}


def _articles(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "articles")


def _sources(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "sources")


def _joined(*values: Column) -> list[Column]:
    return [F.array_join(v, "|") for v in values]


# ranking and classification


def flagship_bm25(s: SparkSession, d: str) -> DataFrame:
    words = t.tokens(F.lower(F.coalesce("text", F.lit(""))))
    docs = spread(read_table(s, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), words.alias("words")).withColumn("length", F.size("words"))
    query = s.createDataFrame([(k, w) for k, ws in FLAGSHIP.items() for w in ws], "topic string, term string")
    scores = rank.bm25(docs, query, [w for ws in FLAGSHIP.values() for w in ws])
    return scores.filter(F.col("score") >= rank.MINIMUM).select(F.col("id").alias("doc_id"), "topic", "score")


def bm25_statistics(s: SparkSession, d: str) -> DataFrame:
    words = t.tokens(F.lower(F.coalesce("text", F.lit(""))))
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), words.alias("words")).withColumn("length", F.size("words"))
    tf = rank.term_frequencies(docs, [w for ws in FLAGSHIP.values() for w in ws])
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return df.join(F.broadcast(rank.corpus_size(docs))).select("term", "df", "tf", "n", F.round("average", 4).alias("average"))


def topic_scores(s: SparkSession, d: str) -> DataFrame:
    out = classify.classify(_articles(s, d))
    topics, keywords = _joined(F.array_sort("topics"), F.array_sort("keywords"))
    return out.select("article_id", topics.alias("topics"), keywords.alias("keywords"), "score", "confidence")


def overlay_scores(s: SparkSession, d: str) -> DataFrame:
    out = classify.overlay(classify.classify(_articles(s, d)), OVERLAY)
    topics, keywords = _joined("topics", F.array_sort("keywords"))
    return out.filter("score > 0").select("article_id", topics.alias("topics"), keywords.alias("keywords"), "score", "confidence")


def topic_counts(s: SparkSession, d: str) -> DataFrame:
    out = classify.classify(_articles(s, d))
    return out.select(F.explode("topics").alias("topic"), "score").groupBy("topic").agg(F.count(F.lit(1)).alias("articles"), F.sum("score").alias("score"))


def content_kinds(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return _articles(s, d).select("article_id", classify.content_kind(text).alias("content_kind"), classify.authority_level(F.col("institution_type")).alias("authority_level"))


def _modules(s: SparkSession, d: str) -> DataFrame:
    """Allow-lists and owners made from the sources: data protection bodies and a few countries have their own."""
    allowed = F.when(F.contains("institution_type", F.lit("資料保護")), F.array(*map(F.lit, ("PRIVACY", "DATA", "IDENTITY")))).otherwise(F.array(*map(F.lit, ("AI", "NIS2", "PRODUCT", "SUPPLY", "PLATFORM", "CHIPS", "DATA", "IDENTITY"))))
    owners = F.create_map(F.lit("AI"), F.concat(F.lit("AI "), F.col("country")), F.lit("NIS2"), F.col("name"))
    return _sources(s, d).filter("country in ('EU', 'DE', 'FR', 'IE', 'AT')").select(F.col("id").alias("source_id"), allowed.alias("allowed"), owners.alias("owners"))


def ranked_articles(s: SparkSession, d: str) -> DataFrame:
    out = rank.rank(classify.classify(_articles(s, d)), _modules(s, d))
    topics, owners = _joined(F.array_sort("topics"), F.array_sort("responsibility_owner"))
    return rank.relevant(out).select("article_id", topics.alias("topics"), "boolean_score", "bm25", owners.alias("owners"), "confidence")


# addresses and predicates


def canonical_urls(s: SparkSession, d: str) -> DataFrame:
    return _articles(s, d).select("article_id", u.canonical_url("url").alias("canonical"), u.listing_url("url").alias("listing"))


def identity_keys(s: SparkSession, d: str) -> DataFrame:
    return _sources(s, d).select("id", u.identity_key(F.col("homepage")).alias("home"), u.identity_key(F.col("listing_url")).alias("listing"))


def url_policy(s: SparkSession, d: str) -> DataFrame:
    items = _articles(s, d).select("article_id", "source_id", F.trim("url").alias("url"))
    kept = feeds.within_policy(items, _sources(s, d))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("allowed"))


def url_safety(s: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(relations.unsafe_url(F.col("url")), F.lit("ok"))
    return _articles(s, d).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def page_kinds(s: SparkSession, d: str) -> DataFrame:
    docs = read_table(s, d, "documents")
    return docs.groupBy(relations.is_html_url(F.col("url")).alias("html"), F.coalesce(relations.is_navigation(F.col("title")), F.lit(False)).alias("navigation")).agg(F.count(F.lit(1)).alias("n"))


def redacted_urls(s: SparkSession, d: str) -> DataFrame:
    return _articles(s, d).select("article_id", t.redacted_url(t.strip(F.col("url"))).alias("redacted"))


def selected_sources(s: SparkSession, d: str) -> DataFrame:
    return relations.selected_sources(_sources(s, d), ["DE", "FR", "EU"]).select("id", "country")


def period_articles(s: SparkSession, d: str) -> DataFrame:
    p = resolve_period("2022-02-14", "1110220")
    inside = status.in_range(F.col("published_at"), p.since.isoformat(), p.until.isoformat())
    return _articles(s, d).filter(inside).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("published_at")).alias("first"), F.unix_micros(F.max("published_at")).alias("last"))


def future_dates(s: SparkSession, d: str) -> DataFrame:
    rows = status.without_future(_articles(s, d), F.lit("2022-02-25T00:00:00Z").cast("timestamp"))
    return rows.groupBy("source_id").agg(F.count_if("future").alias("future"), F.count_if("unexplained").alias("unexplained"), F.count("published_at").alias("dated"))


def calendar_days(s: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    roc = F.concat(F.format_string("%03d", F.year(day) - 1911), F.date_format(day, "MMdd"))
    back = calendar_day_column(F.when(F.col("o_orderkey") > 100, roc).otherwise(F.date_format(day, "yyyy/MM/dd")))
    return read_table(s, d, "orders").groupBy(back.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def date_texts(s: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_value")
    return read_table(s, d, "date_candidates").select("candidate_id", t.date_text(raw).alias("found"), t.precision(raw).alias("precision"))


def date_choices(s: SparkSession, d: str) -> DataFrame:
    sources = _sources(s, d)
    read = dates.normalised_dates(read_table(s, d, "date_candidates"), sources).join(sources.select(F.col("id").alias("source_id"), F.col("timezone").alias("zone")), "source_id", "left")
    return relations.date_choice(read, relations.DATE_SOURCES)


def sheet_cells(s: SparkSession, d: str) -> DataFrame:
    return _articles(s, d).select("article_id", t.safe_cell(F.col("title")).alias("title"), t.shortened(F.col("summary"), 200).alias("summary"))


def event_values(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read_table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("most"), F.count(k).alias("n"))


# status, quality and gates


def _status(s: SparkSession, d: str) -> DataFrame:
    return status.source_status(_articles(s, d), _sources(s, d), SINCE, UNTIL)


def source_status(s: SparkSession, d: str) -> DataFrame:
    return _status(s, d)


def run_summary(s: SparkSession, d: str) -> DataFrame:
    return status.run_summary(_status(s, d))


def date_quality(s: SparkSession, d: str) -> DataFrame:
    return status.date_quality(_articles(s, d))


def quality_gate(s: SparkSession, d: str) -> DataFrame:
    out = status.quality_gate(_status(s, d), status.date_quality(_articles(s, d)), LIMITS)
    return out.select(*[F.round(c, 6).alias(c) for c in ("source_rate", "parse_rate", "date_rate", "critical_rate", "high_rate")], "empty_sources", "failures")


def discovered_counts(s: SparkSession, d: str) -> DataFrame:
    return _articles(s, d).select(F.explode("discovered_by").alias("finder")).groupBy("finder").agg(F.count(F.lit(1)).alias("n"))


def parse_assessment(s: SparkSession, d: str) -> DataFrame:
    rows = _articles(s, d).withColumn("conflict", F.coalesce(F.col("published_at") > F.col("fetched_at"), F.lit(False)))
    return audit.parse_assessment(rows, F.lit("2022-02-25T00:00:00Z").cast("timestamp"))


def detail_quota(s: SparkSession, d: str) -> DataFrame:
    return relations.detail_candidates(_articles(s, d), _sources(s, d), SINCE, UNTIL).select("source_id", "article_id", "rank")


def serial_numbers(s: SparkSession, d: str) -> DataFrame:
    rows = _articles(s, d).withColumn("_t", F.coalesce("published_at", F.lit(SINCE).cast("timestamp")))
    return rows.select("source_id", "article_id", F.expr("row_number() over (partition by source_id order by _t desc, article_id)").alias("serial"))


# duplicates


def dedupe_entities(s: SparkSession, d: str) -> DataFrame:
    a = _articles(s, d)
    day = dedupe.utc_day(F.col("published_at")).cast("string")
    title = F.when((F.coalesce("title", F.lit("")) != "") & F.col("published_at").isNotNull(), F.concat_ws("|", F.lower("title"), day))
    keyed = a.select(F.col("article_id").alias("ord"), F.regexp_replace(F.lower(F.trim("url")), "[?#].*$", "").alias("url_key"), title.alias("title_key"))
    return dedupe.entities(keyed).select(F.col("ord").alias("article_id"), "entity")


def dedupe_merged(s: SparkSession, d: str) -> DataFrame:
    return dedupe.merged(_articles(s, d))


def first_by_url(s: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(_articles(s, d).select("source_id", "url", "article_id", "title"), ["source_id", "url"], ["article_id"])


def last_by_url(s: SparkSession, d: str) -> DataFrame:
    out = dedupe.last_wins(_articles(s, d).select("url", "article_id", "batch_no"), ["url"], ["article_id"])
    return out.select("url", "article_id", "batch_no", F.col("first_at.article_id").alias("first_at"))


# health over time


def _observations(s: SparkSession, d: str) -> DataFrame:
    day = read_table(s, d, "events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("raw_count"), F.sum("value").alias("value"), F.count_distinct("user_id").alias("request_count"))
    mean = "avg(value) over (partition by source_id)"
    return day.withColumns({"at": F.datediff("day", F.lit("2024-01-01")), "success": F.expr(f"value >= 0.6 * {mean}"), "failed": F.expr(f"value < 0.9 * {mean}")})


def health_trailing(s: SparkSession, d: str) -> DataFrame:
    rows = health.performance(health.trailing(_observations(s, d)), ("request_count",))
    return rows.select("source_id", "at", "raw_count", "median_count", "counts", "successes", "failures_before", "median_request_count")


def health_states(s: SparkSession, d: str) -> DataFrame:
    rows = health.trailing(_observations(s, d)).withColumns({"critical": F.col("source_id").isin("purchase", "error"), "observation_runs": F.lit(3)})
    return health.states(rows).select("source_id", "at", "failed_now", "health_status")


def health_retained(s: SparkSession, d: str) -> DataFrame:
    return health.retained(_observations(s, d)).select("source_id", "at", "raw_count")


def health_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = _observations(s, d).select("source_id", "at", "raw_count")
    new = rows.filter("at >= 20").withColumn("raw_count", F.col("raw_count") * 10)
    return health.appended_once(health.upsert(rows.filter("at < 25"), new.filter("at < 28"), ["source_id", "at"]), rows, ["source_id", "at"])


def qualifying_streaks(s: SparkSession, d: str) -> DataFrame:
    rows = _observations(s, d).select("source_id", F.col("at").alias("run_id"), "at", F.when(F.col("at") < 12, "a").otherwise("b").alias("fingerprint"), (~F.col("failed")).alias("qualifies"))
    return health.qualifying_streak(rows)


def latest_checks(s: SparkSession, d: str) -> DataFrame:
    out = health.latest(_articles(s, d).select("source_id", "batch_no", "article_id", "language"), ["source_id"], ["batch_no", "article_id"])
    return out.select("source_id", "batch_no", "article_id", "language")


def interval_coverage(s: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("long")
    rows = read_table(s, d, "orders").select("o_orderpriority", day.alias("start"), (day + 2).alias("end")).distinct()
    return health.interval_coverage(rows, 0, 2000, ["o_orderpriority"])


# joins, merges and sets


def coverage_matrix(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    owners = src.select(F.col("institution_type").alias("topic"), "country", F.col("id").alias("source_id"), F.when(F.col("critical"), F.lit("")).otherwise(F.col("name")).alias("owner"))
    return relations.coverage_matrix(src.select(F.col("institution_type").alias("topic")), src.select("country"), owners)


def unknown_sources(s: SparkSession, d: str) -> DataFrame:
    finders = _articles(s, d).select(F.explode("discovered_by").alias("source_id")).unionByName(read_table(s, d, "documents").select(F.lower("source").alias("source_id"))).unionByName(read_table(s, d, "article_copies").select(F.upper("source_id").alias("source_id")))
    return relations.unknown(finders, _sources(s, d).select(F.col("id").alias("source_id")), "source_id")


def registered_articles(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    pages = src.select("id", F.explode(F.concat(F.array("homepage", F.replace("listing_url", F.lit("https://www."), F.lit("http://"))), "feed_urls")).alias("url"))
    return audit.already_registered(pages, src).select("id", "url")


def host_domains(s: SparkSession, d: str) -> DataFrame:
    domains = _sources(s, d).select(F.posexplode("allow_domains").alias("pos", "domain")).groupBy("domain").agg(F.min("pos").alias("pos"))
    rows = _articles(s, d).select("article_id", u.host_of(F.trim("url")).alias("host"))
    return relations.suffix_join(rows, "host", domains).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def all_event_users(s: SparkSession, d: str) -> DataFrame:
    events = read_table(s, d, "events")
    return relations.containing(events, "user_id", "event_type", events.select("event_type"))


def title_lookup(s: SparkSession, d: str) -> DataFrame:
    a = _articles(s, d)
    first = a.filter("batch_no = 0 and title is not null")
    cache = first.filter("language is not null").select("language", "title", F.concat(F.lit("own "), F.col("source_id")).alias("value")).unionByName(first.select(F.lit(None).cast("string").alias("language"), "title", F.concat(F.lit("any "), F.col("source_id")).alias("value")))
    rows = a.filter("batch_no > 0").select("article_id", "language", "title")
    return relations.two_key_lookup(rows, cache, "language", "title", "value").filter("value is not null").select("article_id", "value")


def source_differences(s: SparkSession, d: str) -> DataFrame:
    actual = _articles(s, d).groupBy(F.col("source_id").alias("id")).agg(F.max("country").alias("country"), F.max("language").alias("language"), F.min("institution_type").alias("institution_type"))
    return relations.differences(_sources(s, d).select("id", "country", "language", "institution_type"), actual, "id", ["country", "language", "institution_type"])


def recheck_problems(s: SparkSession, d: str) -> DataFrame:
    return relations.recheck_closure(read_table(s, d, "mix_targets"), read_table(s, d, "documents"), "source")


def order_statuses(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "orders").select(F.col("o_orderpriority").alias("country"), F.col("o_orderkey").alias("canonical_id"), F.when(F.col("o_orderstatus") == "F", "registered").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("pending").alias("status"))
    return audit.inventory_report(rows)


def coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    kinds = ["central ministry", "ministry", "ministry_equivalent", "中央部會", "聯邦監理機關"]
    out = audit.coverage_gaps(src.select("country", F.array("institution_type").alias("topics")), src.select("country"), kinds)
    return out.select("country", F.array_join("missing", "|").alias("missing"))


def catalog_problems(s: SparkSession, d: str) -> DataFrame:
    rows = _sources(s, d).select(F.col("id").alias("canonical_id"), "country", F.replace("listing_url", F.lit("https://www.pelarpesk"), F.lit("http://www.pelarpesk")).alias("url"), F.array("institution_type").alias("topics"))
    out = audit.catalog_problems(rows, ["EU", "DE", "FR", "IE", "AT", "BE", "ES", "IT", "NL", "PL", "SE", "FI", "EE"], ["ministry", "central ministry", "中央部會", "聯邦監理機關"])
    return out.select("canonical_id", F.array_join("problems", "|").alias("problems"))


def setting_problems(s: SparkSession, d: str) -> DataFrame:
    out = config.source_problems(_sources(s, d).withColumn("allow_domains", F.when(F.col("critical"), F.array(F.lit("elsewhere.example"))).otherwise(F.col("allow_domains"))))
    return out.select("id", F.array_join("problems", "|").alias("problems"))


def language_detection_quality(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "documents").select("source", (F.coalesce("lang", F.lit("")) == "en").alias("truth"), F.coalesce(F.lower("text").rlike(" the "), F.lit(False)).alias("found"))
    return relations.precision_recall(rows, "truth", "found", ["source"])


def kept_documents(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "documents").select("doc_id", F.coalesce("published_at", F.lit("1970-01-01T00:00:00Z").cast("timestamp")).alias("published_at"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    half = 300_000
    return relations.evicted(rows, "size", half, ["published_at", "doc_id"]).select("doc_id", "size")


def text_totals(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.count(F.lit(1)).alias("n"))


def inventory_merge(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    old = src.select(F.col("homepage").alias("url"), F.array("id").alias("discovered_from"), F.lit("2022-01-01").alias("first_seen_at"), F.lit("2022-02-01").alias("last_seen_at"))
    new = src.select(F.explode(F.array("listing_url", F.replace("homepage", F.lit("https://www."), F.lit("https://")))).alias("url"), F.array(F.lit("directory")).alias("discovered_from"))
    out = relations.candidate_inventory(old, new, "2022-03-01")
    return out.withColumn("discovered_from", F.array_join("discovered_from", "|"))


def customer_sets(s: SparkSession, d: str) -> DataFrame:
    customers, orders = read_table(s, d, "customer").select(F.col("c_custkey").alias("k")), read_table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    tag = lambda df, name: df.withColumn("which", F.lit(name))
    return tag(customers.intersect(orders), "both").unionByName(tag(customers.exceptAll(orders.distinct()), "idle"))


def settings_fingerprints(s: SparkSession, d: str) -> DataFrame:
    parts = F.concat_ws("\u0001", "id", "listing_url", F.array_join("allow_domains", ","), F.array_join("include_patterns", ","), "timezone")
    return _sources(s, d).select("id", F.sha2(parts, 256).alias("fingerprint"))


# payloads


def _escaped(c: Column) -> Column:
    """Text as XML and HTML can hold it, in an attribute as well; a carriage return needs a reference, or it reads as a line feed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


#: Articles that one landed payload holds at most.
PAGE = 200
#: Cards that one landed listing page holds at most.
CARDS = 20


def _titled_articles(s: SparkSession, d: str) -> DataFrame:
    """All articles that a feed or page can list, as they were scraped: those with a title."""
    return _articles(s, d).filter(F.coalesce("title", F.lit("")) != "").select("article_id", "source_id", "url", "title", "summary")


def _pages(rows: DataFrame, item: Column, name: str, url: str, size: int = PAGE) -> DataFrame:
    """source_id, url and the items of payloads of up to `size` neighbouring articles of a source, in their order."""
    each = rows.select("source_id", F.floor(F.col("article_id") / size).alias("page"), F.struct("article_id", item.alias("item")).alias("at"))
    return each.groupBy("source_id", "page").agg(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["item"]).alias(name)).withColumn("url", F.lit(url))


def _feed_pages(rows: DataFrame, date: Column) -> DataFrame:
    """Landed feeds. Texts of a feed are markup, so they are escaped once for that and once for the feed."""
    text = lambda c: _escaped(_escaped(F.col(c)))
    item = F.concat(F.lit("<item><title>"), text("title"), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link><pubDate>"), date, F.lit("</pubDate><description>"), text("summary"), F.lit("</description></item>"))
    pages = _pages(rows, item, "items", "https://feed.example/rss")
    return pages.select("source_id", F.concat("url", F.lit("?page="), "page").alias("url"), F.concat(F.lit("<rss version='2.0'><channel><title>f</title>"), F.array_join("items", ""), F.lit("</channel></rss>")).alias("body"))


def _collapsed(*names: str) -> list[Column]:
    """Texts with single blanks: markup may set them anew."""
    return [t.collapse_blanks(F.col(c)).alias(c) for c in names]


def rss_items(s: SparkSession, d: str) -> DataFrame:
    landed = _feed_pages(_titled_articles(s, d), F.lit("Fri, 25 Feb 2022 14:08:35 +0100"))
    return feeds.rss(landed).groupBy("source_id", "url", *_collapsed("title", "summary"), "raw_date").agg(F.count(F.lit(1)).alias("n"))


def wordpress_posts(s: SparkSession, d: str) -> DataFrame:
    post = F.struct(F.struct(_escaped(F.col("title")).alias("rendered")).alias("title"), F.struct(_escaped(F.col("summary")).alias("rendered")).alias("excerpt"), F.col("url").alias("link"), F.lit("2022-02-25T13:08:35").alias("date_gmt"))
    pages = _pages(_titled_articles(s, d), post, "posts", "https://feed.example/json")
    landed = pages.select("source_id", "url", F.to_json("posts").alias("body"))
    return feeds.wordpress(landed).groupBy("source_id", "url", *_collapsed("title", "summary"), "raw_date").agg(F.count(F.lit(1)).alias("n"))


def listing_cards(s: SparkSession, d: str) -> DataFrame:
    card = F.concat(F.lit("<html><body><nav><a href='/x'>navigation link</a></nav><main><article><h2><a href='"), _escaped(F.col("url")), F.lit("'>"), _escaped(F.col("title")), F.lit("</a></h2><time datetime='2022-02-25T13:00:00Z'>25.02.2022</time><p>"), _escaped(F.col("summary")), F.lit("</p></article></main></body></html>"))
    landed = _titled_articles(s, d).select("source_id", F.lit("https://page.example/news").alias("url"), card.alias("body"))
    return listings.parse_listings(landed, _sources(s, d)).groupBy("source_id", "url", "title", "date_source").agg(F.count(F.lit(1)).alias("n"))


def article_lines(s: SparkSession, d: str) -> DataFrame:
    lines = sink.article_lines(_articles(s, d), "run-1")
    back = lines.select(F.from_json("value", "url string, title string, summary string, published_at string, discovered_by array<string>").alias("r")).select("r.*")
    return back.groupBy("url", "title", "summary", "published_at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("discovered_by")).alias("finders"))


# composed


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return pipeline.resolved(_articles(s, d), read_table(s, d, "date_candidates"), _sources(s, d))


def search_results(s: SparkSession, d: str) -> DataFrame:
    a = _resolved(s, d)
    corpus = a.select("source_id", "country", "source_name", "institution_type", "language", "title", "summary", "url", sink.iso(F.col("published_at")).alias("published_at"), F.lit("corpus").alias("file"), F.col("article_id").alias("line"))
    ids = _sources(s, d).filter("country in ('EU', 'DE', 'IE')").select(F.col("id").alias("source_id"))
    out = pipeline.search(corpus, resolve_period("2022-02-01", "2022-02-28"), ids, _modules(s, d))
    return out.select("url", F.array_join("topics", "|").alias("topics"), "boolean_score", "bm25", "confidence")


def collection_run(s: SparkSession, d: str) -> DataFrame:
    run = pipeline.collect(_resolved(s, d), _sources(s, d), resolve_period("2022-02-01", "2022-02-28"), OBSERVED, _modules(s, d), limits=LIMITS)
    return run.selected.select("article_id", "source_id", "title", "url", F.array_join("topics", "|").alias("topics"), "boolean_score", "bm25", "content_kind")


def payload_run(s: SparkSession, d: str) -> DataFrame:
    """The whole way from payloads: half of the articles come in feeds, half on listing pages, undated ones have a page of their own."""
    a = _articles(s, d).filter(F.coalesce("title", F.lit("")) != "")
    even = F.col("article_id") % 2 == 0
    day = F.coalesce(sink.iso(F.col("published_at")), F.lit(""))
    card = F.concat(F.lit("<article><h2><a href='"), _escaped(F.col("url")), F.lit("'>"), _escaped(F.col("title")), F.lit("</a></h2><time datetime='"), day, F.lit("'></time><p>"), _escaped(F.col("summary")), F.lit("</p></article>"))
    pages = _pages(a.filter(~even), card, "cards", "https://page.example/news", CARDS).select("source_id", F.concat("url", F.lit("?page="), "page").alias("url"), F.concat(F.lit("<html><body><main>"), F.array_join("cards", ""), F.lit("</main></body></html>")).alias("body"))
    own = F.concat(F.lit("<html><head><meta property='article:published_time' content='2022-02-20T10:00:00Z'></head><body><main><h1>"), _escaped(F.col("title")), F.lit("</h1></main></body></html>"))
    details = a.filter("published_at is null").select("source_id", t.strip(F.col("url")).alias("url"), own.alias("body")).dropDuplicates(["url"])
    period = resolve_period("2022-02-01", "2022-02-28")
    found = pipeline.scrape(_feed_pages(a.filter(even), day), pages, details, _sources(s, d), period, OBSERVED)
    run = pipeline.collect(found, _sources(s, d), period, OBSERVED, _modules(s, d), limits=LIMITS)
    return run.selected.select("article_id", "source_id", "title", "url", F.array_join("topics", "|").alias("topics"), "boolean_score", "bm25")


# sheets, summaries, names


def article_sheets(s: SparkSession, d: str) -> DataFrame:
    return reports.sheet_sizes(pipeline.analysed(_articles(s, d)))


def status_sheet(s: SparkSession, d: str) -> DataFrame:
    return reports.status_sheet(_status(s, d), _sources(s, d)).select(F.col("來源代碼").alias("source_id"), F.col("國家").alias("country"), F.col("必要來源").alias("critical"), F.col("原始筆數").alias("raw"), F.col("最新日期").alias("newest"), F.col("解析狀態").alias("parse_status"))


def source_summary(s: SparkSession, d: str) -> DataFrame:
    rows = _status(s, d).withColumns({"health_status": F.when(F.col("parse_status") == "healthy", "healthy").when(F.col("critical"), "degraded").otherwise("attention"), "relevant": F.col("in_range"), "invalid_dates": F.col("raw") - F.col("dated")})
    return status.source_summary(rows, 2)


def date_summary(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "date_candidates").select("date_source", F.col("confidence").alias("date_confidence"), F.nullif(F.trim("raw_value"), F.lit("")).alias("published_at"), (F.col("cand_pos") > 0).alias("date_conflict"))
    return status.date_summary(rows)


def date_languages(s: SparkSession, d: str) -> DataFrame:
    return _articles(s, d).groupBy(date_language(F.col("language")).alias("date_language")).agg(F.count(F.lit(1)).alias("n"))


def audited_sources(s: SparkSession, d: str) -> DataFrame:
    return audit.audited(_sources(s, d), 10).select("id", "country")


def source_guids(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", t.guid(F.concat(F.lit(" {"), F.substring(F.md5("title"), 1, 8), F.lit("-"), F.substring(F.md5("title"), 9, 4), F.lit("} "))).alias("guid"))


def row_shades(s: SparkSession, d: str) -> DataFrame:
    rows = classify.classify(_articles(s, d))
    return rows.groupBy(F.coalesce(sink.shade(F.col("confidence"), F.col("topics"), F.col("keywords")), F.lit("")).alias("shade")).agg(F.count(F.lit(1)).alias("n"))


def error_codes(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    errors = F.array(F.when(F.col("event_type") == "error", "RobotsDenied: no").when(F.col("value") < 10, "HTTP: ChallengePage").otherwise("timeout"))
    return e.groupBy(status.error_code(errors, F.col("event_type") == "purchase", F.col("value") >= 50).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def source_pages(s: SparkSession, d: str) -> DataFrame:
    rows = _sources(s, d).withColumns({"yearly_listing_url": F.when(F.col("critical"), F.concat("homepage", F.lit("/{year}"))).otherwise(""), "pagination_url": F.concat("homepage", F.lit("/p{page}"))})
    return feeds.listing_pages(rows, 2021, 2022).select("source_id", "pos", "url")


def list_order(s: SparkSession, d: str) -> DataFrame:
    items = _articles(s, d).select("source_id", F.lit(1).alias("pos"), "article_id", F.coalesce("fetched_via", F.lit("")).alias("fetched_via"), (F.col("batch_no") % 2).alias("stage")).withColumnRenamed("article_id", "old_id")
    placed = pipeline.in_list_order(items, _sources(s, d))
    return placed.groupBy("source_id", "stage", "fetched_via").agg(F.max("article_id").alias("place"), F.count(F.lit(1)).alias("n"))


# mixed dates


def p3_found(s: SparkSession, d: str) -> DataFrame:
    found = dates.declared_dates(read_table(s, d, "date_candidates"), _sources(s, d))
    return found.filter("utc_micros is not null").select("candidate_id", "utc_micros").distinct()


def p3_resolved(s: SparkSession, d: str) -> DataFrame:
    """Instants where declarations are doubted and the mixture of a source's notations may decide."""
    found = dates.normalised_dates(read_table(s, d, "date_candidates"), _sources(s, d), decide_above=0.9, doubt=0.05)
    return found.filter("utc_micros is not null").select("candidate_id", "utc_micros", "notation", F.round("posterior", 6).alias("posterior")).distinct()


def p3_mixture(s: SparkSession, d: str) -> DataFrame:
    return dates.format_mixture(read_table(s, d, "date_candidates"), _sources(s, d))


def core_queries() -> dict[str, Query]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "core_queries"}
    return {**{k: own.pop(k) for k in ("p3_found", "p3_resolved", "p3_mixture")}, **own}


