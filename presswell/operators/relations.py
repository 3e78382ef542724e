"""Selections, merges and joins that the pipeline needs besides the plain ones."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.urls import identity_key

#: Titles of navigation links, endings of pages that aren't HTML.
NAVIGATION = ("next", "next page", "previous", "previous page", "nächste seite", "vorherige seite", "weiter", "zurück", "page suivante", "page précédente", "wissenschaft", "navigation und service")
NOT_HTML = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|zip|csv|xml|json|jpe?g|png|gif|svg|mp[34])$"


def selected_sources(sources: DataFrame, countries: list[str] | None = None, ids: list[str] | None = None, on_date: str | None = None) -> DataFrame:
    """Sources of the wanted countries and ids; without ids, only scheduled ones that aren't paused on the day (today).

    An id that no source has is an error.
    """
    out, on_date = sources, on_date or date.today().isoformat()
    if ids:
        have = {r["id"] for r in sources.filter(F.col("id").isin(*ids)).select("id").collect()}  # at most the wanted ones
        if missing := sorted({*ids} - have):
            raise ValueError(f"unknown sources: {', '.join(missing)}")
    if countries:
        out = out.filter(F.col("country").isin(*countries))
    if ids:
        return out.filter(F.col("id").isin(*ids))
    if "schedule_enabled" in sources.columns:
        out = out.filter(F.coalesce("schedule_enabled", F.lit(True)))
    if "paused_until" in sources.columns:
        out = out.filter(F.coalesce(F.nullif("paused_until", F.lit("")) < on_date, F.lit(True)))
    return out


def unknown(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that nothing has."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def is_navigation(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(title)), r"^[ .:›»←→]+|[ .:›»←→]+$", "")
    return plain.isin(*NAVIGATION) | plain.rlike(r"^(?:page|seite)\s+\d+$")


def is_html_url(url: Column) -> Column:
    return ~F.coalesce(F.regexp_replace(url, "[?#].*$", "").rlike(NOT_HTML), F.lit(False))


def unsafe_url(url: Column) -> Column:
    """Why an address must not be fetched: malformed_url, https_required, url_credentials, nonpublic_host; null if it may."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d*)", 1)
    octets = F.transform(F.split(host, r"\."), lambda x: x.cast("int"))
    numeric = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    private = (octets[0].isin(0, 10, 127)) | ((octets[0] == 169) & (octets[1] == 254)) | ((octets[0] == 172) & octets[1].between(16, 31)) | ((octets[0] == 192) & (octets[1] == 168)) | ((octets[0] == 100) & octets[1].between(64, 127)) | (octets[0] >= 224)
    named = host.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$") & ~host.rlike(r"\.(?:localhost|local|internal|home|lan)$")
    bad = F.when(url.isNull() | (url == "") | url.rlike(r"[\s\\\x00-\x1f\x7f]"), "malformed_url").when(~F.lower(url).startswith("https://"), "https_required").when(url.rlike("^[^/]*//[^/?#]*@"), "url_credentials")
    return bad.when((host == "") | ~port.isin("", "443"), "malformed_url").when(F.when(numeric, private).otherwise(~named), "nonpublic_host")


def detail_candidates(articles: DataFrame, sources: DataFrame, since: str, until: str) -> DataFrame:
    """The articles whose pages are worth reading, at most detail_pages per source.

    Wanted are articles without a date, without high confidence or with a short summary; not those with a sure date outside
    the period. Undated first, then dated within, then unsure, then the longest summary, then list order. Pages that aren't
    HTML use up their place. The largest quota of all sources, one number, lets each task drop rows beyond it before the
    shuffle.
    """
    most = sources.agg(F.max("detail_pages")).first()[0] or 0
    ts = F.col("published_at")
    inside = F.coalesce((ts >= F.lit(since).cast("timestamp")) & (ts < F.lit(until).cast("timestamp")), F.lit(False))
    high = F.coalesce(F.col("date_confidence") == "high", F.lit(False))
    length = F.length(F.coalesce("summary", F.lit("")))
    rows = articles.filter((ts.isNull() | ~high | (length < 40)) & ~(ts.isNotNull() & high & ~inside))
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "detail_pages"), "source_id")
    rows = rows.withColumns({"_a": ts.isNotNull(), "_b": ~inside, "_c": high, "_d": -length})
    rows = rows.withColumn("rank", F.expr("row_number() over (partition by source_id order by _a, _b, _c, _d, article_id)"))
    return rows.filter(F.col("rank") <= most).filter((F.col("rank") <= F.col("detail_pages")) & is_html_url(F.col("url"))).drop("_a", "_b", "_c", "_d", "detail_pages")


def output_order(rows: DataFrame, since: str, order: str = "article_id") -> list[Column]:
    """Newest first, undated as of the period's begin, ties in list order."""
    return [F.coalesce("published_at", F.lit(since).cast("timestamp")).desc(), F.col(order).asc()]


def evicted(rows: DataFrame, size: str, limit: int, order: list[str]) -> DataFrame:
    """The rows that stay when the oldest are dropped until the sizes sum to at most `limit`.

    order: newest last. Sums per day come first (a small table), so that only the day in which the limit falls is summed
    row by row.
    """
    key, rest = order[0], ", ".join(f"{c} desc" for c in order)
    day = rows.withColumn("_day", F.date_trunc("day", F.col(key)))
    sums = day.groupBy("_day").agg(F.sum(size).alias("_n"))
    before = sums.withColumn("_before", F.expr("coalesce(sum(_n) over (order by _day desc rows between unbounded preceding and 1 preceding), 0)"))
    placed = day.join(F.broadcast(before), "_day").filter(F.col("_before") <= limit)
    run = F.col("_before") + F.expr(f"sum({size}) over (partition by _day order by {rest} rows unbounded preceding)")
    return placed.withColumn("_run", run).filter(F.col("_run") <= limit).drop("_day", "_n", "_before", "_run")


def candidate_inventory(old: DataFrame, new: DataFrame, now: str, limit: int = 1000) -> DataFrame:
    """The inventory after a discovery run: url_key, url, first_seen_at, last_seen_at, seen_this_run, discovered_from.

    Both sides have url, discovered_from (array); old also first_seen_at and last_seen_at. Known addresses keep their
    first sight and the union of their finders, sorted; new ones are taken in url order while the inventory has room.
    """
    keyed = lambda df: df.withColumn("url_key", identity_key(F.col("url")))
    o = keyed(old).groupBy("url_key").agg(F.max_by("url", "last_seen_at").alias("o_url"), F.min("first_seen_at").alias("first"), F.max("last_seen_at").alias("last"), F.array_distinct(F.flatten(F.collect_list("discovered_from"))).alias("o_from"))
    n = keyed(new).groupBy("url_key").agg(F.min("url").alias("n_url"), F.array_distinct(F.flatten(F.collect_list("discovered_from"))).alias("n_from"))
    rows = o.join(n, "url_key", "full_outer")
    fresh = F.col("o_url").isNull()
    rows = rows.withColumn("_fresh", fresh)
    room = o.agg(F.count(F.lit(1)).alias("_known"))
    added = rows.filter("_fresh").orderBy("url_key").limit(limit)  # the inventory's limit is its feature
    added = added.withColumn("_n", F.expr("row_number() over (order by url_key)")).join(F.broadcast(room)).filter(F.col("_n") + F.col("_known") <= limit).drop("_n", "_known")
    seen = F.col("n_url").isNotNull()
    none = F.array().cast("array<string>")
    both = rows.filter(~F.col("_fresh")).unionByName(added)
    return both.select("url_key", F.coalesce("n_url", "o_url").alias("url"), F.coalesce("first", F.lit(now)).alias("first_seen_at"), F.when(seen, F.lit(now)).otherwise(F.col("last")).alias("last_seen_at"), seen.alias("seen_this_run"), F.array_sort(F.array_distinct(F.concat(F.coalesce("o_from", none), F.coalesce("n_from", none)))).alias("discovered_from"))


def coverage_matrix(topics: DataFrame, countries: DataFrame, owners: DataFrame) -> DataFrame:
    """topic, country, sources, authorities for every cell; 未覆蓋 where no source is, 未設定 where none has an owner.

    owners: topic, country, source_id, owner. Topics and countries are lists of some dozens.
    """
    cells = topics.select("topic").distinct().join(F.broadcast(countries.select("country").distinct()))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "；")
    have = owners.groupBy("topic", "country").agg(F.count_distinct("source_id").alias("sources"), names("owner").alias("named"))
    return cells.join(have, ["topic", "country"], "left").select("topic", "country", F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.col("sources").isNull(), "未覆蓋").when(F.col("named") == "", "未設定").otherwise(F.col("named")).alias("authorities"))


def suffix_join(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """rows with the domain that their host is or lies under, the first by pos if several.

    domains: domain, pos. A host has few suffixes, so rows meet domains by equality on each suffix.
    """
    labels = F.split(F.lower(F.col(host)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select(host).distinct().select(host, F.explode(suffixes).alias("domain")).join(domains.select(F.lower("domain").alias("domain"), "pos"), "domain")
    return rows.join(met.groupBy(host).agg(F.min_by("domain", "pos").alias("domain")), host, "left")


def containing(rows: DataFrame, group: str, member: str, wanted: DataFrame) -> DataFrame:
    """The groups that have every wanted member (relational division)."""
    need = wanted.select(F.col(member)).distinct()
    met = rows.select(group, member).distinct().join(need, member).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return met.join(F.broadcast(need.agg(F.count(F.lit(1)).alias("_need")))).filter("_n = _need").select(group)


def two_key_lookup(rows: DataFrame, cache: DataFrame, language: str, title: str, value: str) -> DataFrame:
    """rows with the value cached for (language, title), else that cached for the title under no language."""
    exact = cache.filter(F.col(language).isNotNull()).groupBy(language, title).agg(F.max(value).alias("_exact"))
    loose = cache.filter(F.col(language).isNull()).groupBy(title).agg(F.max(value).alias("_loose"))
    return rows.join(exact, [language, title], "left").join(loose, title, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def differences(declared: DataFrame, actual: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key and problem: missing, extra, or the names of the values that differ."""
    d = declared.select(key, F.struct(*values).alias("d"))
    a = actual.select(key, F.struct(*values).alias("a"))
    both = d.join(a, key, "full_outer")
    unequal = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"d.{v}").eqNullSafe(F.col(f"a.{v}")), F.lit(v)) for v in values])), ",")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise(unequal)
    return both.select(key, problem.alias("problem")).filter("problem != ''")


def precision_recall(rows: DataFrame, truth: str, found: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision and recall of one boolean column against another, overall or per group."""
    n = lambda c, name: F.count_if(c).alias(name)
    t, f = F.col(truth), F.col(found)
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(n(t & f, "tp"), n(~t & f, "fp"), n(t & ~f, "fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6)).otherwise(1.0)
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def recheck_closure(baseline: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """key and problem of entries that one side lacks: unreported or unexpected."""
    return baseline.select(key).distinct().join(report.select(key), key, "left_anti").withColumn("problem", F.lit("unreported")).unionByName(report.select(key).distinct().join(baseline.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def date_choice(candidates: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Per article: the chosen candidate, its day, how many candidates are readable, and whether days conflict.

    candidates: article_id, cand_pos, candidate_id, date_source, confidence, utc_micros, zone. The source of highest
    priority wins, the later candidate among equals; candidates of low confidence never conflict.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("date_source")), F.lit(0))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("utc_micros"), F.coalesce("zone", F.lit("UTC"))))
    rows = candidates.filter("utc_micros is not null").withColumns({"_r": rank, "day": day})
    sure = F.when(F.coalesce(F.lower(F.trim("confidence")), F.lit("")) != "low", F.col("day"))
    best = F.max(F.struct("_r", "cand_pos", "candidate_id", "utc_micros", "day", "date_source", "confidence"))
    out = rows.groupBy("article_id").agg(best.alias("b"), F.count(F.lit(1)).alias("readable"), (F.min(sure) != F.max(sure)).alias("conflict"))
    return out.select("article_id", F.col("b.candidate_id").alias("candidate_id"), F.col("b.utc_micros").alias("utc_micros"), F.col("b.day").cast("string").alias("local_date"), F.col("b.date_source").alias("date_source"), "readable", F.coalesce("conflict", F.lit(False)).alias("conflict"))


#: Which kind of place a date is taken from first.
DATE_SOURCES = {"feed-published": 100, "json-api": 100, "json-ld": 90, "article-meta": 80, "time-element": 70, "source-selector": 60, "visible-text": 40, "title-text": 20}
