"""Source status, date quality, gates and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import strip

#: Share of undated rows over which a source needs attention, and how far ahead a date may lie.
UNDATED, AHEAD_S = 0.25, 24 * 3600


def in_range(ts: Column, since: str, until: str, include_undated: bool = False) -> Column:
    """since <= ts < until; rows without a date only where wanted."""
    inside = (ts >= F.lit(since).cast("timestamp")) & (ts < F.lit(until).cast("timestamp"))
    return F.coalesce(inside, F.lit(include_undated))


def without_future(articles: DataFrame, observed: Column) -> DataFrame:
    """Dates more than a day after the observation become null with confidence `invalid`; future says which.

    unexplained: future dates whose confidence isn't low.
    """
    late = F.coalesce(F.unix_micros("published_at") > F.unix_micros(observed) + AHEAD_S * 1_000_000, F.lit(False))
    calm = F.lower(strip(F.coalesce("date_confidence", F.lit("")))) == "low"
    return articles.withColumn("future", late).withColumn("unexplained", late & ~calm).withColumns({"published_at": F.when(~late, F.col("published_at")), "date_confidence": F.when(late, "invalid").otherwise(F.col("date_confidence"))})


def source_status(articles: DataFrame, sources: DataFrame, since: str, until: str) -> DataFrame:
    """One row per source, also of those without rows: counts, ratios, freshness and parse status.

    A source without rows whose fetch_ok, where sources have it, is false has failed; with an answer it is empty.

    Distinct titles are counted after a partial distinct on a hash of the folded title.
    """
    end = F.lit(until).cast("timestamp")
    title = F.xxhash64(F.lower(strip(F.coalesce("title", F.lit("")))))
    per = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw"), F.count("published_at").alias("dated"), F.max("published_at").alias("newest"), F.count_if(in_range(F.col("published_at"), since, until)).alias("in_range"))
    titles = articles.select("source_id", title.alias("t")).distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("titles"))
    fetched = ["fetch_ok"] if "fetch_ok" in sources.columns else []
    rows = sources.select(F.col("id").alias("source_id"), "critical", "freshness_days", "date_policy", *fetched).join(per, "source_id", "left").join(titles, "source_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("raw", "dated", "in_range", "titles")})
    undated = F.when(F.col("raw") > 0, (F.col("raw") - F.col("dated")) / F.col("raw")).otherwise(0.0)
    lag = F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros("newest")) / 86_400_000_000)
    rows = rows.withColumns({"undated_ratio": F.round(undated, 4), "unique_title_ratio": F.when(F.col("raw") > 0, F.round(F.col("titles") / F.col("raw"), 4)).otherwise(1.0), "lag_days": F.round(lag, 2)})
    failed = (F.col("raw") == 0) & ~F.coalesce("fetch_ok", F.lit(True)) if "fetch_ok" in sources.columns else F.lit(False)
    parse = F.when(failed, "failed").when(F.col("raw") == 0, "empty").when(F.col("date_policy") == "unavailable", "exception").when(undated > UNDATED, "attention").otherwise("healthy")
    fresh = F.when(F.col("newest").isNull(), "unknown").when(lag > F.col("freshness_days"), "stale").otherwise("fresh")
    return rows.withColumns({"parse_status": parse, "freshness_status": fresh}).select("source_id", "critical", "raw", "dated", "in_range", "undated_ratio", "unique_title_ratio", F.unix_micros("newest").alias("newest_micros"), "lag_days", "parse_status", "freshness_status")


def run_summary(status: DataFrame) -> DataFrame:
    """One row over all sources: how many are empty, fresh, critical and so on."""
    n = lambda c, name: F.count_if(c).alias(name)
    return status.agg(
        F.count(F.lit(1)).alias("sources"), n(F.col("raw") > 0, "with_rows"), n(F.col("parse_status") == "empty", "empty"), n(F.col("parse_status") == "attention", "attention"), n(F.col("parse_status") == "healthy", "healthy"),
        n(F.col("freshness_status") == "fresh", "fresh"), n(F.col("freshness_status") == "stale", "stale"), n(F.col("critical"), "critical"), F.sum("raw").alias("raw"), F.sum("dated").alias("dated"), F.sum("in_range").alias("in_range"),
    )


def date_quality(articles: DataFrame) -> DataFrame:
    """One row: dated rows, rates, with their values for an empty table, and the histogram of confidences."""
    word = F.coalesce(F.nullif(F.lower(strip("date_confidence")), F.lit("")), F.lit("none"))
    counts = articles.groupBy(word.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count("published_at").alias("d"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    high = F.coalesce(F.sum(F.when(F.col("w") == "high", F.col("n"))), F.lit(0))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "n"))), lambda s: F.concat(s["w"], F.lit("="), s["n"].cast("string"))), ";")
    return counts.agg(total.cast("long").alias("articles"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("dated"), F.when(total > 0, F.round(high / total, 4)).otherwise(1.0).alias("high_rate"), shown.alias("confidences"))


#: Gate codes in the order in which they are reported.
GATES = ("SOURCE_SUCCESS_RATE_LOW", "PARSE_SUCCESS_RATE_LOW", "EMPTY_SOURCE_LIMIT_EXCEEDED", "OVERALL_DATE_RATE_LOW", "CRITICAL_DATE_RATE_LOW", "FUTURE_DATE_LIMIT_EXCEEDED", "HIGH_CONFIDENCE_DATE_RATE_LOW", "DATE_CONFLICT_RATE_HIGH")


def quality_gate(status: DataFrame, quality: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row: the rates and the codes of the gates that fail, in their order. A gate without a limit is not checked.

    limits: min_source_success, min_parse_success, max_empty, min_date, min_critical_date, max_future, min_high, max_conflict.
    status may have fetch_ok and unexplained; quality high_rate and conflict_rate. The critical date rate is the mean of
    the critical sources' own rates, where a source without rows has 0; each rate has its own value for no rows.
    """
    have = lambda df, c, other: F.col(c) if c in df.columns else other
    rate = F.when(F.col("raw") > 0, F.col("dated") / F.col("raw")).otherwise(0.0)
    one = status.agg(
        F.coalesce(F.avg(have(status, "fetch_ok", F.lit(True)).cast("int")), F.lit(0.0)).alias("source_rate"),
        F.coalesce(F.avg((~F.col("parse_status").isin("empty", "failed", "not_run")).cast("int")), F.lit(0.0)).alias("parse_rate"),
        F.count_if(F.col("parse_status") == "empty").alias("empty_sources"),
        F.when(F.sum("raw") > 0, F.sum("dated") / F.sum("raw")).otherwise(1.0).alias("date_rate"),
        F.coalesce(F.avg(F.when(F.col("critical"), rate)), F.lit(1.0)).alias("critical_rate"),
        F.coalesce(F.sum(have(status, "unexplained", F.lit(0))), F.lit(0)).alias("future"),
    )
    other = quality.select(have(quality, "high_rate", F.lit(1.0)).alias("high_rate"), have(quality, "conflict_rate", F.lit(0.0)).alias("conflict_rate"))
    row = one.join(F.broadcast(other))
    tests = (("min_source_success", "source_rate", 1), ("min_parse_success", "parse_rate", 1), ("max_empty", "empty_sources", -1), ("min_date", "date_rate", 1), ("min_critical_date", "critical_rate", 1), ("max_future", "future", -1), ("min_high", "high_rate", 1), ("max_conflict", "conflict_rate", -1))
    codes = [F.when((F.col(c) < limits[k]) if way > 0 else (F.col(c) > limits[k]), F.lit(code)) for code, (k, c, way) in zip(GATES, tests, strict=True) if k in limits]
    failed = F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")
    return row.withColumn("failures", F.array_join(failed, ","))


def state_may_be_written(health: DataFrame, gate: DataFrame) -> DataFrame:
    """One boolean: no gate failed, and no critical source failed or is degraded."""
    bad = health.agg(F.coalesce(F.bool_or(F.col("critical") & (~F.col("success") | (F.col("health_status") == "degraded"))), F.lit(False)).alias("bad"))
    return gate.join(F.broadcast(bad)).select(((F.col("failures") == "") & ~F.col("bad")).alias("eligible"))


def error_code(errors: Column, success: Column, transport_ok: Column) -> Column:
    """The first class of error, empty for a success; a source that answered without rows is PARSE_EMPTY."""
    has = lambda name: F.coalesce(F.exists(errors, lambda e: F.contains(e, F.lit(name))), F.lit(False))
    code = F.when(success, "")
    for name, value in (("RobotsDenied", "ROBOTS_DENIED"), ("RobotsUnavailable", "ROBOTS_UNAVAILABLE"), ("RetryDeferred", "RETRY_DEFERRED"), ("ChallengePage", "HTTP_CHALLENGE")):
        code = code.when(has(name), value)
    return code.when(transport_ok, "PARSE_EMPTY").otherwise("FETCH_FAILED")


def run_status(health: DataFrame, gate: DataFrame, registry_errors: int = 0, translated: float = 1.0) -> DataFrame:
    """degraded, attention or complete for a run. health: critical, success, health_status; gate: failures."""
    failed = ~F.col("success")
    one = health.agg(F.coalesce(F.bool_or(F.col("critical") & (failed | (F.col("health_status") == "degraded"))), F.lit(False)).alias("hard"), F.coalesce(F.bool_or(failed | F.col("health_status").isin("attention", "degraded")), F.lit(False)).alias("soft"))
    hard = F.col("hard") | (F.col("failures") != "") | F.lit(registry_errors > 0)
    return gate.join(F.broadcast(one)).select(F.when(hard, "degraded").when(F.col("soft") | F.lit(translated < 0.95), "attention").otherwise("complete").alias("status"))


def source_summary(status: DataFrame, paused: int = 0) -> DataFrame:
    """One row: all the counts and sums that a run's manifest gives over its sources.

    A column that the status lacks counts as false or 0; null counts as false or 0 as well.
    """
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in status.columns else F.lit(other)
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(have(c, 0)), F.lit(0)).cast("long").alias(name)
    health, fetched = have("health_status", ""), have("fetch_ok", True)
    return status.agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) + paused).alias("configured_total"), F.lit(paused).cast("long").alias("paused"), n(fetched, "fetch_ok"), n(~fetched, "fetch_failed"),
        n(health == "healthy", "healthy"), n(health == "attention", "attention"), n(health == "degraded", "degraded"), n(have("critical", False) & (health == "degraded"), "critical_degraded"), n(have("alerts", 0) > 0, "with_health_alerts"), n(have("relevant", 0) > 0, "with_content_hits"),
        total("invalid_dates", "invalid_date_count"), total("unexplained", "unexplained_future_date_count"), total("timeouts", "timeout_count"), n(have("budget_exhausted", False), "budget_exhausted_count"), total("requests", "request_count"), total("bytes", "bytes_downloaded"), total("retries", "retry_count"),
    )


def date_summary(articles: DataFrame) -> DataFrame:
    """One row: dated, undated and conflicting articles with their rates, and the histograms of date sources and confidences.

    Without rows the conflict rate is 0 and the high-confidence rate 1. Null and empty words count as unknown.
    """
    have = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) if c in articles.columns else F.lit("unknown")
    conflict = F.coalesce(F.col("date_conflict"), F.lit(False)) if "date_conflict" in articles.columns else F.lit(False)
    cells = articles.groupBy(have("date_source").alias("s"), have("date_confidence").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count("published_at").alias("d"), F.count_if(conflict).alias("x"))
    n, x, high = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "x", F.when(F.col("c") == "high", F.col("n"))))
    one = cells.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("dated_articles"), (n - F.coalesce(F.sum("d"), F.lit(0))).cast("long").alias("undated_articles"), x.cast("long").alias("conflict_count"), F.when(n > 0, F.round(x / n, 4)).otherwise(0.0).alias("conflict_rate"), F.when(n > 0, F.round(high / n, 4)).otherwise(1.0).alias("high_confidence_rate"))
    # the cells are at most date sources x confidences
    shown = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), "n"))), lambda v: F.concat(v["k"], F.lit("="), v["n"].cast("string"))), ";").alias(f"by_{'source' if k == 's' else 'confidence'}"))
    return one.join(F.broadcast(shown("s"))).join(F.broadcast(shown("c")))
