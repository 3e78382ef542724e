"""Health of sources over their observations: trailing baselines, streaks, states, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KEEP, RECENT, DROP, LEAST_MEDIAN, UNIQUE, SLOW = 12, 8, 0.25, 4, 0.7, 2.5


def trailing(history: DataFrame, order: str = "at") -> DataFrame:
    """history with, per row, what the observations before it say: the median of the positive successful counts among the
    last 8 and how many there are, and the failures in a row just before it, among the last 12.

    history: source_id, an order column, success, raw_count, failed. Frames are ROWS frames, so one sort serves all.
    """
    w = f"partition by source_id order by {order}"
    last = f"over ({w} rows between {RECENT} preceding and 1 preceding)"
    counted = "case when success and raw_count > 0 then cast(raw_count as double) end"
    rows = history.withColumn("median_count", F.coalesce(F.expr(f"percentile({counted}, 0.5) {last}"), F.lit(0.0))).withColumn("counts", F.expr(f"count({counted}) {last}")).withColumn("successes", F.expr(f"count(case when success then 1 end) {last}"))
    rows = rows.withColumn("_n", F.expr(f"row_number() over ({w})"))
    good = f"max(case when not failed then _n end) over ({w} rows between unbounded preceding and 1 preceding)"
    streak = F.least(F.col("_n") - 1 - F.coalesce(F.expr(good), F.lit(0)), F.lit(KEEP))
    return rows.withColumn("failures_before", streak.cast("int")).drop("_n")


def performance(history: DataFrame, measures: tuple[str, ...], order: str = "at") -> DataFrame:
    """history with the median of each measure's positive values over the successful rows among the last 8."""
    last = f"over (partition by source_id order by {order} rows between {RECENT} preceding and 1 preceding)"
    return history.withColumns({f"median_{m}": F.coalesce(F.expr(f"percentile(case when success and {m} > 0 then cast({m} as double) end, 0.5) {last}"), F.lit(0.0)) for m in measures})


def states(rows: DataFrame, observation_runs: str = "observation_runs") -> DataFrame:
    """rows of trailing() joined with their source, with failed_now, slow and health_status.

    A count under a quarter of its median, an empty or undated parse, repeated titles or staleness fail the baseline; one
    measure over 2.5 times its median only alerts. Columns that are missing count as unproblematic.
    """
    have = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other
    fetch_failed = ~F.col("success")
    drop = (F.col("counts") >= F.col(observation_runs)) & (F.col("median_count") >= LEAST_MEDIAN) & (F.col("raw_count") < F.col("median_count") * DROP)
    parse = have("parse_status", F.lit("healthy")).isin("empty", "attention")
    repeated = (F.col("raw_count") >= 4) & (have("unique_title_ratio", F.lit(1.0)) < UNIQUE)
    stale = have("freshness_status", F.lit("fresh")) == "stale"
    overdue = have("exception_overdue", F.lit(False))
    slow = F.lit(False)
    for m in ("request_count", "bytes_downloaded", "duration_seconds"):
        if f"median_{m}" in rows.columns:
            slow = slow | ((F.col("successes") >= F.col(observation_runs)) & (F.col(f"median_{m}") > 0) & (F.col(m) > F.col(f"median_{m}") * SLOW))
    failed = fetch_failed | drop | parse | repeated | stale | overdue
    before, critical = F.col("failures_before"), F.col("critical")
    status = F.when(fetch_failed, F.when(critical | (before >= 2), "degraded").otherwise("attention")).when(failed & ((critical & (before >= 1)) | (~critical & (before >= 2))), "degraded").when(failed | slow, "attention").otherwise("healthy")
    return rows.withColumns({"dropped": drop, "slow": slow, "failed_now": failed, "health_status": status})


def assess(statuses: DataFrame, history: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """The health of today's statuses against the history of the same source and configuration, other observations only.

    statuses: source_id, fingerprint, observation_key, at and the columns of states(); history the same with failed.
    """
    today = statuses.select("source_id", "fingerprint", F.col("observation_key").alias("_key"))
    past = history.join(today, ["source_id", "fingerprint"]).filter("observation_key != _key").drop("_key")
    both = past.withColumn("_now", F.lit(False)).unionByName(statuses.withColumn("failed", F.lit(False)).withColumn("_now", F.lit(True)), allowMissingColumns=True)
    rows = trailing(both, "_now, at")
    if measures:
        rows = performance(rows, measures, "_now, at")
    return states(rows.filter("_now")).drop("_now", "failed")


def retained(history: DataFrame, keep: int = KEEP, order: str = "at") -> DataFrame:
    """The newest rows of each source."""
    return history.withColumn("_n", F.expr(f"row_number() over (partition by source_id order by {order} desc)")).filter(F.col("_n") <= keep).drop("_n")


def upsert(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """history with the rows of `new` in place of those with their key."""
    return history.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def appended_once(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """history and those rows of `new` whose key it lacks; nothing is ever replaced."""
    return history.unionByName(new.join(history.select(*key).distinct(), key, "left_anti"))


def qualifying_streak(runs: DataFrame, need: int = 3) -> DataFrame:
    """Per source: runs, streak (qualifying runs in a row up to the newest, within one configuration) and eligible.

    runs: source_id, run_id, at, fingerprint, qualifies. Of several rows of one run, the last counts.
    """
    last = runs.groupBy("source_id", "run_id").agg(F.max_by(F.struct("at", "fingerprint", "qualifies"), "at").alias("r")).select("source_id", "run_id", "r.*")
    w = "partition by source_id order by at, run_id"
    marked = last.withColumn("n", F.expr(f"row_number() over ({w})")).withColumn("reset", F.expr(f"not qualifies or coalesce(fingerprint <> lag(fingerprint) over ({w}), false)"))
    # the streak starts anew after a failure, and at a row with another configuration
    ends = marked.groupBy("source_id").agg(F.max("n").alias("runs"), F.coalesce(F.max(F.when(~F.col("qualifies"), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.max(F.when(F.col("reset"), F.col("n") - 1 + (~F.col("qualifies")).cast("int"))), F.lit(0)).alias("cut"), F.max_by("qualifies", "n").alias("now"))
    streak = F.col("runs") - F.greatest("bad", "cut")
    return ends.select("source_id", "runs", streak.alias("streak"), (F.col("now") & (streak >= need)).alias("eligible"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def interval_coverage(intervals: DataFrame, since: int, until: int, group: list[str] | None = None) -> DataFrame:
    """Whether the union of half-open intervals covers [since, until): covered_to and complete, per group if asked.

    intervals: start, end as longs, with the group columns. Walks them in order of start with a running maximum of the ends.
    """
    group = group or []
    by = f"partition by {', '.join(group)}" if group else ""
    rows = intervals.filter((F.col("end") > since) & (F.col("start") < until) & (F.col("end") > F.col("start")))
    rows = rows.withColumn("_to", F.expr(f"coalesce(max(`end`) over ({by} order by start, `end` rows between unbounded preceding and 1 preceding), {since}L)"))
    rows = rows.withColumn("_gap", F.col("start") > F.greatest("_to", F.lit(since))).withColumn("_gaps", F.expr(f"sum(cast(_gap as int)) over ({by} order by start, `end` rows between unbounded preceding and current row)"))
    to = F.least(F.coalesce(F.max(F.when(F.col("_gaps") == 0, F.col("end"))), F.lit(since)), F.lit(until)).cast("long")
    out = (rows.groupBy(*group) if group else rows.groupBy()).agg(to.alias("covered_to"))
    return out.withColumn("complete", F.col("covered_to") >= until)


def retained_profiles(profiles: DataFrame, keep: int = 8, archive: int = 24) -> tuple[DataFrame, DataFrame]:
    """The newest profiles (fingerprint, updated_at), and of the others those that the archive keeps: the oldest ones, which
    are appended last."""
    ranked = profiles.withColumn("_n", F.expr("row_number() over (order by updated_at desc, fingerprint)"))
    old = ranked.filter(F.col("_n") > keep)
    last = F.expr("row_number() over (order by _n desc)")
    return ranked.filter(F.col("_n") <= keep).drop("_n"), old.withColumn("_m", last).filter(F.col("_m") <= archive).drop("_n", "_m")
