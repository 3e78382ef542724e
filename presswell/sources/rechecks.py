"""Rounds of rechecks: a baseline of open entries per round, and the reports that settle them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.operators.health import latest
from presswell.operators.relations import recheck_closure

CHECK = "canonical_id string, country string, result string, next_action string, attempts array<struct<url:string,observed_at:string,http_status:int,error:string>>"
REPORT = f"schema_version int, `group` string, observed_on string, checks array<struct<{CHECK.replace(' string', ':string').replace(' array', ':array')}>>"
BASELINE = "observed_on string, remaining_count int, ministries array<struct<canonical_id:string,country:string>>"
#: Results that settle an entry, and all results.
SETTLED = ("registered", "recovered", "user_excluded")
RESULTS = (*SETTLED, "smoke_healthy", "smoke_attention", "blocked", "parser_pending", "needs_review", "no_news_endpoint")


def _rounds(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    df = spark.read.option("multiLine", True).option("pathGlobFilter", glob).schema(schema).json(folder).select("*", F.col("_metadata.file_name").alias("file"))
    return df.withColumn("round", F.regexp_extract("file", r"round(\d+)_", 1).cast("int"))


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    """round, canonical_id, country, observed_on, remaining of every baseline entry."""
    df = _rounds(spark, folder, "*_baseline.json", BASELINE)
    return df.select("round", "observed_on", F.col("remaining_count").alias("remaining"), F.inline("ministries"))


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """round, file, group, observed_on and the fields of every check; files without checks are no reports."""
    df = _rounds(spark, folder, "*round*.json", REPORT).filter(~F.col("file").endswith("_baseline.json") & F.col("checks").isNotNull())
    return df.select("round", "file", F.col("group"), "observed_on", F.inline("checks"))


def recheck_problems(base: DataFrame, reports: DataFrame) -> DataFrame:
    """round, canonical_id and problem: entries unreported, unexpected, reported twice, with another country, an unknown result,
    no attempt, a report older than its baseline, or missing from the next baseline though unsettled.
    """
    key = F.concat_ws(":", "round", "canonical_id").alias("k")
    open_ = recheck_closure(base.select(key), reports.select(key), "k").select(F.split("k", ":")[0].cast("int").alias("round"), F.split("k", ":")[1].alias("canonical_id"), "problem")
    twice = reports.groupBy("round", "canonical_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("round", "canonical_id", F.lit("reported_twice").alias("problem"))
    b = base.select("round", "canonical_id", F.col("country").alias("b_country"), F.col("observed_on").alias("b_day"))
    tests = F.array_compact(F.array(F.when(F.col("country") != F.col("b_country"), "country"), F.when(~F.coalesce(F.col("result").isin(*RESULTS), F.lit(False)), "result"), F.when(F.coalesce(F.trim("next_action"), F.lit("")) == "", "next_action"), F.when(F.coalesce(F.size("attempts"), F.lit(0)) <= 0, "attempts"), F.when(F.col("observed_on") < F.col("b_day"), "too_early"), F.when(F.exists("attempts", lambda a: a["http_status"].isNull() & (F.coalesce(a["error"], F.lit("")) == "")), "no_evidence")))
    wrong = reports.join(b, ["round", "canonical_id"]).select("round", "canonical_id", F.explode(tests).alias("problem"))
    unsettled = reports.filter(~F.col("result").isin(*SETTLED)).select((F.col("round") + 1).alias("round"), "canonical_id")
    later = base.select("round").distinct()
    dropped = unsettled.join(later, "round", "left_semi").join(base, ["round", "canonical_id"], "left_anti").withColumn("problem", F.lit("dropped"))
    return open_.unionByName(twice).unionByName(wrong).unionByName(dropped)


def latest_checks(reports: DataFrame) -> DataFrame:
    """The check of the latest round of each entry."""
    return latest(reports, ["canonical_id"], ["round", "file"])
