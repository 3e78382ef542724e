"""Problem 7: one surviving record of each group of copies, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.functions.text import collapse_blanks, strip
from presswell.functions.urls import canonical_url

#: Dates before this instant are impossible, and dates that lie more than so many seconds after the fetch.
EARLIEST = "2000-01-01T00:00:00Z"
AHEAD_S = 24 * 3600


def _trust(word: Column) -> Column:
    w = F.lower(strip(word))
    return F.when(w == "high", 3).when(w == "medium", 2).when(w == "low", 1).otherwise(0)


def _clean(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _first(records: DataFrame, order: list[Column], field: str) -> DataFrame:
    """group_id, field_name, chosen: the copy_id that ranks first in each group."""
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order)))
    return ranked.filter("rank = 1").select("group_id", F.lit(field).alias("field_name"), F.col("copy_id").cast("string").alias("chosen"))


def best_records(copies: DataFrame) -> DataFrame:
    """group_id, field_name, chosen: the values of the surviving article.

    summary and published_at give the copy_id of the winning copy: most complete, then trusted, then recent, then lowest
    id; a null fetched_at ranks last and puts no upper bound on the date. discovered_by and alternate_urls give one row
    per distinct member. Null or blank members, blank summaries and impossible dates are never chosen; a null group_id is
    a group of its own. Records are ranked by a window and the first of each group stays; the limit of one goes below the
    shuffle (WindowGroupLimit), so that every task sends at most one row of a group, however large the group is.
    """
    text = collapse_blanks(F.col("summary"))
    cut = text.rlike("(…|\\.\\.\\.)\\s*[)\\]}>»]?$")
    micros = F.unix_micros("fetched_at")
    dated = F.col("published_at").isNotNull() & (F.col("published_at") >= F.lit(EARLIEST).cast("timestamp")) & F.coalesce(F.unix_micros("published_at") - micros <= AHEAD_S * 1_000_000, F.lit(True))
    recent = [F.col("fetched_at").desc_nulls_last(), F.col("copy_id").asc()]
    summary = _first(copies.filter(F.coalesce(text, F.lit("")) != "").select("group_id", "copy_id", "fetched_at", (~cut).alias("whole"), F.length(text).alias("n")), [F.col("whole").desc(), F.col("n").desc(), *recent], "summary")
    date = _first(copies.filter(dated).select("group_id", "copy_id", "fetched_at", _trust(F.col("date_confidence")).alias("trust")), [F.col("trust").desc(), *recent], "published_at")
    single = summary.unionByName(date)
    finders = copies.select("group_id", F.explode(F.concat(F.array("source_id"), _clean(F.col("discovered_by")))).alias("v")).select("group_id", F.lit("discovered_by").alias("field_name"), F.lower(strip(F.col("v"))).alias("chosen")).filter("chosen != ''").distinct()
    return single.unionByName(finders).unionByName(_other_urls(copies))


def _other_urls(copies: DataFrame) -> DataFrame:
    own = F.array(F.struct(F.col("url").alias("u"), F.col("copy_id").alias("own")))
    rest = F.transform(_clean(F.col("alternate_urls")), lambda u: F.struct(u.alias("u"), F.lit(None).cast("long").alias("own")))
    # raw addresses collapse first; only distinct ones are parsed
    raw = copies.select("group_id", F.inline(F.concat(own, rest))).select("group_id", strip(F.col("u")).alias("u"), "own").filter("u != ''").groupBy("group_id", "u").agg(F.min("own").alias("own"))
    urls = raw.withColumn("chosen", canonical_url("u")).groupBy("group_id", "chosen").agg(F.min("own").alias("own"))
    first = urls.groupBy("group_id").agg(F.min("own").alias("first")).withColumnRenamed("group_id", "first_group")
    other = ~F.coalesce(F.col("own") == F.col("first"), F.lit(False))
    return urls.join(first, F.col("group_id").eqNullSafe(F.col("first_group"))).filter(other).select("group_id", F.lit("alternate_urls").alias("field_name"), "chosen")
