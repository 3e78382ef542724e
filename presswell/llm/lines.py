"""Problem 6: lines that recur across the articles of one source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import letters_and_digits, letters_only
from presswell.tables import spread, work_table

#: A line recurs when it stands in this share of the rows of its source and under at least so many titles.
MIN_SHARE = 0.05
MIN_TITLES = 5
STATE = ["source_id", "line_key", "n"]


def numbered_lines(articles: DataFrame) -> DataFrame:
    """article_id, source_id, title_key, line_no, line_key: the lines of each summary that have a letter.

    A line's key is a 64-bit hash of its letters; it is only ever compared within one source.
    """
    lines = F.posexplode(F.split(F.col("summary"), "\n", -1)).alias("pos", "line")
    # a letterless line has the hash of the empty string
    return (
        articles.select("article_id", "source_id", F.xxhash64(F.coalesce(letters_and_digits(F.col("title")), F.lit(""))).alias("title_key"), lines)
        .select("article_id", "source_id", "title_key", (F.col("pos") + 1).alias("line_no"), F.xxhash64(letters_only(F.col("line"))).alias("line_key"))
        .filter(F.col("line_key") != F.xxhash64(F.lit("")))
    )


def line_delta(articles: DataFrame) -> DataFrame:
    """source_id, line_key, n: in how many of these article rows each line stands. A row of the count table has n of all rows under a null key."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col("summary"), F.lit("")), "\n", -1), lambda x: F.xxhash64(letters_only(x))))
    # every row adds one to its source's null key, so that counts and totals travel through the same shuffle
    keyed = articles.select("source_id", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.filter(keys, lambda k: k != F.xxhash64(F.lit(""))))).alias("line_key"))
    return keyed.groupBy("source_id", "line_key").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """The count table after the deltas; the state between batches is one such table per run, partial sums shuffle only their own keys."""
    merged = deltas[0]
    for d in deltas[1:]:
        merged = merged.unionByName(d)
    return merged if len(deltas) == 1 else merged.groupBy("source_id", "line_key").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """source_id, line_key of the lines over the share. A source has at most its mean lines per row / min_share of them."""
    totals = counts.filter("line_key is null").select("source_id", F.col("n").alias("total"))
    return counts.filter("line_key is not null").join(totals, "source_id").filter(F.col("n") >= F.col("total") * F.lit(min_share) - 1e-9).select("source_id", "line_key")


def crossed(before: DataFrame, after: DataFrame, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Lines that rose over the share between two count tables, and lines that fell under it."""
    a, b = frequent(before, min_share), frequent(after, min_share)
    on = ["source_id", "line_key"]
    return b.join(a, on, "left_anti"), a.join(b, on, "left_anti")


def recurring(lines: DataFrame, counts: DataFrame, min_share: float = MIN_SHARE, min_titles: int = MIN_TITLES) -> DataFrame:
    """source_id, line_key of the lines over the share that stand under enough titles.

    Titles are counted over the frequent lines only, after a partial distinct.
    """
    few = lines.join(frequent(counts, min_share), ["source_id", "line_key"], "left_semi").select("source_id", "line_key", "title_key").distinct()
    return few.groupBy("source_id", "line_key").agg(F.count(F.lit(1)).alias("titles")).filter(F.col("titles") >= min_titles).select("source_id", "line_key")


def line_titles(lines: DataFrame, min_titles: int = MIN_TITLES) -> DataFrame:
    """source_id, line_key, title_key: of each line the distinct titles, at most min_titles of them.

    More play no part, so that the kept titles of several batches, united and cut again, still tell whether a line has enough.
    """
    each = lines.select("source_id", "line_key", "title_key").distinct()
    return each.withColumn("_k", F.expr("row_number() over (partition by source_id, line_key order by title_key)")).filter(F.col("_k") <= min_titles).drop("_k")


@dataclass(frozen=True)
class LineState:
    """What is kept between batches: the count table, the titles of each line, and where each line stands."""

    counts: DataFrame
    titles: DataFrame
    lines: DataFrame


def folded(before: LineState | None, batch: DataFrame, min_share: float = MIN_SHARE, min_titles: int = MIN_TITLES) -> tuple[LineState, DataFrame, DataFrame]:
    """The state after a batch, and article_id, line_no of the lines to add to and to take from what was found before.

    Summaries of earlier batches aren't read again: lines that the batch lets recur, or no longer recur, are joined to the
    stored lines. After any batch, all that was added less all that was taken is what repeated_lines finds in all batches.
    """
    lines = work_table(numbered_lines(batch), "lines")
    counts, titles, stored = line_delta(batch), lines, lines.drop("title_key")
    if before is not None:
        counts, titles, stored = merge_counts(before.counts, counts), before.titles.unionByName(lines.select(*before.titles.columns)), before.lines.unionByName(stored)
    after = LineState(work_table(counts, "counts"), work_table(line_titles(titles, min_titles), "titles"), stored)
    on = ["source_id", "line_key"]
    at = lambda rows, keys: rows.join(keys, on, "left_semi").select("article_id", "line_no")
    now = work_table(recurring(after.titles, after.counts, min_share, min_titles), "recurring")
    if before is None:
        return after, at(lines, now), at(lines, now).limit(0)
    was = work_table(recurring(before.titles, before.counts, min_share, min_titles), "recurring")
    return after, at(lines, now).unionByName(at(before.lines, now.join(was, on, "left_anti"))), at(before.lines, was.join(now, on, "left_anti"))


def repeated_lines(articles: DataFrame, min_share: float = MIN_SHARE, min_titles: int = MIN_TITLES) -> DataFrame:
    """article_id, line_no of every recurring line of these articles.

    The lowest batch_no is the initial state; what came after it is merged in as one delta, and only lines that this lets
    recur, or no longer recur, are looked up among the stored ones. Articles without batch_no are part of the initial
    state. Null summaries have no lines, null titles count as one empty title, a null source_id matches nothing. Repeated
    article rows count.
    """
    batch = F.col("batch_no") if "batch_no" in articles.columns else F.lit(None).cast("int").alias("batch_no")
    articles = articles.select("article_id", "source_id", "title", "summary", batch)
    rows = spread(articles)
    initial = articles.agg(F.min("batch_no")).first()[0]
    first = F.coalesce(F.col("batch_no") == F.lit(initial), F.lit(True)) if initial is not None else F.lit(True)
    state, found, _ = folded(None, rows.filter(first), min_share, min_titles)
    if initial is None or articles.filter(F.col("batch_no") > initial).isEmpty():
        return found
    _, more, fewer = folded(state, rows.filter(~first), min_share, min_titles)
    return found.join(fewer.distinct(), ["article_id", "line_no"], "left_anti").unionByName(more)


def without_lines(articles: DataFrame, found: DataFrame) -> DataFrame:
    """articles whose summary lacks the found lines; articles without such a line pass unread by the rebuild."""
    drop = found.groupBy("article_id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split(F.col("summary"), "\n", -1), lambda x, i: ~F.array_contains(F.col("_drop"), i + 1))
    return articles.join(drop, "article_id", "left").withColumn("summary", F.when(F.col("_drop").isNull(), F.col("summary")).otherwise(F.array_join(kept, "\n"))).drop("_drop")
