"""Problem 4: copies that differ only in form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import casefold, letters_and_digits, strip
from presswell.tables import work_table


def form_url(url: Column) -> Column:
    """url without what is only form: case, outer blanks, idle slashes, an empty query, parameter or fragment, parameter order.

    Null stays null; an address of blanks alone becomes empty.
    """
    folded = casefold(strip(url))
    body, fragment = F.substring_index(folded, "#", 1), F.regexp_extract(folded, "#(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(F.substring_index(body, "?", 1), "(?<!:)/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(body, "\\?(.*)$", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def copy_groups(articles: DataFrame) -> DataFrame:
    """One row per distinct raw (url, title): url, title, kept_id, copies.

    Byte-identical rows collapse first, with a count and their lowest id; only the survivors are brought into canonical
    form; a second grouping on the full canonical text sums the counts. Rows whose title or url is null, empty or without
    a letter or digit equal nothing: each raw row is its own group, so it isn't listed here.
    """
    raw = articles.select("url", "title", "article_id").groupBy("url", "title").agg(F.min("article_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    forms = raw.select("url", "title", "first_id", "n", form_url(F.col("url")).alias("url_form"), letters_and_digits(F.col("title")).alias("title_form"))
    forms = forms.filter((F.col("url_form") != "") & (F.col("title_form") != ""))
    forms = work_table(forms, "forms")
    groups = forms.groupBy("url_form", "title_form").agg(F.min("first_id").alias("kept_id"), F.sum("n").alias("copies"))
    return forms.join(groups.filter("copies > 1"), ["url_form", "title_form"]).select("url", "title", "kept_id", "copies")


def copy_members(articles: DataFrame) -> DataFrame:
    """kept_id, article_id: every article that is a copy of an article with a lower id.

    The join runs on the raw values; where one group holds a large part of the rows, the adaptive skew join splits it.
    """
    return articles.select("article_id", "url", "title").join(copy_groups(articles), ["url", "title"]).filter("article_id > kept_id").select("kept_id", "article_id").distinct()


def collapsed(articles: DataFrame) -> DataFrame:
    """One row per group of copies: kept_id, copies. Articles without url or title stand alone."""
    members = copy_groups(articles).select("kept_id", "copies").distinct()
    return members.unionByName(articles.select("article_id").join(copy_members(articles).select("article_id"), "article_id", "left_anti").join(members.select(F.col("kept_id").alias("article_id")), "article_id", "left_anti").select(F.col("article_id").alias("kept_id"), F.lit(1).cast("long").alias("copies")))
