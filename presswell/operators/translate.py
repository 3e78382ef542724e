"""Titles in another language: cached ones first, the rest through a provider that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.operators.relations import two_key_lookup
from presswell.tables import work_table

#: Failures without any success after which a provider is left alone for the rest of a task.
BREAKER = 3
Provider = Callable[[str, str], str]
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def is_translated(source: Column, target: Column) -> Column:
    return F.coalesce(target.rlike(HAN) & (target != source), F.lit(False))


def quality_issues(source: Column, target: Column, terms: Sequence[str] = ()) -> Column:
    """Codes of what is wrong with a translated title."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.contains(target, F.lit(t)), F.lit(t)) for t in terms])), ",") if terms else F.lit("")
    return F.array_compact(F.array(F.when(~is_translated(source, target), "not_traditional_chinese_translation"), F.when(missing != "", F.concat(F.lit("missing_terms:"), missing)), F.when(target.rlike(r"(?i)\b(?:error|forbidden|timeout|service unavailable)\b"), "provider_error_text")))


def translate_titles(articles: DataFrame, cache: DataFrame, providers: Sequence[tuple[str, Provider]]) -> tuple[DataFrame, DataFrame]:
    """(articles with title_zh_tw and translated_by, distinct titles sent to providers with who answered and how often each was tried).

    Titles in the cache (language, title, title_zh_tw; a null language serves all) and those already in the target script
    are not sent; each other distinct title is sent once, to one provider after the other until one answers. Without an
    answer the title stays empty.
    """
    known = two_key_lookup(articles.drop("title_zh_tw"), cache, "language", "title", "title_zh_tw")
    own = F.col("title").rlike(HAN)
    open_titles = known.filter(F.col("title_zh_tw").isNull() & ~F.coalesce(own, F.lit(True))).select("language", "title").distinct()
    names = [n for n, _ in providers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, bad = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for pdf in batches:
            rows = []
            for language, title in zip(pdf["language"], pdf["title"], strict=True):
                answer, by, tried = None, None, []
                for name, ask in providers:
                    if bad[name] >= BREAKER and not good[name]:
                        continue
                    tried.append(name)
                    try:
                        answer = ask(title, language) or None
                    except Exception:  # a provider may fail in any way
                        answer = None
                    if answer:
                        by = name
                        good[name] += 1
                        break
                    bad[name] += 1
                rows.append((language, title, answer, by, tried))
            yield pd.DataFrame(rows, columns=["language", "title", "answer", "by", "tried"])

    # written once: both results read it, and a provider must not be asked again
    answers = work_table(open_titles.mapInPandas(run, "language string, title string, answer string, by string, tried array<string>"), "answers")
    out = known.join(answers.select(F.col("language").alias("_l"), F.col("title").alias("_t"), "answer", "by"), F.col("language").eqNullSafe(F.col("_l")) & (F.col("title") == F.col("_t")), "left").drop("_l", "_t")
    done = F.coalesce("title_zh_tw", F.when(own, F.col("title")), F.col("answer"), F.lit(""))
    source = F.when(F.col("title_zh_tw").isNotNull(), "cache").when(own, "original").when(F.col("answer").isNotNull(), F.col("by")).otherwise("none")
    return out.withColumns({"translated_by": source, "title_zh_tw": done}).drop("answer", "by"), answers


def provider_stats(answers: DataFrame) -> DataFrame:
    """provider, attempts, successes, failures over the titles that were sent."""
    tried = answers.select(F.explode("tried").alias("provider"), "by")
    return tried.groupBy("provider").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("by") == F.col("provider")).alias("successes")).withColumn("failures", F.col("attempts") - F.col("successes"))
