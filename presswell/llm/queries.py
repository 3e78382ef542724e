"""Queries of the ten training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswell.llm import best, copies, history, langid, lines, mixing, packing, residue, spans
from presswell.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_articles(read_table(spark, d, "articles"))


def p1_why(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read_table(spark, d, "articles"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.seen_before(read_table(spark, d, "articles"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_members(read_table(spark, d, "articles"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(read_table(spark, d, "articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    articles = read_table(spark, d, "articles")
    return langid.mislabelled(articles).join(residue.residue_articles(articles), "article_id", "left_anti")


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(read_table(spark, d, "articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(read_table(spark, d, "articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return best.best_records(read_table(spark, d, "article_copies"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(read_table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.packed(read_table(spark, d, "documents")))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(read_table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_classes(read_table(spark, d, "documents"))


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_coverage(read_table(spark, d, "documents"))


def llm_queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}
