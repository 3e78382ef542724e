"""Sheets, manifests, cached results and kept state of a run."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.operators.classify import AUTHORITY, OTHER_AUTHORITY
from presswell.operators.lexicon import TOPICS
from presswell.operators.periods import Period, display_dates
from presswell.operators.rank import B, K1, MINIMUM
from presswell.sinks.articles import SCHEMA_VERSION, iso, sheet_data, sheet_rows, write_workbook
from presswell.sources.config import fingerprint

#: The article sheets, and the topics or levels of authority that a row of each must have.
LEGAL = ("PRODUCT", "CERT", "NIS2", "HYBRID")
OFFICIAL = tuple(name for name, _ in AUTHORITY[:3])
RESEARCH = (*(name for name, _ in AUTHORITY[3:]), OTHER_AUTHORITY)


def article_sheets(articles: DataFrame) -> dict[str, DataFrame]:
    """The article sheets: all, those with a legal topic, and those of official and of research bodies.

    articles: analysed articles (topics, authority_level). Each sheet is a filter of one set, so the sheets cost one scan
    each and no shuffle; a null list of topics is empty.
    """
    legal = F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, LEGAL))), F.lit(False))
    level = F.coalesce("authority_level", F.lit(""))
    return {"全部命中新聞": articles, "CRA_CSA_NIS2_CER": articles.filter(legal), "官方規範與執法": articles.filter(level.isin(*OFFICIAL)), "研究智庫與公私協力": articles.filter(level.isin(*RESEARCH))}


def sheet_sizes(articles: DataFrame) -> DataFrame:
    """sheet, n: rows of each article sheet, in one pass over the articles."""
    legal = F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, LEGAL))), F.lit(False))
    level = F.coalesce("authority_level", F.lit(""))
    on = (F.lit(True), legal, level.isin(*OFFICIAL), level.isin(*RESEARCH))
    names = F.array(*[F.when(c, F.lit(n)) for n, c in zip(article_sheets(articles), on, strict=True)])
    return articles.select(F.explode(F.array_compact(names)).alias("sheet")).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


def yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "是").otherwise("否")


def status_sheet(status: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source under the sheet's headers; figures that a run doesn't have are left out, newest dates are ISO text."""
    names = sources.select(F.col("id").alias("source_id"), "country", F.col("name_zh").alias("_name")).dropDuplicates(["source_id"])
    known = {"raw": "原始筆數", "in_range": "期間內筆數", "dated": "有日期筆數", "undated_ratio": "無日期比例", "unique_title_ratio": "唯一標題比例", "lag_days": "新鮮度落後天數", "parse_status": "解析狀態", "freshness_status": "新鮮度狀態", "health_status": "健康狀態", "median_count": "歷史原始筆數中位數", "error_code": "錯誤碼"}
    rows = status.join(names, "source_id", "left")
    newest = iso(F.timestamp_micros("newest_micros")) if "newest_micros" in status.columns else F.lit(None).cast("string")
    shown = [F.col("source_id").alias("來源代碼"), F.col("country").alias("國家"), F.col("_name").alias("機關"), yes(F.col("critical")).alias("必要來源"), newest.alias("最新日期")]
    return sheet_rows(rows.select(*shown, *[F.col(c).alias(label) for c, label in known.items() if c in status.columns]))


def source_sheet(sources: DataFrame) -> DataFrame:
    """The settings of each source as the sheet lists them."""
    known = {"id": "來源代碼", "country": "國家", "name_zh": "機關", "name": "原文名稱", "institution_type": "機關屬性", "language": "語言", "homepage": "首頁", "listing_url": "列表頁", "feed_urls": "RSS", "timezone": "時區", "date_policy": "日期政策"}
    return sheet_rows(sources.select(*[F.col(c).alias(label) for c, label in known.items() if c in sources.columns]))


def coverage_sheet(matrix: DataFrame) -> DataFrame:
    """The coverage matrix as text, a cell without owners left empty."""
    return sheet_rows(matrix)


def settings_sheet(spark: SparkSession, digest: str = "", modules: int = 0) -> DataFrame:
    """Setting and value of the filter that a run used."""
    rows = [("filter_method", "boolean_then_bm25"), ("bm25_k1", str(K1)), ("bm25_b", str(B)), ("minimum_bm25_score", str(MINIMUM)), ("organisation_registry_hash", digest), ("organisation_module_count", str(modules))]
    return spark.createDataFrame(rows, ["設定", "值"])


def metadata_sheet(spark: SparkSession, run_id: str, period: Period, rows: int) -> DataFrame:
    """Key and value of what a workbook says about its run."""
    first, last = display_dates(period.since, period.until)
    values = {"run_id": run_id, "schema_version": SCHEMA_VERSION, "period_mode": period.mode, "since_utc": period.since.isoformat(), "until_exclusive_utc": period.until.isoformat(), "first_day": first.isoformat(), "last_day": last.isoformat(), "article_count": rows}
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def run_workbook(path: str | Path, articles: DataFrame, status: DataFrame, sources: DataFrame, matrix: DataFrame, run_id: str, period: Period, digest: str = "", modules: int = 0) -> Path:
    """The whole workbook of a run: four article sheets, status, sources, coverage, settings and metadata."""
    spark = articles.sparkSession
    sheets = {name: sheet_data(df) for name, df in article_sheets(articles).items()}
    for name, df in (("來源健康狀態", status_sheet(status, sources)), ("官方來源清單", source_sheet(sources)), ("議題主管機關覆蓋", coverage_sheet(matrix)), ("篩選設定", settings_sheet(spark, digest, modules)), ("_run_metadata", metadata_sheet(spark, run_id, period, articles.count()))):
        sheets[name] = sheet_data(df)
    return write_workbook(path, sheets)


def run_manifest(run_id: str, period: Period, status: DataFrame, summary: DataFrame, quality: DataFrame, outcome: str, row_counts: dict[str, int]) -> dict[str, Any]:
    """The manifest of a run from its reports: one-row tables and one row per source reach the driver, never articles.

    row_counts: lines of each JSON-lines file, by its name; bundle verification counts them again.
    """
    one = lambda df: (r.asDict(recursive=True) if (r := df.first()) else {})
    return {
        "schema_version": SCHEMA_VERSION, "run_id": run_id, "status": outcome, "period": {"since": period.since.isoformat(), "until": period.until.isoformat(), "mode": period.mode},
        "source_summary": one(summary), "date_quality": one(quality), "row_counts": row_counts, "sources": [r.asDict(recursive=True) for r in status.orderBy("source_id").collect()],
    }


def content_problems(target: str | Path, manifest: dict[str, Any], required: tuple[str, ...] = ()) -> list[str]:
    """What a bundle's files say other than its manifest: missing kinds, row counts, run, schema and period of every line."""
    target = Path(target)
    names = {a["name"] for a in manifest.get("artifacts", [])}
    out = [f"required {r}" for r in required if not any(n == r or n.endswith(r) for n in names)]
    period = manifest.get("period", {})
    for name, n in manifest.get("row_counts", {}).items():
        lines = 0
        wrong: set[str] = set()
        if not (target / name).is_file():
            out.append(f"missing {name}")
            continue
        with open(target / name, encoding="utf-8") as f:
            for line in filter(str.strip, f):
                lines += 1
                try:
                    row = json.loads(line)
                except ValueError:
                    wrong.add("line")
                    continue
                wrong |= {k for k in ("run_id", "schema_version") if row.get(k) != manifest.get(k)}
                at = row.get("published_at")
                if at and period and not name.endswith(".corpus.jsonl") and not period["since"] <= at < period["until"]:
                    wrong.add("period")
        out += [f"{w} {name}" for w in sorted(wrong)] + ([f"rows {name}"] if lines != n else [])
    return out


def cached_search(folder: str | Path, settings: dict[str, Any], found: DataFrame, shown: DataFrame) -> tuple[Path, bool]:
    """The workbook of a search, kept under the fingerprint of its settings and corpus; the flag says whether it was there."""
    path = Path(folder) / f"search-{fingerprint(settings)}.xlsx"
    if path.exists():
        return path, True
    path.parent.mkdir(parents=True, exist_ok=True)
    return write_workbook(path, {"results": sheet_data(found), "settings": sheet_data(shown)}), False


def save_state(state: DataFrame, path: str, by: str) -> None:
    """Keep health, translation or audit state: only the partitions of `by` that the new rows have are replaced."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The kept state; before the first run, an empty table of the schema."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def topic_names(codes: Column) -> Column:
    """The names of topic codes, in their order."""
    names = F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.element_at(names, c), c))
