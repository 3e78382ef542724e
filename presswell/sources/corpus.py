"""Saved corpora of articles as JSON lines, read anew only where a file changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "source_id string, country string, source_name string, institution_type string, language string, title string, title_zh_tw string, summary string, url string, published_at string, published_date_local string, date_confidence string"
INDEXED = f"file string, line long, size long, mtime timestamp, {CORPUS}"


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of corpus files with file, size and mtime; broken lines are left out, the last line of a url within a file counts.

    A large file is read in several splits; lines are ordered by the place where their split begins, then within it.
    """
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(paths).select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = raw.select(F.col("file_path").alias("file"), "block", "line", F.col("file_size").alias("size"), F.col("file_modification_time").alias("mtime"), F.from_json("value", CORPUS).alias("r")).filter("r.url is not null").select("file", "block", "line", "size", "mtime", "r.*")
    last = rows.groupBy("file", "url").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("file", "url", "block")]), F.struct("block", "line")).alias("r"))
    return last.select("file", "r.line", "r.size", "r.mtime", *["url" if (c := field.split()[0]) == "url" else f"r.{c}" for field in CORPUS.split(", ")])


def refreshed(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index after a look at the folder: rows of vanished and changed files dropped, those of new and changed files added.

    files: file, size, mtime as they are now. Only the contents of new and changed files are read.
    """
    known = index.select("file", "size", "mtime").distinct()
    same = files.join(known, ["file", "size", "mtime"], "left_semi").select("file")
    changed = [r["file"] for r in files.join(same, "file", "left_anti").select("file").collect()]  # names, as any listing of files
    kept = index.join(same, "file", "left_semi")
    return kept.unionByName(read_corpus(index.sparkSession, changed).select(*index.columns)) if changed else kept


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """file, size, mtime of a folder's corpus files, without reading their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
