"""Incremental forms: new corpus files, duplicates by address, sliding counts, bounded health history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from presswell.operators.health import KEEP
from presswell.sources.corpus import CORPUS


def corpus_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of corpus files as they appear in a folder; the checkpoint of the query remembers which were read."""
    return spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").json(folder).withColumn("published_ts", F.to_timestamp("published_at"))


def distinct_urls(stream: DataFrame, time: str = "published_ts", late: str = "30 days", url: str = "url") -> DataFrame:
    """The first row of each address within the watermark; a row without a time passes once per address and batch window."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "/+$", "")
    return stream.withColumn("url_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["url_key"])


def windowed_counts(stream: DataFrame, time: str, by: list[str], length: str = "14 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per sliding window and group; a window is final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def trailing_health(observations: DataFrame) -> DataFrame:
    """source_id, at, raw_count, median_count, failures_before for each observation as it arrives.

    State per source: its last observations, never more than the history keeps.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, fails = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for pdf in batches:
            for r in pdf.sort_values("at").itertuples():
                good = sorted(c for c in counts[-8:] if c > 0)
                n = len(good)
                median = 0.0 if not n else float(good[n // 2]) if n % 2 else (good[n // 2 - 1] + good[n // 2]) / 2
                streak = next((i for i, f in enumerate(reversed(fails)) if not f), len(fails))
                out.append((key[0], r.at, int(r.raw_count), median, streak))
                counts, fails = [*counts, int(r.raw_count) if r.success else 0][-KEEP:], [*fails, bool(r.failed)][-KEEP:]
        state.update((counts, fails))
        yield pd.DataFrame(out, columns=["source_id", "at", "raw_count", "median_count", "failures_before"])

    return observations.groupBy("source_id").applyInPandasWithState(update, "source_id string, at timestamp, raw_count long, median_count double, failures_before int", "counts array<long>, fails array<boolean>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None) -> bool:
    """A scheduled run: append what has arrived since the last one to Parquet files, then stop. False if it did not end in time."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    ended = query.awaitTermination(timeout_s) if timeout_s else (query.awaitTermination(), True)[1]
    if not ended:
        query.stop()
    return bool(ended)
