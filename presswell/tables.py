"""Reading the project's tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the data directory; zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a temporary one, on one machine alone (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='presswell-')}"
        folder = _own[app]
    return folder.rstrip("/")


def work_table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back.

    It cuts the lineage, survives the loss of executors, and lets several later steps prune columns from one copy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/presswell-work/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, before a narrow pass that costs much per row.

    Only an input of fewer parts than cores is moved, such as one small file; anything larger already keeps them busy. A
    plan with a shuffle in it is left to adaptive execution: counting its parts would run it.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < plan.toRdd().getNumPartitions() < cores else df


def drop_work_tables(spark: SparkSession) -> None:
    """Remove what work_table has left in the shared folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/presswell-work")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def public_tokenizer(name: str) -> str:
    """Path of a public vocabulary file; PRESSWELL_TOKENIZERS overrides the folder."""
    return os.path.join(os.environ.get("PRESSWELL_TOKENIZERS", "/opt/tokenizers"), name)
