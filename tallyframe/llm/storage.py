"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import shared_dir, staged

__all__ = ["discard", "free_names", "new_path", "set_aside", "shared_dir", "small_batches", "staged"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Python workers get at most so many rows at a time, so that neither they nor the executors hold more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that no column of ``df`` has, in whatever case."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns called ``names``, in whatever case, renamed; and what gives them their names back."""
    own = [c for c in df.columns if c.lower() in names]
    other = free_names(df, *own)
    return df.withColumnsRenamed(dict(zip(own, other, strict=True))), dict(zip(other, own, strict=True))


def discard(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later step reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
