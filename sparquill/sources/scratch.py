"""Tables written between rounds of an iteration: their lineage ends there, and any executor can read them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a local master, a folder of this machine, which is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='sparquill-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str, **options: object) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Write options for rows of megabytes: a row group each, so that readers hold one at a time.
ONE_ROW_GROUPS = {"parquet.block.row.count.limit": 1}


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions within pass Arrow batches of at most ``rows`` rows, for rows of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it, for code that runs in Python workers, where there is no Spark."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
