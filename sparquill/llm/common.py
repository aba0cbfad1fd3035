"""Helpers shared by the corpus operators: scratch tables and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparquill.sources.scratch import ONE_ROW_GROUPS, arrow_rows, shared_folder

__all__ = ["KEY", "ONE_ROW_GROUPS", "SPACE", "WORD", "arrow_rows", "documents", "free_name", "key_id_text", "keyed", "materialize", "raw_texts", "scratch"]

#: ASCII white space as the contracts name it: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
KEY = "_row_key"


_written: list[str] = []


def materialize(df: DataFrame, label: str, keep: bool = False, **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back, which cuts its lineage.

    ``scratch`` deletes what is written within it, unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not keep:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written within, so that a long session doesn't fill the shared folder.

    Results must be written (``keep``) or collected before it ends.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _written[before:]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a further column of unique longs, and that column's name, which no column of ``docs`` has.

    The id itself serves where it is an integer, unique and never null. Else (repeated rows, null or text ids) every
    row gets a number of its own, fixed by writing the numbered rows to the shared folder.
    """
    name = free_name(docs, KEY)
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        clash = docs.groupBy(F.col(id_col).alias("i")).count().where("i IS NULL OR count > 1").limit(1)
        if not clash.take(1):
            return docs.withColumn(name, F.col(id_col).cast("long")), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def key_id_text(docs: DataFrame, id_col: str, text_col: str, key: str | None) -> DataFrame:
    """(``_row_key``, id, text) of ``docs``: unique longs, from the column ``key`` if there is one, and nothing else.

    Ids that are no integers give way to the row's number, by which rows are then ordered, told apart and joined back.
    """
    if key is None:
        docs, key = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
        id_col, text_col = "id", "text"
    own = id_col if isinstance(docs.schema[id_col].dataType, IntegralType) else key
    return docs.select(F.col(key).alias(KEY), F.col(own).cast("long").alias("id"), F.col(text_col).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def raw_texts(values: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column (a null's are empty), one at a time."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield bytes(view[a:b])
