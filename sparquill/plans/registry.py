"""The named queries of the library: each takes (spark, sf_dir) and has, where SQL can say it, an equivalent in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` gives the same rows and column names on the same tables."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    """A literal table, for queries on data that the given tables lack."""
    return spark.createDataFrame(list(values), schema)


#: The lines of an order numbered from 1 without ties (``l_linenumber`` itself may repeat), in both languages.
_ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
LINES = f"(SELECT * REPLACE (CAST({_ORDERED} AS INT) AS l_linenumber) FROM lineitem)"


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_linenumber", F.expr(_ORDERED))
