"""Profiles of tables: schema, non-null counts, column statistics, frequent values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from sparquill.operators.relational import bucket_of
from sparquill.sources.scratch import written

_KINDS = "column string, kind string, count long, nulls long, mean double, stddev double, min string, q25 double, median double, q75 double, max string, distinct long, mode string"


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def inspect(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null): one aggregate over all columns, unpivoted."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(rows))


_SHARES = (0.25, 0.5, 0.75)


def _quartiles(df: DataFrame, columns: list[str], cuts: list[list[float]], counts: list[int]) -> list[list[float | None]]:
    """Exact quartiles of each column, interpolated as ``percentile`` does; no task sees all values of a column.

    The counts of the values fall into buckets between approximate quantiles; the buckets' sums say in which ones the
    wanted places lie, and only in those values are counted up.
    """
    x = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*x))).where("x IS NOT NULL").groupBy("i", "x").agg(F.count("*").alias("n"))
    bucket = F.lit(0)
    for i, c in enumerate(cuts):
        bucket = F.when(F.col("i") == i, bucket_of(F.col("x"), c)).otherwise(bucket)
    values = written(values.withColumn("b", bucket), "values")
    sums = {(r["i"], r["b"]): r["n"] for r in values.groupBy("i", "b").agg(F.sum("n").alias("n")).collect()}  # 64 rows a column
    wanted = set()
    for i, n in enumerate(counts):
        for place in {p for s in _SHARES for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))} if n else ():
            before = 0
            for b in range(len(cuts[i]) + 1):
                if place < before + sums.get((i, b), 0):
                    wanted.add((i, b, place, place - before))
                    break
                before += sums.get((i, b), 0)
    if not wanted:
        return [[None] * len(_SHARES) for _ in columns]
    places = df.sparkSession.createDataFrame(sorted(wanted), "i int, b int, place long, rest long")
    near = values.join(F.broadcast(places.select("i", "b").distinct()), ["i", "b"])  # a literal table of a few rows
    near = near.withColumn("upto", F.sum("n").over(Window.partitionBy("i", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = near.join(F.broadcast(places), ["i", "b"]).where("upto > rest").groupBy("i", "place").agg(F.min("x").alias("x")).collect()
    at = {(r["i"], r["place"]): r["x"] for r in found}

    def value(i: int, n: int, share: float) -> float | None:
        if not n:
            return None
        place = share * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        return at[i, low] if at[i, low] == at[i, high] or low == high else (high - place) * at[i, low] + (place - low) * at[i, high]

    return [[value(i, n, s) for s in _SHARES] for i, n in enumerate(counts)]


def _numbers(df: DataFrame, columns: list[str], places: int) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        cuts = F.percentile_approx(x, [j / 64 for j in range(1, 64)], 1000)
        aggs.append(F.struct(F.count(x).alias("count"), F.count_if(x.isNull()).alias("nulls"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), cuts.alias("cuts")).alias(f"s{i}"))
    one = df.agg(*aggs).first()
    quarts = _quartiles(df, columns, [sorted({x for x in r["cuts"] or [] if x == x}) for r in one], [r["count"] for r in one])
    rows = [(c, "number", r["count"], r["nulls"], r["mean"], r["stddev"], r["min"], *q, r["max"], None, None) for c, r, q in zip(columns, one, quarts, strict=True)]
    made = df.sparkSession.createDataFrame(rows, _KINDS.replace("min string", "min double").replace("max string", "max double"))
    rounded = {c: F.round(c, places) for c in ("mean", "stddev", "q25", "median", "q75")}
    return made.withColumns(rounded | {c: F.col(c).cast("string") for c in ("min", "max")})


def summary(df: DataFrame, columns: list[str] | None = None, places: int = 6) -> DataFrame:
    """One row per column. Numbers: mean, sample deviation, least, quartiles (interpolated), greatest. Others: distinct, mode.

    All numeric columns are one aggregate, and their quartiles come from the counts of their values (``_quartiles``); the distinct values of each other column are counted first (``groupBy``),
    so that mode (ties: the least value) and distinct count are partial aggregates, too.
    """
    names = columns or df.columns
    numeric = [c for c in names if is_numeric(df, c)]
    out = []
    if numeric:
        out.append(_numbers(df, numeric, places))
    for c in names:
        if c in numeric:
            continue
        n = df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.count("*").alias("n"))
        real = F.col("v").isNotNull()
        out.append(
            n.agg(
                F.lit(c).alias("column"), F.lit("other").alias("kind"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("nulls"),
                *[F.lit(None).cast("double").alias(x) for x in ("mean", "stddev")], F.min("v").alias("min"), *[F.lit(None).cast("double").alias(x) for x in ("q25", "median", "q75")],
                F.max("v").alias("max"), F.count("v").alias("distinct"), F.min_by("v", F.when(real, F.struct(-F.col("n"), F.col("v")))).alias("mode"),
            )
        )
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def frequent(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n, pct): the ``k`` most frequent values and their share of all rows; ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    top = counts.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(k)
    return top.join(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct"))  # one row is broadcast


# ---- sketches that merge

#: Registers of a distinct sketch (2 ** 12: a standard error of 1.6 %) and size of a quantile sketch (rank error about 1 %).
LOG_REGISTERS, QUANTILE_SIZE = 12, 350


def sketches(df: DataFrame, by: list[str], value: str, item: str) -> DataFrame:
    """(by, n, quantiles, items): per group a quantile sketch of ``value`` and a distinct sketch of ``item``, as columns that can be stored.

    Raw rows are read once; any union of groups is then answered from the stored rows (``merged_sketches``). Null values and
    items are not counted.
    """
    quantiles = F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE)
    return df.groupBy(*by).agg(F.count(value).alias("n"), quantiles.alias("quantiles"), F.hll_sketch_agg(F.col(item).cast("string"), LOG_REGISTERS).alias("items"))


def merged_sketches(stored: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, n, distinct, quantiles): of the stored groups together, the estimates at ``shares`` as an array."""
    made = stored.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("q"), F.hll_union_agg("items").alias("d"))
    return made.select(*by, "n", F.hll_sketch_estimate("d").alias("distinct"), F.array(*[F.kll_sketch_get_quantile_double("q", F.lit(float(s))) for s in shares]).alias("quantiles"))
