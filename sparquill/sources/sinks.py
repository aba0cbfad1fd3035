"""Writing: exports by file ending, fixed-column summaries, kept and rejected rows, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(df: DataFrame) -> DataFrame:
    """Values as text formats hold them: dates and times ISO, bytes in hex, nested values as JSON."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "binary":
            c = F.lower(F.hex(c))
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def markdown_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a Markdown table row; a bar in a cell is escaped, a line feed is a blank."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return plain(df).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def export(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV, JSON lines, Markdown or Parquet files, by the ending of ``path``; every task writes its rows."""
    kind = path.rpartition(".")[2].lower()
    if kind == "csv":
        plain(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        plain(df).write.mode(mode).json(path)
    elif kind == "md":
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string").coalesce(1)
        head.union(markdown_lines(df)).write.mode(mode).text(path)  # one write: files are named by partition, and the head's is the first
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def console(df: DataFrame, rows: int = 20, width: int = 40) -> None:
    df.show(rows, truncate=width)


def write_summary(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV of fixed columns; what is missing is empty."""
    df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split(df: DataFrame, kept: str, rejected: str, reason: str = "reject_reason") -> None:
    """Rows without a reason to one folder, the others with it to another."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(kept)
    df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(rejected)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Delete and insert by key range: only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rewrite_without(df: DataFrame, condition: Column, path: str) -> None:
    """Delete: all rows but those where the condition is true, in a new folder."""
    df.where(~F.coalesce(condition, F.lit(False))).write.mode("errorifexists").parquet(path)
