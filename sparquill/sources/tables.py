"""Reading: files into a catalog of views, JSON lines by three policies, workbooks, text search, parsed layouts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparquill.sources import sql_functions, workbooks

_CORRUPT = "_corrupt_record"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Parquet tables as temporary views of their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def view_name(name: str, taken: set[str]) -> str:
    """A SQL identifier from a file or sheet name; ``_1``, ``_2`` ... if it is taken."""
    base = re.sub(r"\W", "_", name).strip("_") or "table"
    base = f"t_{base}" if base[0].isdigit() else base
    out, n = base, 0
    while out.lower() in taken:
        n += 1
        out = f"{base}_{n}"
    taken.add(out.lower())
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def sheet_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Of ``workbooks.read`` of one file: each sheet as a table by its name, columns named by its first row.

    A column whose values are all numbers is a double, else a string; columns without a name are left out.
    """
    first = rows.groupBy("sheet").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("row")).collect()  # a row a sheet
    out = {}
    for sheet, head, row in sorted(first):
        taken: set[str] = set()
        cells = [(i, view_name(name.strip(), taken)) for i, name in enumerate(head) if name and name.strip()]
        body = rows.where((F.col("sheet") == sheet) & (F.col("row") > row)).select(*[F.get("cells", F.lit(i)).alias(name) for i, name in cells])
        numeric = body.agg(*[F.coalesce(F.bool_and(F.col(name).try_cast("double").isNotNull() | F.col(name).isNull()), F.lit(False)).alias(name) for _, name in cells]).first() if cells else {}
        out[sheet] = body.select(*[F.col(name).cast("double").alias(name) if numeric[name] else F.col(name) for _, name in cells])
    return out


class Catalog:
    """Files of several formats as temporary views; names are sanitized, clashes numbered. Queries may use ``sql_functions``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.views, self._taken = spark, {}, set()
        sql_functions.register(spark)

    def add(self, df: DataFrame, name: str) -> str:
        view = view_name(name, self._taken)
        df.createOrReplaceTempView(view)
        self.views[name] = view
        return view

    def add_file(self, path: str) -> list[str]:
        stem, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
        read = self.spark.read
        if kind in ("csv", "tsv", "txt"):
            return [self.add(read_csv(self.spark, path), stem)]
        if kind in ("json", "jsonl"):
            return [self.add(read.json(path), stem)]
        if kind in ("parquet", "orc"):
            return [self.add(read.format(kind).load(path), stem)]
        if kind == "xlsx":
            sheets = sheet_tables(workbooks.read(self.spark, path))
            return [self.add(made, sheet if len(sheets) > 1 else stem) for sheet, made in sheets.items()]
        raise ValueError(f"no reader for .{kind} files")

    def query(self, sql: str) -> DataFrame:
        """Any Spark SQL over the views; an unknown name is answered with what there is."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.sql(sql)
        except AnalysisException as e:
            known = "; ".join(f"{v}({', '.join(self.spark.table(v).columns)})" for v in self.views.values())
            raise ValueError(f"{str(e).splitlines()[0]} - tables: {known}") from e


def content_hash(spark: SparkSession, *paths: str) -> str:
    """SHA-256 over the digests of all files in order of their paths; file contents are hashed by the executors."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("h"))
    joined = files.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"])).alias("all"))
    return joined.select(F.sha2("all", 256)).first()[0]


def cached(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """``build()`` written under ``root/key`` once; later calls read it. The key should be a content hash."""
    path = f"{root.rstrip('/')}/{key}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- JSON lines


def _parsed(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"))
    kinds = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return lines.withColumn("_r", F.from_json("value", f"{kinds}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))


def _blank() -> Column:
    return F.trim("value") == ""


def _object() -> Column:
    return F.col(f"_r.{_CORRUPT}").isNull() & F.col("value").rlike(r"^\s*\{")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, policy: str = "strict", order: str | None = None) -> DataFrame:
    """JSON lines. ``strict``: a blank line or one that is no object raises an error when it is read; ``lenient``: blank
    lines are skipped, others must parse; ``skip``: what doesn't parse is skipped."""
    out = _by_policy(_parsed(spark, path, schema), policy).select("_r.*").drop(_CORRUPT)
    return out if order is None else out.orderBy(order)


def _by_policy(rows: DataFrame, policy: str) -> DataFrame:
    if policy == "skip":
        return rows.where(~_blank() & _object())
    if policy not in ("strict", "lenient"):
        raise ValueError(f"unknown policy {policy!r}")
    bad = ~_object() if policy == "strict" else ~_blank() & ~_object()
    error = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80))).cast("boolean")
    return rows.where(F.when(bad, error).otherwise(~_blank()))


def read_record_sets(spark: SparkSession, root: str, name: str, schema: StructType | str, without: tuple[str, ...] = (), ending: str = ".jsonl", policy: str = "lenient") -> DataFrame:
    """``root/*/name.jsonl`` of all folders but some, with the folder as ``doc_set``; each file once. Policies as in ``read_jsonl``."""
    rows = _parsed(spark, f"{root}/*/{name}{ending}", schema).withColumn("doc_set", F.element_at(F.split("_file", "/"), -2))
    return _by_policy(rows.where(~F.col("doc_set").isin(*without)), policy).select("_r.*", "doc_set").drop(_CORRUPT)


# ---- text and layouts


def grep(spark: SparkSession, path: str, pattern: str, most_bytes: int | None = None, most_chars: int | None = None, limit: int | None = None) -> DataFrame:
    """(file, line): all lines that match. Only if asked for: of files up to a size (``grep_skipped`` names the others), cut to a length, ``limit`` lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    if most_bytes is not None:
        lines = lines.where(F.col("size") <= most_bytes)
    line = F.col("value") if most_chars is None else F.substring("value", 1, most_chars)
    found = lines.where(F.col("value").rlike(pattern)).select("file", line.alias("line"))
    return found if limit is None else found.limit(limit)


def grep_skipped(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """(file, size): the files that ``grep`` leaves out for their size, from the listing alone."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") > most_bytes).select(F.col("path").alias("file"), F.col("length").alias("size"))


LAYOUT = "array<struct<type:string,text:string,text_level:int,page_idx:int,table_caption:array<string>,table_body:string>>"


def layout_blocks(raw: DataFrame, doc_id: str, json_col: str) -> DataFrame:
    """(doc_id, block_idx, type, text, text_level, page, caption, html): the blocks of a parsed layout in order."""
    blocks = raw.select(doc_id, F.posexplode(F.from_json(json_col, LAYOUT)).alias("block_idx", "b"))
    return blocks.select(
        doc_id, "block_idx", F.col("b.type").alias("type"), F.trim("b.text").alias("text"), F.col("b.text_level").alias("text_level"), F.col("b.page_idx").alias("page"),
        F.concat_ws(" ", "b.table_caption").alias("caption"), F.col("b.table_body").alias("html"),
    )
