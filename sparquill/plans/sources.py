"""Source and sink queries: whole tables written in a format and read again, and point reads over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.functions import text as T
from sparquill.functions.values import first_key
from sparquill.operators import corpus as C
from sparquill.operators import relational as R
from sparquill.operators import retrieval as S
from sparquill.plans.registry import query
from sparquill.sources import sinks, tables, workbooks
from sparquill.sources.keyed import KeyedTable
from sparquill.sources.scratch import shared_folder
from sparquill.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS INT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported to CSV, read with an inferred schema."""
    path = f"{_folder(spark, 'csv')}/customer.csv"
    sinks.export(table(spark, sf_dir, "customer"), path)
    return tables.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_long_texts", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def csv_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line feeds through CSV."""
    path = f"{_folder(spark, 'csv')}/documents.csv"
    sinks.export(table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b"), F.lit('a "b", c\nd').alias("odd")), path)
    back = tables.read_csv(spark, path).where(F.col("odd") == 'a "b", c\nd')
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.unbase64(F.regexp_replace("b", r"\s", ""))).alias("digest"))


def _lines(spark: SparkSession, sf_dir: str, spoiled: bool) -> str:
    """Documents as JSON lines; of the spoiled ones every seventh is cut off, and every fifth is blank."""
    path = f"{_folder(spark, 'jsonl')}/documents.jsonl"
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("value"))
    if spoiled:
        d = d.withColumn("value", F.when(F.col("doc_id") % 7 == 0, F.substring("value", 1, 9)).when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("value")))
    d.select("value").write.text(path)
    return path


_JSON = "doc_id long, lang string, text string"


@query("jsonl_strict", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_jsonl(spark, _lines(spark, sf_dir, False), _JSON, "strict").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("jsonl_lenient", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE doc_id % 2 = 1")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines between the others are skipped."""
    path = f"{_folder(spark, 'jsonl')}/documents.jsonl"
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 1, F.to_json(F.struct("doc_id", "lang", "text"))).otherwise("").alias("value"))
    d.write.text(path)
    return tables.read_jsonl(spark, path, _JSON, "lenient").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("jsonl_skip", "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def jsonl_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_jsonl(spark, _lines(spark, sf_dir, True), _JSON, "skip").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("record_sets", "SELECT doc_id, source AS doc_set FROM documents WHERE source <> (SELECT min(source) FROM documents)")
def record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines a source, all of them read but one; the folder's name is the set."""
    root, d = _folder(spark, "sets"), table(spark, sf_dir, "documents").where("source IS NOT NULL")
    d.select("source", F.to_json(F.struct("doc_id")).alias("value")).repartition("source").write.partitionBy("source").text(root)
    left_out = d.agg(F.min("source")).first()[0]
    lines = tables.read_record_sets(spark, root, "part-*", "doc_id long", (f"source={left_out}",), ending="*")
    return lines.select("doc_id", F.regexp_replace("doc_set", "^source=", "").alias("doc_set"))


@query("catalog_sql", "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) > 0 AS paid FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def catalog_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV and a Parquet file as views of one catalog."""
    path = f"{_folder(spark, 'catalog')}/1 customers.csv"
    sinks.export(table(spark, sf_dir, "customer"), path)
    known = tables.Catalog(spark)
    (customers,), (orders,) = known.add_file(path), known.add_file(f"{sf_dir}/orders.parquet")
    return known.query(f"SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) > 0 AS paid FROM {customers} JOIN {orders} ON o_custkey = c_custkey GROUP BY 1")


@query(
    "catalog_functions",
    """
    SELECT o_custkey, count(*) AS clauses, CAST(sum(length('1.0.1 甲' || o_orderkey)) AS BIGINT) AS chars, max(o_orderstatus) AS last FROM orders GROUP BY o_custkey
    """,
)
def catalog_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's SQL that calls library operators as table functions, one with a schema that the call names."""
    known = tables.Catalog(spark)
    text = F.concat_ws("\n", F.lit("# 1 总则"), F.concat(F.lit("1.0.1 甲"), "o_orderkey"), F.lit("# 条文说明"), F.lit("1.0.2 乙"))
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus")
    docs = known.add(table(spark, sf_dir, "orders").select("o_custkey", text.alias("text"), cells.alias("cells")), "texts")
    return known.query(
        f"""SELECT o_custkey, count(*) AS clauses, CAST(sum(length(clause)) AS BIGINT) AS chars, max(status) AS last
        FROM {docs}, LATERAL clauses(text), LATERAL named_cells(cells, 'number, status') GROUP BY o_custkey"""
    )


@query(
    "workbook_scan",
    "SELECT p_brand || '.xlsx' AS file, 'size ' || (p_size % 3) AS sheet, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part",
)
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each brand, written and read again sheet by sheet: a title, a header to be found, rows, and after blank rows a note to be left out."""
    path = _folder(spark, "workbooks")
    sheet = F.concat(F.lit("size "), F.col("p_size") % 3)
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), sheet.alias("sheet"), F.col("p_partkey").alias("n"), F.array(F.lit(None), F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")).alias("cells"))
    ends = p.groupBy("file", "sheet").agg(F.max("n").alias("last"))
    line = lambda n, *cells: ends.select("file", "sheet", n.alias("n"), F.array(*[F.lit(c) for c in cells]).alias("cells"))
    every = p.unionByName(line(F.lit(-2), "清单", None)).unionByName(line(F.lit(-1), None, "项目编码", "项目名称", "规格"))
    for i in range(1, 4):
        every = every.unionByName(line(F.col("last") + i, None, None))
    every = every.unionByName(line(F.col("last") + 4, "注", "项目", "合计", "0"))
    workbooks.write_each(every, path, "file", "sheet", "n", "cells")
    rows = workbooks.read(spark, path)
    return _under_headers(rows)


def _under_headers(rows: DataFrame) -> DataFrame:
    """Rows of every sheet under its header, up to the first gap of three rows."""
    named = rows.withColumn("book", F.concat_ws("/", "file", "sheet"))
    below = C.rows_under_header(named, "book", "row", "cells", {"code": ["编码"], "name": ["名称"], "size": ["规格"]})
    gap = F.col("row") - F.coalesce(F.lag("row").over(Window.partitionBy("book").orderBy("row")), F.col("row"))
    after = F.max((gap > 3).cast("int")).over(Window.partitionBy("book").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    kept = below.withColumn("after", after).where("after = 0")
    return kept.select(F.substring_index("book", "/", 1).alias("file"), F.substring_index("book", "/", -1).alias("sheet"), "code", "name", "size")


@query(
    "keyed_updates",
    """
    WITH new AS (SELECT o_custkey AS k, max(o_totalprice) AS balance FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    u AS (SELECT c_custkey AS k, coalesce(new.balance, c_acctbal) AS balance FROM customer LEFT JOIN new ON k = c_custkey
          UNION ALL SELECT k, balance FROM new WHERE k NOT IN (SELECT c_custkey FROM customer)),
    i AS (SELECT * FROM u UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_suppkey + 1000000 NOT IN (SELECT k FROM u))
    SELECT k, balance FROM i WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
)
def keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert, insert-if-absent and delete by key on a table in files."""
    kept = KeyedTable(spark, _folder(spark, "keyed"), "k long, balance double", ["k"], buckets=16)
    customer = table(spark, sf_dir, "customer")
    kept.upsert(customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")), "balance")
    kept.upsert(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("balance")), F.desc("balance"))
    kept.insert_absent(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_acctbal").alias("balance")))
    kept.delete(customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")))
    return kept.rows()


@query("cached_build", "SELECT n_nationkey, n_name, 1 AS builds FROM nation")
def cached_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once under the hash of its input's bytes; the second call reads what the first has written."""
    root, builds = _folder(spark, "cache"), []

    def build() -> DataFrame:
        builds.append(1)
        return table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    for _ in range(2):
        made = tables.cached(spark, root, tables.content_hash(spark, f"{sf_dir}/nation.parquet"), build)
    return made.withColumn("builds", F.lit(len(builds)))


@query("grep_lines", "SELECT item_id, text AS line FROM (SELECT item_id, unnest(string_split(item_id || ' ' || replace(text, chr(10), ' '), chr(10))) AS text FROM benchmark) WHERE regexp_matches(text, '[aeiou]{3}')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "text")
    table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))).write.text(path)
    found = tables.grep(spark, path, "[aeiou]{3}")
    return found.select(F.substring_index("line", " ", 1).cast("long").alias("item_id"), "line")


@query("json_export", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_totalprice FROM orders")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'export')}/orders.jsonl"
    sinks.export(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return spark.read.schema("o_orderkey long, o_orderdate string, o_totalprice double").json(path)


@query("markdown_export", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation UNION ALL SELECT '| n_nationkey | n_name |' UNION ALL SELECT '| --- | --- |'")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'export')}/nation.md"
    sinks.export(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.text(path)


@query("summary_file", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "summary")
    sinks.write_summary(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_name", "note"])
    return spark.read.schema("n_nationkey string, n_name string, note string").option("header", True).csv(path)


@query("split_files", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'open' END AS reject_reason FROM orders")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows in one folder, rejected ones with their reason in another."""
    root = _folder(spark, "split")
    marked = R.split_by_reason(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), small=F.col("o_totalprice") < 100000, open=F.col("o_orderstatus") == "P")
    sinks.write_split(marked, f"{root}/kept", f"{root}/rejected")
    return spark.read.parquet(f"{root}/kept").unionByName(spark.read.parquet(f"{root}/rejected"), allowMissingColumns=True).select("o_orderkey", "reject_reason")


@query("appended_lines", "SELECT event_id, user_id FROM events")
def appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one folder of JSON lines."""
    path, e = _folder(spark, "journal"), table(spark, sf_dir, "events").select("event_id", "user_id")
    for part in (0, 1):
        sinks.append_json(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema("event_id long, user_id long").json(path)


@query("replaced_partitions", "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 0.0 ELSE o_totalprice END AS price FROM orders")
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, o = _folder(spark, "ranges"), table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice AS price")
    sinks.overwrite_partitions(o, path, ["o_orderstatus"])
    sinks.overwrite_partitions(o.where("o_orderstatus = 'P'").withColumn("price", F.lit(0.0)), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "price")


@query("deleted_threads", "SELECT event_id, user_id FROM events WHERE NOT (user_id % 3 = 0 AND event_type = 'error')")
def deleted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "deleted")
    sinks.rewrite_without(table(spark, sf_dir, "events"), F.expr("user_id % 3 = 0 AND event_type = 'error'"), path)
    return spark.read.parquet(path).select("event_id", "user_id")


# ---- point reads and small filters


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.point_get(table(spark, sf_dir, "orders"), "o_custkey", 7, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("owner_scope", "SELECT event_id, user_id FROM events WHERE user_id = 7 UNION ALL SELECT event_id, -1 FROM events")
def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's rows, and all of them where the scope is bypassed."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return R.owned(e, 7).unionByName(R.owned(e, None, bypass=True).withColumn("user_id", F.lit(-1).cast("long")))


@query("clamped_limits", "(SELECT p_partkey, 100 AS most FROM part ORDER BY p_partkey LIMIT 100) UNION ALL (SELECT p_partkey, 20 FROM part ORDER BY p_partkey LIMIT 20) UNION ALL (SELECT p_partkey, 1 FROM part ORDER BY p_partkey LIMIT 1)")
def clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for 5000 rows, none given, and -3."""
    p = table(spark, sf_dir, "part").select("p_partkey").orderBy("p_partkey")
    some = [p.limit(R.clamped(n)).withColumn("most", F.lit(R.clamped(n))) for n in (5000, None, -3)]
    return some[0].unionByName(some[1]).unionByName(some[2])


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, 42, "o_orderkey")


@query("marker_penalties", "SELECT p_partkey, 0.1 * (CASE WHEN contains(p_name, 'cold') AND p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'widget') THEN 1 ELSE 0 END) AS penalty FROM part")
def marker_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("p_size") % 2 == 1, "cold water").otherwise("water")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.marker_penalty(F.col("p_name"), asked, ["cold", "widget"]), 6).alias("penalty"))


@query("first_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(props->>'$.k' AS DOUBLE) ELSE value END AS v FROM events")
def first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two keys that holds a number."""
    doc = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"k": "none", "value": '), F.col("value").cast("string"), F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", first_key(doc, "k", "value").alias("v"))


@query(
    "exemplars",
    """
    WITH c AS (SELECT p_partkey AS id, p_brand AS edition, p_size % 2 = 0 AS verified, replace(replace(p_name, ' ', ''), 'x', '') AS s FROM part WHERE p_brand = 'Brand#2'),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, CAST(i AS INT), 2))) AS g, ['re', 'ed', 'dw', 'wi', 'id', 'dg', 'ge', 'et'] AS q FROM c),
    j AS (SELECT id, verified, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS similarity FROM g)
    SELECT * FROM j WHERE similarity >= 0.12 ORDER BY verified DESC, similarity DESC, id LIMIT 5
    """,
)
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS edition", "p_size % 2 = 0 AS verified", "p_name AS feature")
    near = T.jaccard(T.grams(F.col("feature")), T.grams(F.lit("red widget")))
    return S.exemplars(cases, "Brand#2", near).select("id", "verified", "similarity")
