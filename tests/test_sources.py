from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparquill.sources import sinks, tables


def test_view_names():
    taken: set[str] = set()
    assert [tables.view_name(n, taken) for n in ("my data", "my-data", "2024", "")] == ["my_data", "my_data_1", "t_2024", "table"]


def test_catalog_and_errors(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("k,v\n1,2.5\n2,\n")
    catalog = tables.Catalog(spark)
    assert catalog.add_file(f"file://{tmp_path}/a b.csv") == ["a_b"]
    assert catalog.query("SELECT sum(v) AS s FROM a_b").first()["s"] == 2.5
    with pytest.raises(ValueError, match="a_b"):
        catalog.query("SELECT * FROM nothing")
    with pytest.raises(ValueError):
        catalog.add_file("x.exe")


def test_json_lines_policies(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    read = lambda policy: tables.read_jsonl(spark, f"file://{path}", "a int", policy).collect()
    assert sorted(r["a"] for r in read("skip")) == [1, 2]
    for policy in ("strict", "lenient"):
        with pytest.raises(Exception, match="not a JSON object"):
            read(policy)
    path.write_text('{"a": 1}\n\n')
    assert [r["a"] for r in read("lenient")] == [1]
    with pytest.raises(Exception, match="not a JSON object"):
        read("strict")


def test_record_sets(spark, tmp_path):
    for doc in ("one", "two", "skip"):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "item.jsonl").write_text(json.dumps({"a": doc}) + "\n")
    found = tables.read_record_sets(spark, f"file://{tmp_path}", "item", "a string", without=("skip",))
    assert sorted((r["a"], r["doc_set"]) for r in found.collect()) == [("one", "one"), ("two", "two")]


def test_record_sets_with_malformed_lines(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "item.jsonl").write_text('{"a": "x"}\n\nnot json\n[1]\n')
    read = lambda policy: tables.read_record_sets(spark, f"file://{tmp_path}", "item", "a string", policy=policy).collect()
    assert [tuple(r) for r in read("skip")] == [("x", "one")]
    for policy in ("strict", "lenient"):
        with pytest.raises(Exception, match="not a JSON object"):
            read(policy)


def test_hash_and_cache(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    first = tables.content_hash(spark, f"file://{tmp_path}/in.txt")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, f"file://{tmp_path}/cache", first, build).count() == 3
    assert built == [1]
    (tmp_path / "in.txt").write_text("y")
    assert tables.content_hash(spark, f"file://{tmp_path}/in.txt") != first


def test_grep(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc\nxyz\nab\n")
    assert sorted(r["line"] for r in tables.grep(spark, f"file://{tmp_path}/a.txt", "^ab").collect()) == ["ab", "abc"]


def test_grep_of_large_files(spark, tmp_path):
    (tmp_path / "big.txt").write_text("abc def\n" * 200_000)
    (tmp_path / "small.txt").write_text("abc\n")
    path = f"file://{tmp_path}"
    assert tables.grep(spark, path, "^ab").count() == 200_001
    assert tables.grep(spark, path, "^ab", most_bytes=1_000_000, most_chars=2, limit=5).collect()[0]["line"] == "ab"
    assert [r["file"].rpartition("/")[2] for r in tables.grep_skipped(spark, path, 1_000_000).collect()] == ["big.txt"]


@pytest.mark.parametrize("parts", [1, 7])
def test_markdown_begins_with_its_head(spark, tmp_path, parts):
    """The files in order of their names are the table in the order of its rows."""
    df = spark.range(0, 40, 1, parts).select("id", F.concat(F.lit("r"), "id").alias("t"))
    for n in range(4):
        sinks.export(df, f"file://{tmp_path}/out{n}.md")
        lines = [x for f in sorted((tmp_path / f"out{n}.md").glob("part-*")) for x in f.read_text().splitlines()]
        assert lines == ["| id | t |", "| --- | --- |", *[f"| {i} | r{i} |" for i in range(40)]]


@pytest.mark.parametrize("kind", ["csv", "json", "md", "parquet"])
def test_exports(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string").withColumn("d", F.lit("2026-01-02").cast("date"))
    sinks.export(df, f"file://{tmp_path}/out.{kind}")
    if kind == "md":
        lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/out.md").collect()]
        assert "| 1 | a\\|b | 2026-01-02 |" in lines and "| id | t | d |" in lines
    else:
        read = spark.read.option("header", True) if kind == "csv" else spark.read
        assert read.format(kind).load(f"file://{tmp_path}/out.{kind}").count() == 2
    with pytest.raises(ValueError):
        sinks.export(df, "x.doc")


def test_split_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, reject_reason string")
    sinks.write_split(df, f"file://{tmp_path}/kept", f"file://{tmp_path}/rejected")
    assert spark.read.parquet(f"file://{tmp_path}/kept").columns == ["id"]
    for rows in ([(1, "a"), (2, "b")], [(3, "b")]):
        sinks.overwrite_partitions(spark.createDataFrame(rows, "id int, p string"), f"file://{tmp_path}/parts", ["p"])
    assert sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/parts").collect()) == [1, 3]
