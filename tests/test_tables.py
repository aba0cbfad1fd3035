"""Workbooks, keyed tables in files, table functions in SQL, sketches that merge."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparquill.operators import corpus as C
from sparquill.operators import profile
from sparquill.sources import tables, workbooks
from sparquill.sources.keyed import KeyedTable


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


# ---- workbooks


def test_workbook_cells_come_back(spark, tmp_path):
    sheets = {
        "甲 & <b>": [["a", None, 1.5, True], [], [None, "x\ny", " padded ", "\u0001bad"], ["a", "<&>\"'"]],
        "wide": [[None] * 27 + ["AB", False, 3]],
        "empty": [],
    }
    (tmp_path / "one.xlsx").write_bytes(workbooks.workbook_bytes(sheets))
    made = workbooks.read(spark, f"file://{tmp_path}/one.xlsx")
    assert made.rdd.getNumPartitions() == 3  # a sheet each
    assert rows(made, "sheet", "row", "cells") == sorted(
        [
            ("甲 & <b>", 1, ["a", None, "1.5", "TRUE"]),
            ("甲 & <b>", 3, [None, "x\ny", " padded ", "bad"]),
            ("甲 & <b>", 4, ["a", "<&>\"'"]),
            ("wide", 1, [None] * 27 + ["AB", "FALSE", "3"]),
        ],
        key=repr,
    )


def test_workbook_forms_of_other_writers(spark, tmp_path):
    """Inline and rich strings, rows and cells without references, absolute targets, no shared strings."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{links}"><sheets><sheet name="s" sheetId="9" r:id="x"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="x" Type="{links}/worksheet" Target="/xl/odd.xml"/></Relationships>')
        rich = '<c t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></is></c>'
        book.writestr("xl/odd.xml", f'<worksheet {main}><sheetData><row>{rich}<c><v>7</v></c><c/></row><row><c t="str"><f>A1</f><v>made</v></c></row></sheetData></worksheet>')
    (tmp_path / "odd.xlsx").write_bytes(out.getvalue())
    assert rows(workbooks.read(spark, f"file://{tmp_path}"), "row", "cells") == [(1, ["rich", "7", None]), (2, ["made"])]


def test_workbook_in_the_catalog(spark, tmp_path):
    sheets = {"pri ces": [["code", "price", None, "1 st"], ["a", 2, "skipped", "x"], ["b", 3.5], ["c", None, None, "7"]], "other": [["v"], ["w"]]}
    (tmp_path / "book.xlsx").write_bytes(workbooks.workbook_bytes(sheets))
    known = tables.Catalog(spark)
    assert known.add_file(f"file://{tmp_path}/book.xlsx") == ["other", "pri_ces"]
    assert rows(known.query("SELECT code, price, t_1_st FROM pri_ces")) == [("a", 2.0, "x"), ("b", 3.5, None), ("c", None, "7")]


def test_header_among_null_cells(spark):
    given = spark.createDataFrame([("s", 1, [None, "x"]), ("s", 2, ["编码", None, "数量"]), ("s", 3, ["a", None, "5"]), ("s", 4, [None, "b"])], "sheet string, row int, cells array<string>")
    made = C.rows_under_header(given, "sheet", "row", "cells", {"code": ["编码"], "n": ["数量"]})
    assert rows(made, "row", "code", "n") == [(3, "a", "5"), (4, None, None)]


# ---- keyed tables


def files(path):
    return {str(f.relative_to(path)) for f in path.glob("data/*/bucket=*/part-*")}


def test_keyed_table_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    kept = KeyedTable(spark, f"file://{tmp_path}/t", "k long, s string, v int", ["k", "s"], buckets=8)
    want = {}
    make = lambda some: spark.createDataFrame(some, "k long, s string, v int")
    for step in range(5):
        some = {(rng.choice([None, *range(30)]), rng.choice(["a", None])): rng.randrange(100) for _ in range(12)}
        given = make([(*k, v) for k, v in some.items()])
        if step == 3:
            kept.insert_absent(given)
            want = some | want
        else:
            kept.upsert(given, "v")
            want |= some
        gone = [k for k in want if rng.random() < 0.1]
        kept.delete(make([(*k, 0) for k in gone]))
        want = {k: v for k, v in want.items() if k not in gone}
        assert rows(kept.rows()) == sorted(((*k, v) for k, v in want.items()), key=repr)
    kept.vacuum()
    assert rows(kept.rows()) == sorted(((*k, v) for k, v in want.items()), key=repr)
    assert len(list((tmp_path / "t" / "heads").glob("*.json"))) == 1


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    kept = KeyedTable(spark, f"file://{tmp_path}", "k long, v int", ["k"], buckets=16)
    assert kept.upsert(spark.range(200).selectExpr("id AS k", "1 AS v")) == 16
    before = files(tmp_path)
    assert kept.upsert(spark.createDataFrame([(5, 2)], "k long, v int")) == 1
    kept.vacuum()
    after = files(tmp_path)
    assert len(before & after) == 15 and len(after) == 16 and rows(kept.rows().where("v = 2")) == [(5, 2)]
    assert kept.upsert(spark.createDataFrame([], "k long, v int")) == 0


def test_failure_before_the_head_leaves_the_old_table(spark, tmp_path, monkeypatch):
    kept = KeyedTable(spark, f"file://{tmp_path}", "k long, v int", ["k"], buckets=4)
    kept.upsert(spark.createDataFrame([(1, 1), (2, 1)], "k long, v int"))
    new = spark.createDataFrame([(1, 9), (3, 9)], "k long, v int")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_set_head", fails)
        with pytest.raises(OSError, match="lost"):
            kept.upsert(new)
    assert rows(kept.rows()) == [(1, 1), (2, 1)]
    for _ in range(2):  # done again, and once more
        kept.upsert(new)
        assert rows(kept.rows()) == [(1, 9), (2, 1), (3, 9)]


# ---- table functions


def test_table_functions(spark):
    known = tables.Catalog(spark)
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    docs = known.add(spark.createDataFrame([(1, "# 1 总则\n1.0.1 甲", html, ["x"]), (2, None, None, None)], "id int, text string, html string, cells array<string>"), "docs")
    assert rows(known.query(f"SELECT id, clause_no, chapter, clause FROM {docs}, LATERAL clauses(text)")) == [(1, "1.0.1", "1 总则", "1.0.1 甲")]
    assert rows(known.query(f"SELECT id, row, g.cells FROM {docs}, LATERAL table_grid(html) g")) == [(1, 0, ["a", "b"]), (1, 1, ["a", "c"])]
    named = known.query(f"SELECT id, p, q FROM {docs}, LATERAL named_cells(cells, 'p, q')")
    assert rows(named) == [(1, "x", None), (2, None, None)]
    with pytest.raises(ValueError, match="FAILED_TO_ANALYZE"):
        known.query(f"SELECT * FROM {docs}, LATERAL named_cells(cells, text)")


# ---- sketches


def test_sketches_merge_within_their_bounds(spark):
    """Quantiles within 2 % of rank, distinct counts within 6 %, over any union of the stored groups."""
    df = spark.range(60_000).selectExpr("id % 30 AS day", "CASE WHEN id % 97 > 0 THEN CAST((id * 7919) % 60000 AS DOUBLE) END AS v", "id % 20000 AS item")
    stored = profile.sketches(df, ["day"], "v", "item")
    for low, high in ((0, 30), (3, 5), (29, 30)):
        exact = df.where(f"day >= {low} AND day < {high}")
        made = profile.merged_sketches(stored.where(f"day >= {low} AND day < {high}"), [], [0.1, 0.5, 0.9]).first()
        values = sorted(r["v"] for r in exact.where("v IS NOT NULL").select("v").collect())
        assert made["n"] == len(values)
        for share, q in zip((0.1, 0.5, 0.9), made["quantiles"], strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - share) < 0.02
        distinct = exact.select(F.countDistinct("item")).first()[0]
        assert abs(made["distinct"] - distinct) < 0.06 * distinct
    none = profile.merged_sketches(profile.sketches(df.limit(0), ["day"], "v", "item"), ["day"], [0.5])
    assert none.count() == 0
