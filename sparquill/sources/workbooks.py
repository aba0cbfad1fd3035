"""Workbooks (.xlsx) without a workbook package: a batch data source with a partition a sheet, and a small writer.

A workbook is a zip of XML: shared strings and a file per sheet, which is read as a stream, row by row, so that a task holds
the shared strings and one row. ``read`` gives (file, sheet, row, cells): row numbers as in the sheet, cells as strings by
column, null where there is none; numbers as the file has them, truths as TRUE and FALSE. Rows without a cell are left out,
as the file leaves them out. Header scoring and the stop after blank rows are operators on these rows
(``operators.corpus.rows_under_header``, ``operators.relational.until_blank_run``).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparquill.sources.scratch import place_of

SCHEMA = "file string, sheet string, row int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 4096


def _column(ref: str) -> int:
    """A1 -> 0, B7 -> 1, AA3 -> 26."""
    n = 0
    for c in ref.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """The text runs of a string item; phonetic readings are left out."""
    return "".join(t.text or "" for part in (node, *node.findall(f"{_MAIN}r")) for t in part.findall(f"{_MAIN}t"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file in the zip) of every sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    where = [(s.get("name"), links[s.get(_LINK)]) for s in found]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in where]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell.find(f"{_MAIN}is"))
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else ("TRUE" if v.text == "1" else "FALSE") if kind == "b" else v.text


def sheet_rows(book: zipfile.ZipFile, target: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet, one after the other."""
    shared, last = _strings(book), 0
    with book.open(target) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{_MAIN}row":
                continue
            last = int(node.get("r", last + 1))
            cells: list[str | None] = []
            for c in node.findall(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(c, shared)
            node.clear()
            if any(c is not None for c in cells):
                yield last, cells


class _Sheet(InputPartition):
    def __init__(self, file: str, name: str, target: str):
        self.file, self.name, self.target = file, name, target


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = place_of(self.path)
        info = system.get_file_info(root)
        files = [root] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".xlsx"))
        out = []
        for file in files:
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                out += [_Sheet(file, name, target) for name, target in _sheets(book)]
        return out

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        system, _ = place_of(self.path)
        kinds = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
        with system.open_input_file(partition.file) as f, zipfile.ZipFile(f) as book:
            held: list[dict] = []
            for row, cells in sheet_rows(book, partition.target):
                held.append({"file": partition.file.rsplit("/", 1)[-1], "sheet": partition.name, "row": row, "cells": cells})
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, kinds)


class Workbooks(DataSource):
    """Option ``path``: a workbook or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of a workbook, or of all workbooks in a folder."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").option("path", path).load()


# ---- writing

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_bytes(sheets: dict[str, Iterable[list]]) -> bytes:
    """A workbook of sheets by name; a row is a list of strings, numbers, truths and nulls. Strings are shared."""
    shared: dict[str, int] = {}
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for k, rows in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate(rows, 1):
                cells = []
                for i, v in enumerate(row):
                    if v is None:
                        continue
                    kind, text = ("b", int(v)) if isinstance(v, bool) else ("n", v) if isinstance(v, int | float) else ("s", shared.setdefault(_NO_XML.sub("", str(v)), len(shared)))
                    cells.append(f'<c r="{_name(i)}{r}" t="{kind}"><v>{text}</v></c>')
                if cells:
                    lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        n = len(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1))
        kinds += '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>'
        book.writestr("[Content_Types].xml", _PARTS["[Content_Types].xml"].format(kinds))
        book.writestr("_rels/.rels", _PARTS["_rels/.rels"])
        links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        names = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{links}"><sheets>{names}</sheets></workbook>')
        parts = "".join(f'<Relationship Id="rId{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1))
        parts += f'<Relationship Id="rId{n + 1}" Type="{links}/sharedStrings" Target="sharedStrings.xml"/>'
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{parts}</Relationships>')
        strings = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
    return out.getvalue()


def write_each(rows: DataFrame, path: str, file: str, sheet: str, order: str, cells: str) -> int:
    """A workbook for each value of ``file`` under ``path``, its sheets by name and their rows in order, written by the executors; returns their number.

    A workbook is made in one task's memory, so it should be small by nature, as workbooks are.
    """

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sheets = {name: [list(c) for c in some[cells]] for name, some in part.sort_values([sheet, order]).groupby(sheet, sort=True)}
        system, root = place_of(path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{key[0]}.xlsx.part") as f:
            f.write(workbook_bytes(sheets))
        system.move(f"{root}/{key[0]}.xlsx.part", f"{root}/{key[0]}.xlsx")  # a retried task writes the same file again
        return pd.DataFrame({"file": [str(key[0])]})

    return rows.select(file, sheet, order, cells).groupBy(file).applyInPandas(one, "file string").count()
