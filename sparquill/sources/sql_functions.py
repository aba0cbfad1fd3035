"""Library operators as table functions for user SQL: ``SELECT ... FROM docs, LATERAL clauses(text)``.

``clauses(text)`` is the segmentation of a standard, ``table_grid(html)`` the rows of each table of an HTML page as a full grid, and
``named_cells(cells, 'a, b, ...')`` turns an array of cells into columns with the names that the query gives, each a string, so
its schema depends on the call. They keep no state between rows; Spark runs them where the rows are.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sparquill.operators.corpus import clauses_of, table_grids


class _Clauses:
    def eval(self, text: str):
        for n, c in enumerate(clauses_of(text)):
            yield n, c["clause_no"], " > ".join(c["chapter_path"]), c["text"]


class _Grid:
    def eval(self, html: str):
        for n, grid in enumerate(table_grids(html)):
            for row, cells in enumerate(grid):
                yield n, row, cells


class _Named:
    @staticmethod
    def analyze(cells: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not names.isConstantExpression or not names.value:
            raise ValueError("named_cells needs the names as a constant string: 'a, b, ...'")
        schema = StructType()
        for name in str(names.value).split(","):
            schema = schema.add(name.strip(), "string")
        return AnalyzeResult(schema)

    def eval(self, cells: list, names: str):
        width = names.count(",") + 1
        yield tuple([*(cells or []), *[None] * width][:width])


def register(spark: SparkSession) -> None:
    spark.udtf.register("clauses", udtf(_Clauses, returnType="ordinal int, clause_no string, chapter string, clause string"))
    spark.udtf.register("table_grid", udtf(_Grid, returnType="grid int, row int, cells array<string>"))
    spark.udtf.register("named_cells", udtf(_Named))
