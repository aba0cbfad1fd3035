"""Every query of the library against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from sparquill import plans
from tests.compare import both, connect

#: The smallest tables, or those of ORACLE_SF: some forms only come up in larger ones.
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, con, name):
    ours, theirs = both(spark, con, plans.QUERIES[name], plans.ORACLE[name], SF)
    assert ours == theirs


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["bill_matches", "clause_segmentation", "interval_join", "range_join", "benchmark_needles", "weighted_names"])
def test_same_rows_on_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    ours, theirs = both(spark, connect(sf), plans.QUERIES[name], plans.ORACLE[name], sf)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).columns


@pytest.fixture(scope="module")
def long_orders(tmp_path_factory):
    """An order of 30 lines of one part, of which only lines 9, 10, 11 and 29 are headings, and one of three lines."""
    path = str(tmp_path_factory.mktemp("long_orders"))
    con = duckdb.connect()
    for name, made in [
        (
            "lineitem",
            """SELECT o AS l_orderkey, 3::BIGINT AS l_partkey, 4::BIGINT AS l_suppkey, i::INT AS l_linenumber, 2.0::DOUBLE AS l_quantity, 5.0::DOUBLE AS l_extendedprice,
            CASE WHEN i IN (9, 10, 11, 29) THEN 'A' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1996-01-01' AS l_shipdate FROM range(1, 3) r(o), range(1, 31) s(i) WHERE o = 1 OR i < 4""",
        ),
        ("orders", "SELECT o AS o_orderkey FROM range(1, 3) r(o)"),
        ("part", "SELECT 3::BIGINT AS p_partkey, 7 AS p_size"),
        ("supplier", "SELECT 4::BIGINT AS s_suppkey, 1 AS s_nationkey"),
    ]:
        con.sql(f"COPY ({made}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", ["nested_quotas", "toc_location"])
def test_orders_of_many_lines(spark, long_orders, name):
    ours, theirs = both(spark, connect(long_orders), plans.QUERIES[name], plans.ORACLE[name], long_orders)
    assert ours == theirs
