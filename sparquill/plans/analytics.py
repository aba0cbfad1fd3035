"""Ad-hoc analytics: profiles, SQL over views, pivots, windows, set operations, star-schema reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.functions.values import money
from sparquill.operators import profile
from sparquill.plans.registry import query
from sparquill.sources.scratch import written
from sparquill.sources.tables import Catalog, register_all, table

_NET = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


def net():
    """Price after discount, exact."""
    return money(F.col("l_extendedprice")) * (F.lit(1) - money(F.col("l_discount")))


def exact(c):
    return F.sum(money(F.col(c))).cast("double")


@query(
    "usage_rollup",
    """
    SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS events, count(DISTINCT user_id) AS users,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS largest, 'type' AS scope
    FROM events GROUP BY 1
    UNION ALL
    SELECT NULL, count(*), count(DISTINCT user_id), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), max(value), 'all' FROM events
    """,
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("event_type", F.coalesce("event_type", F.lit("unknown")))
    out = rows.rollup("event_type").agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), exact("value").alias("total"), F.max("value").alias("largest"), F.grouping("event_type").alias("g")
    )
    return out.withColumn("scope", F.when(F.col("g") == 1, "all").otherwise("type")).drop("g")


@query(
    "inspect_columns",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{c}', (SELECT count({c}) FROM orders))"
        for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    )
    + ') AS t(position, "column", non_null)',
)
def inspect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inspect(table(spark, sf_dir, "orders")).drop("type")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"""
        for c in _NUMERIC
    ),
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.summary(table(spark, sf_dir, "lineitem"), _NUMERIC)
    return made.select("column", "count", "nulls", "mean", "stddev", F.col("min").cast("double").alias("min"), "q25", "median", "q75", F.col("max").cast("double").alias("max"))


@query("sketched_months")
def sketched_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and orders of all lines: sketches of each ship day are stored, and every year is answered from them alone."""
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    stored = written(profile.sketches(li, ["day"], "l_extendedprice", "l_orderkey"), "sketches")
    return profile.merged_sketches(stored.withColumn("year", F.year("day")), ["year"], [0.25, 0.5, 0.75])


@query(
    "profile_other",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct", min({c}) AS min, max({c}) AS max,
        (SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM orders"""
        for c in ["o_orderstatus", "o_orderpriority"]
    ),
)
def profile_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column", "count", "nulls", "distinct", "min", "max", "mode")


@query(
    "frequent_values",
    """SELECT p_brand AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS pct
    FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5""",
)
def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequent(table(spark, sf_dir, "part"), "p_brand")


_ADHOC = """
    WITH spent AS (
        SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent, count(*) AS orders FROM orders GROUP BY o_custkey
    )
    SELECT n_name, c_mktsegment, count(*) AS customers, CAST(sum(spent) AS DOUBLE) AS spent, CAST(sum(orders) AS BIGINT) AS orders
    FROM customer JOIN spent ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE spent > (SELECT avg(spent) FROM spent)
    GROUP BY n_name, c_mktsegment
"""


@query("adhoc_sql", _ADHOC)
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    for name in ("orders", "customer", "nation"):
        catalog.add(table(spark, sf_dir, name), name)
    return catalog.query(_ADHOC)


@query(
    "monthly_pivot",
    "SELECT o_orderpriority, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN month(o_orderdate) = {m} THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS m{m}" for m in range(1, 13))
    + " FROM orders GROUP BY o_orderpriority",
)
def monthly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("m"), F.month("o_orderdate")).alias("m"), money(F.col("o_totalprice")).alias("v"))
    names = [f"m{i}" for i in range(1, 13)]
    wide = o.groupBy("o_orderpriority").pivot("m", names).agg(F.sum("v"))
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in names])


@query(
    "running_total",
    """
    SELECT day, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (ORDER BY day) AS DOUBLE) AS running FROM (
        SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1)
    """,
)
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(money(F.col("o_totalprice"))).alias("revenue"))
    w = Window.orderBy("day")  # one row per day: a global window over a few thousand rows
    return days.select("day", F.col("revenue").cast("double").alias("revenue"), F.sum("revenue").over(w).cast("double").alias("running"))


@query(
    "rank_customers",
    """
    SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER v AS quartile,
           round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume, first_value(c_custkey) OVER v AS first, nth_value(c_custkey, 2) OVER f AS second
    FROM customer
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC), v AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey),
           f AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def rank_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    v = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    whole = v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", "c_acctbal", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(v).cast("long").alias("quartile"),
        F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.first("c_custkey").over(v).alias("first"), F.nth_value("c_custkey", 2).over(whole).alias("second"),
    )


@query(
    "grouping_sets",
    """
    SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, CAST(year(l_shipdate) AS INTEGER)), (CAST(year(l_shipdate) AS INTEGER)), ())
    """,
)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity")
    f, s, y = F.col("l_returnflag"), F.col("l_linestatus"), F.col("year")
    return rows.groupingSets([[f, s], [f, y], [y], []], f, s, y).agg(F.count("*").alias("n"), exact("l_quantity").alias("quantity"))


@query(
    "cube_counts",
    "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
)
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), exact("c_acctbal").alias("balance"))


_SETS = """
    (SELECT c_nationkey AS k, 'both' AS how FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
    UNION ALL (SELECT n_nationkey, 'no customer' FROM nation EXCEPT SELECT c_nationkey, 'no customer' FROM customer)
    UNION ALL (SELECT s_nationkey, 'any' FROM supplier UNION SELECT c_nationkey, 'any' FROM customer)
"""


@query("set_operations", _SETS)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark, sf_dir, "customer", "supplier", "nation")
    return spark.sql(_SETS)


@query(
    "outer_joins",
    """
    SELECT n_name, c, s FROM nation
    LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a ON c_nationkey = n_nationkey
    FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON s_nationkey = n_nationkey
    """,
)
def outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    n = table(spark, sf_dir, "nation")
    left = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    return left.join(s, left["n_nationkey"] == s["s_nationkey"], "full").select("n_name", "c", "s")


@query(
    "date_parts",
    """
    SELECT date_trunc('month', o_orderdate)::DATE AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n, count(DISTINCT o_custkey) AS customers
    FROM orders GROUP BY 1, 2
    """,
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(
    "pricing_summary",
    f"""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
           CAST(sum({_NET}) AS DOUBLE) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        exact("l_quantity").alias("sum_qty"), exact("l_extendedprice").alias("sum_base"), F.sum(net()).cast("double").alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    "unshipped_orders",
    f"""
    SELECT o_orderkey, o_orderdate, CAST(sum({_NET}) AS DOUBLE) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10
    """,
)
def unshipped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.sum(net()).cast("double").alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query(
    "local_suppliers",
    f"""
    SELECT n_name, CAST(sum({_NET}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name
    """,
)
def local_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    c = t("customer").select("c_custkey", "c_nationkey")
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.sum(net()).cast("double").alias("revenue"))


@query(
    "forecast_revenue",
    """
    SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
)
def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= at("1997-01-01")) & (F.col("l_shipdate") < at("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.sum(money(F.col("l_extendedprice")) * money(F.col("l_discount"))).cast("double").alias("revenue"), F.count("*").alias("n"))
