"""Warehouse queries: filters, ranked, as-of and preference joins, keyed updates, paging, ordered fills, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.functions.values import in_period, money
from sparquill.operators import relational as R
from sparquill.operators import retrieval
from sparquill.operators.costing import resolve_codes
from sparquill.operators.needles import substring_join
from sparquill.plans.registry import LINES, numbered_lines, query, rows
from sparquill.sources.tables import table


@query("optional_filters", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size >= 10 AND p_type = 'ECONOMY'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.where_given(table(spark, sf_dir, "part"), p_brand=["Brand#11", "Brand#12", "Brand#13"], size=F.col("p_size") >= 10, p_type="ECONOMY", p_name=None)
    return found.select("p_partkey", "p_name", "p_brand")


@query("prefix_filter", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#22%' GROUP BY p_brand")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(R.has_prefix(F.col("p_brand"), ["Brand#1", "Brand#22"])).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("any_pattern_filter", "SELECT p_partkey, p_name FROM part WHERE coalesce(p_name, '') ILIKE '%COLD%' OR coalesce(p_name, '') ILIKE 'small w%'")
def any_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(R.matches_any(F.col("p_name"), ["%COLD%", "small w%"])).select("p_partkey", "p_name")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, [start, end), price: the price of a part from each day on which it was shipped to the next one."""
    from pyspark.sql.window import Window

    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("date").alias("start")).agg(F.max("l_extendedprice").alias("price"))
    return daily.select("part", "start", F.lead("start").over(Window.partitionBy("part").orderBy("start")).alias("end"), "price")


_PRICES = """
    SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS start, lead(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS "end", price FROM (
        SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey, l_shipdate)
"""


@query("point_in_range", f"SELECT part, start, price FROM ({_PRICES}) WHERE start <= DATE '1998-06-01' AND (\"end\" IS NULL OR DATE '1998-06-01' < \"end\")")
def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1998-06-01").cast("date")
    return price_history(spark, sf_dir).where((F.col("start") <= day) & in_period(day, F.col("start"), F.col("end"))).select("part", "start", "price")


@query(
    "latest_per_key",
    """SELECT DISTINCT ON (l_partkey) l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_partkey, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    picked = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("m")  # a partial aggregate, no sort
    return li.groupBy("l_partkey").agg(picked).select("l_partkey", "m.l_shipdate", "m.l_orderkey", "m.l_linenumber", "m.l_extendedprice")


@query(
    "as_of_price",
    f"""
    SELECT o_orderkey, k AS part, o_orderdate, price, CAST(start AS TIMESTAMP) AS price_from
    FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 100 AS k FROM orders) o
    ASOF LEFT JOIN ({_PRICES}) p ON p.part = o.k AND p.start <= o.o_orderdate
    """,
)
def as_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 100).alias("part"))
    prices = price_history(spark, sf_dir).select("part", F.col("start").cast("timestamp_ntz").alias("price_from"), "price")
    return R.as_of_join(asked, prices, ["part"], "o_orderdate", "price_from").select("o_orderkey", "part", "o_orderdate", "price", "price_from")


@query(
    "interval_join",
    f"""
    SELECT l_orderkey, l_linenumber, count(*) AS spans, max(price) AS price FROM lineitem
    JOIN ({_PRICES}) p ON p.part = l_partkey AND start <= CAST(l_shipdate AS DATE) - 30 AND ("end" IS NULL OR CAST(l_shipdate AS DATE) - 30 < "end")
    GROUP BY 1, 2
    """,
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.date_sub(F.col("l_shipdate").cast("date"), 30).alias("day"))
    return R.interval_join(points, price_history(spark, sf_dir), ["part"], "day", "start", "end").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("spans"), F.max("price").alias("price"))


@query(
    "range_join",
    """
    SELECT c_custkey, count(*) AS suppliers FROM customer JOIN supplier ON c_acctbal >= s_acctbal - 50 AND c_acctbal < s_acctbal + 50 GROUP BY c_custkey
    """,
)
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "supplier").where("s_acctbal IS NOT NULL").select("s_suppkey", (F.col("s_acctbal") - 50).alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    return R.range_counts(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), spans, "c_acctbal", "lo", "hi").groupBy("c_custkey").agg(F.sum("spans").alias("suppliers"))


@query(
    "either_key_join",
    """
    WITH o AS (SELECT c_custkey AS id, c_custkey AS direct, c_nationkey AS mapped FROM customer),
         s AS (SELECT o_custkey AS k, max(o_orderkey) AS last_order FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT id, coalesce(a.last_order, b.last_order) AS last_order, CASE WHEN a.k IS NOT NULL THEN 'direct' WHEN b.k IS NOT NULL THEN 'mapped' END AS via
    FROM o LEFT JOIN s a ON a.k = o.direct LEFT JOIN s b ON b.k = o.mapped
    """,
)
def either_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("direct"), F.col("c_nationkey").cast("long").alias("mapped"))
    right = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("last_order"))
    return R.either_key_join(left, right, "direct", "mapped", "k", F.desc("last_order"), ids=["id"]).select("id", "last_order", "via")


@query(
    "composition_chain",
    """
    SELECT n_name, p_type, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
    WHERE o_orderstatus = 'F' GROUP BY 1, 2
    """,
)
def composition_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")
    li = t("lineitem").join(t("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    joined = li.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy("n_name", "p_type").agg(F.count("*").alias("lines"), F.sum(money(F.col("l_quantity")) * money(F.col("p_retailprice"))).cast("double").alias("amount"))


@query(
    "upsert_customers",
    """
    WITH new AS (SELECT o_custkey AS k, max(o_totalprice) AS balance FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT c_custkey AS k, coalesce(new.balance, c_acctbal) AS balance FROM customer LEFT JOIN new ON k = c_custkey
    UNION ALL SELECT k, balance FROM new WHERE k NOT IN (SELECT c_custkey FROM customer)
    """,
)
def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("balance"))
    return R.upsert(old, new, ["k"], F.desc("balance"))


@query(
    "insert_absent",
    """
    SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier
    UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    """,
)
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return R.insert_absent(s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")), ["k"])


@query(
    "replace_keys",
    """
    WITH new AS (SELECT o_orderpriority AS k, o_orderkey AS v FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')
    SELECT o_orderpriority AS k, o_orderkey AS v FROM orders WHERE o_orderpriority NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new
    """,
)
def replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return R.replace_keys(old.drop("o_orderstatus"), old.where("k = '2-HIGH' AND o_orderstatus = 'F'").drop("o_orderstatus"), ["k"])


@query(
    "overlapping_periods",
    """
    WITH p AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 AS e, o_orderkey AS id FROM orders)
    SELECT DISTINCT a.id FROM p a JOIN p b ON a.k = b.k AND a.id <> b.id AND b.s < a.e AND a.s < b.e AND (b.s < a.s OR (b.s = a.s AND b.id < a.id))
    """,
)
def overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), F.date_add(day, 20).alias("e"), F.col("o_orderkey").alias("id"))
    return R.overlaps(spans, ["k"], "s", "e", "id").select("id")


@query("orphans", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("page_forward", "SELECT event_id, user_id, ts FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 25")
def page_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_after(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id", 100, R.clamped(25))


@query("page_backward", "SELECT * FROM (SELECT event_id, user_id, ts FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_before(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id", 500, R.clamped(None))


@query("page_offset", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_at(table(spark, sf_dir, "events").select("event_id", "ts"), 40, R.clamped(1000), F.desc("ts"), F.desc("event_id"))


@query(
    "category_sort",
    """
    SELECT p_partkey, p_type, p_name, row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, length(p_name), p_name, p_partkey) AS place
    FROM part ORDER BY place LIMIT 50
    """,
)
def category_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    kind = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    order = [kind, F.length("p_name"), F.col("p_name"), F.col("p_partkey")]
    top = table(spark, sf_dir, "part").orderBy(*order).limit(50)  # the limit first: only 50 rows are numbered
    return top.select("p_partkey", "p_type", "p_name", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("keep_first", "SELECT DISTINCT ON (p_name) p_name, p_partkey, p_brand FROM part ORDER BY p_name, p_partkey")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_by(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], F.col("p_partkey"))


@query(
    "keep_longest",
    "SELECT DISTINCT ON (lang, source) lang, source, doc_id, length(coalesce(text, '')) AS n FROM documents ORDER BY lang, source, n DESC, doc_id",
)
def keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return R.best_by(d, ["lang", "source"], -F.col("n"), F.col("doc_id"))


@query(
    "clash_rename",
    """
    SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS new_id FROM (
        SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
    """,
)
def clash_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered_clashes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "new_id")


@query(
    "merge_first_values",
    """
    SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_min(value, event_id) FILTER (WHERE value > 100) AS first_big FROM events GROUP BY user_id
    """,
)
def merge_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("first_type"), F.when(F.col("value") > 100, F.col("value")).alias("first_big"))
    return R.merged_first(e, ["user_id"], "event_id", "first_type", "first_big")


@query("substring_containment", "SELECT n_nationkey, p_partkey FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'd w' WHEN 2 THEN 'ge' ELSE lower(n_name) END AS needle FROM nation) JOIN part ON contains(p_name, needle)")
def substring_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE n_nationkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'd w' WHEN 2 THEN 'ge' ELSE lower(n_name) END AS needle")
    return substring_join(short, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "needle", "p_name").select("n_nationkey", "p_partkey")


_PHRASES = r"""SELECT DISTINCT item_id, trim(p) AS phrase FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\n]')) AS p FROM benchmark) WHERE length(trim(p)) >= 12"""


@query(
    "benchmark_needles",
    f"""
    SELECT item_id, phrase, doc_id, CAST((length(text) - length(replace(text, phrase, ''))) // length(phrase) AS INT) AS hits, CAST(instr(text, phrase) AS INT) AS first
    FROM ({_PHRASES}) JOIN documents ON contains(text, phrase)
    """,
)
def benchmark_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of the benchmark in all whole documents, which are read once and not shuffled."""
    phrase = F.explode(F.transform(F.split("text", r"[.\n]"), lambda p: F.trim(p)))
    phrases = table(spark, sf_dir, "benchmark").select("item_id", phrase.alias("phrase")).where(F.length("phrase") >= 12).distinct()
    met = substring_join(phrases, table(spark, sf_dir, "documents").select("doc_id", "text"), "phrase", "text")
    return met.select("item_id", "phrase", "doc_id", "hits", "first")


@query(
    "forward_fill",
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events
    """,
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"))
    return R.filled_forward(e, ["user_id"], "event_id", "last_purchase").select("event_id", "last_purchase")


@query(
    "value_runs",
    """
    WITH f AS (SELECT user_id, event_id, value > 60 AS hit FROM events),
         s AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 1 ELSE 0 END AS start FROM f),
         g AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
    SELECT user_id, CAST(run AS BIGINT) AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE hit GROUP BY user_id, run HAVING count(*) >= 2
    """,
)
def value_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = R.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 60)
    return marked.where("island_size >= 2").groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"))


@query(
    "period_changes",
    """
    WITH m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT k, month, n, lag(n) OVER w AS previous, CAST(n - lag(n) OVER w AS BIGINT) AS delta, round(100.0 * (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0), 2) AS pct
    FROM m WINDOW w AS (PARTITION BY k ORDER BY month)
    """,
)
def period_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return R.changes(m, ["k"], "month", "n").withColumn("delta", F.col("delta").cast("long"))


@query(
    "number_gaps",
    "SELECT o_custkey, o_orderkey, previous FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderkey - previous > 500",
)
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gaps(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 500)


_STRATA = {"1-URGENT": 8, "2-HIGH": 5, "5-LOW": 3}


@query(
    "stratified_sample",
    """
    WITH h AS (SELECT o_orderkey, o_orderpriority, md5('7:' || o_orderkey) AS h FROM orders),
         r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS n FROM h)
    SELECT o_orderkey, o_orderpriority FROM r
    ORDER BY n > CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 5 WHEN '5-LOW' THEN 3 ELSE 0 END, h, o_orderkey LIMIT 30
    """,
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _STRATA, 30, "o_orderkey", "7")


@query("seeded_shuffle", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS place FROM customer")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_mktsegment").orderBy(R.hash_order("c_custkey", "42"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("fixed_batches", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 + 1 AS INTEGER) AS batch FROM orders")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 100).select("o_orderkey", "batch")


@query(
    "pairs_in_group",
    "SELECT least(a.l_partkey, b.l_partkey) AS x, greatest(a.l_partkey, b.l_partkey) AS y, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2 HAVING count(*) > 1",
)
def pairs_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = R.pairs_within(lines, ["l_orderkey"], "l_linenumber", ["l_partkey"]).select(F.least("l_partkey_a", "l_partkey_b").alias("x"), F.greatest("l_partkey_a", "l_partkey_b").alias("y"))
    return R.in_parts(pairs, "x", "y", by=lines).groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "reject_reasons",
    """
    SELECT coalesce(CASE WHEN n < 50 THEN 'short' WHEN n > 20000 THEN 'long' WHEN lang <> 'en' THEN 'language' END, 'kept') AS reason, count(*) AS rows FROM (
        SELECT length(coalesce(text, '')) AS n, lang FROM documents) GROUP BY 1
    """,
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    marked = R.split_by_reason(table(spark, sf_dir, "documents"), short=n < 50, long=n > 20000, language=F.col("lang") != "en")
    return marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query("id_sets_agree", "SELECT c_custkey, 'right' AS missing_in FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey, 'left' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def id_sets_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.same_ids(table(spark, sf_dir, "customer").where("c_acctbal > 0"), orders, "c_custkey")


@query(
    "two_stage_suggest",
    """
    WITH pool AS (SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widget%' ORDER BY p_partkey LIMIT 100),
    g AS (SELECT p_partkey, p_name, list_distinct([substr(replace(replace(p_name, ' ', ''), 'x', ''), i, 2) for i in range(1, length(replace(replace(p_name, ' ', ''), 'x', '')))]) AS g FROM pool),
    t AS (SELECT ['sm','ma','al','ll','lw','wi','id','dg','ge','et'] AS t)
    SELECT p_partkey, p_name, round(len(list_intersect(t, g)) / len(t), 3) AS score FROM g, t WHERE len(list_intersect(t, g)) / len(t) >= 0.34 ORDER BY score DESC, p_partkey LIMIT 5
    """,
)
def two_stage_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%widget%")).select("p_partkey", "p_name").orderBy("p_partkey").limit(100)
    share = T.coverage(T.grams(F.lit("small widget")), T.grams(F.col("p_name")))
    return pool.withColumn("score", F.round(share, 3)).where(share >= 0.34).orderBy(F.desc("score"), "p_partkey").limit(5)


@query(
    "exact_else_fuzzy",
    """
    WITH w AS (SELECT * FROM (VALUES ('cold widget'), ('warm wid'), ('blu')) t(q)),
         e AS (SELECT q, p_partkey FROM w JOIN part ON p_name = q)
    SELECT q, p_partkey, 'exact' AS match FROM e UNION ALL
    SELECT q, p_partkey, 'fuzzy' FROM w JOIN part ON contains(p_name, q) WHERE q NOT IN (SELECT q FROM e)
    """,
)
def exact_else_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, parts = rows(spark, "q string", ("cold widget",), ("warm wid",), ("blu",)), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    exact = asked.join(parts, asked["q"] == parts["p_name"]).select("q", "p_partkey")
    return retrieval.exact_else_fuzzy(exact, substring_join(asked, parts, "q", "p_name").select("q", "p_partkey"), ["q"])


@query(
    "null_safe_upsert",
    """
    WITH old AS (SELECT p_brand AS name, CASE WHEN p_size % 3 > 0 THEN p_type END AS spec, min(p_size) AS v FROM part WHERE p_size < 30 GROUP BY ALL),
         new AS (SELECT CASE WHEN p_size < 45 THEN p_brand END AS name, CASE WHEN p_size % 3 > 0 THEN p_type END AS spec, min(p_size) AS v FROM part WHERE p_size >= 25 GROUP BY ALL)
    SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.name IS NOT DISTINCT FROM o.name AND n.spec IS NOT DISTINCT FROM o.spec)
    """,
)
def null_safe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, spec = table(spark, sf_dir, "part"), "CASE WHEN p_size % 3 > 0 THEN p_type END AS spec"
    old = p.where("p_size < 30").selectExpr("p_brand AS name", spec, "p_size AS v").groupBy("name", "spec").agg(F.min("v").alias("v"))
    return R.upsert(old, p.where("p_size >= 25").selectExpr("CASE WHEN p_size < 45 THEN p_brand END AS name", spec, "p_size AS v"), ["name", "spec"], "v")


#: Parts as rows of a list: a code per brand and type; in some codes all names are equal but for blanks and brackets.
_CODED = """
    WITH g AS (SELECT p_partkey AS ordinal, p_brand || '/' || p_type AS code, CASE WHEN p_partkey % 2 = 0 THEN 'm³' ELSE 't' || p_size % 3 END AS unit, CASE WHEN length(p_type) % 2 = 0 THEN p_name ELSE p_type END AS plain FROM part),
    k AS (SELECT code, count(DISTINCT plain) AS names FROM g GROUP BY code)
"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "CASE WHEN length(p_type) % 2 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN concat('（', p_type, '）') ELSE concat(' ', lower(p_type)) END AS name"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS ordinal", "concat(p_brand, '/', p_type) AS code", name, "CASE WHEN p_partkey % 2 = 0 THEN 'm³' ELSE concat('t', p_size % 3) END AS unit")


@query(
    "code_merge",
    _CODED
    + """, u AS (SELECT code, unit, min(ordinal) AS o FROM g GROUP BY ALL)
    SELECT code, string_agg(unit, ',' ORDER BY o) AS units FROM u JOIN k USING (code) WHERE names = 1 GROUP BY code""",
)
def code_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = resolve_codes(_coded(spark, sf_dir), ["code"], T.resource_text(F.col("name")))
    return merged.select("code", F.concat_ws(",", "units").alias("units"))


@query("code_conflicts", _CODED + "SELECT ordinal, code FROM g JOIN k USING (code) WHERE names > 1")
def code_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_codes(_coded(spark, sf_dir), ["code"], T.resource_text(F.col("name")))[1].select("ordinal", "code")


@query(
    "canonical_key_join",
    """
    WITH p AS (SELECT p_partkey AS price_id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 = 0), k AS (SELECT name, size, min(price_id) AS price_id FROM p GROUP BY ALL)
    SELECT p_partkey AS id, CASE WHEN price_id IS NULL THEN 'none' ELSE 'matched' END AS status, price_id FROM part LEFT JOIN k ON k.name = p_name AND k.size = p_size
    """,
)
def canonical_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specification is inside the name on one side and apart, otherwise written, on the other."""
    quota = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(upper(p_name), '（Φ', p_size, '×3）') AS name", "CAST(NULL AS STRING) AS spec")
    price = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS price_id", "concat(' ', p_name) AS name", "concat('φ', p_size, 'x3') AS spec")
    key = T.canonical_key(F.col("name"), F.col("spec"))
    best = R.best_by(price.select(key.alias("k"), "price_id"), ["k"], F.col("price_id"))
    found = quota.withColumn("k", key).join(best, "k", "left")
    return found.select("id", F.when(F.col("price_id").isNotNull(), "matched").otherwise("none").alias("status"), "price_id")


@query(
    "until_blank_run",
    f"""
    WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS line, l_returnflag = 'N' AS blank FROM {LINES}),
    b AS (SELECT *, blank AND lead(blank, 1, false) OVER (PARTITION BY sheet ORDER BY line) AS two FROM l), s AS (SELECT sheet, min(line) AS stop FROM b WHERE two GROUP BY sheet)
    SELECT sheet, line FROM l LEFT JOIN s USING (sheet) WHERE NOT blank AND (stop IS NULL OR line < stop)
    """,
)
def until_blank_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = numbered_lines(spark, sf_dir).selectExpr("l_orderkey AS sheet", "l_linenumber AS line", "CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END AS v")
    return R.until_blank_run(given, ["sheet"], "line", F.col("v") == "", 2).select("sheet", "line")
