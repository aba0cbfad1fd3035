"""Costing queries: unit rates, line totals, verification, composition, schemes, trend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import costing as K
from sparquill.plans.registry import LINES, numbered_lines, query
from sparquill.sources.tables import table

_KINDS = {"A": "labor", "N": "material", "R": "machine"}
_RATES = """
    WITH c AS (SELECT l_orderkey AS k, l_returnflag AS f, round(CAST(l_quantity AS DECIMAL(18,6)) * CAST(l_tax AS DECIMAL(18,6)), 2) AS a FROM lineitem),
    b AS (SELECT k, CAST(coalesce(sum(a) FILTER (WHERE f = 'A'), 0) AS DECIMAL(18,2)) AS labor, CAST(coalesce(sum(a) FILTER (WHERE f = 'N'), 0) AS DECIMAL(18,2)) AS material,
          CAST(coalesce(sum(a) FILTER (WHERE f = 'R'), 0) AS DECIMAL(18,2)) AS machine FROM c GROUP BY k),
    r AS (SELECT *, CAST(labor + material + machine AS DECIMAL(18,2)) AS rmm FROM b),
    f AS (SELECT *, CAST(round(rmm * CAST(0.085 AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS management_fee, CAST(round(rmm * CAST(0.05 AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS profit FROM r),
    unit AS (SELECT k, CAST(labor AS DOUBLE) AS labor, CAST(material AS DOUBLE) AS material, CAST(machine AS DOUBLE) AS machine, CAST(rmm AS DOUBLE) AS rmm, CAST(management_fee AS DOUBLE) AS management_fee,
             CAST(profit AS DOUBLE) AS profit, CAST(rmm + management_fee + profit AS DOUBLE) AS unit_price FROM f)
"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("consumption"), F.col("l_tax").alias("unit_price"))


def _fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", F.lit(0.085).alias("management_rate"), F.lit(0.05).alias("profit_rate"), F.lit(None).cast("double").alias("risk_rate"))


@query("unit_rates", _RATES + "SELECT * FROM unit")
def unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unit_rates(_components(spark, sf_dir), ["k"], _fees(spark, sf_dir), _KINDS).drop("other", "skipped", "rates_missing", "risk_fee")


@query("line_totals", _RATES + "SELECT k, CAST(round(CAST(unit_price AS DECIMAL(18,6)) * CAST(3.5 AS DECIMAL(18,6)), 2) AS DOUBLE) AS line_total FROM unit")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = K.unit_rates(_components(spark, sf_dir), ["k"], _fees(spark, sf_dir), _KINDS)
    return K.line_totals(priced.withColumn("quantity", F.lit(3.5))).select("k", "line_total")


@query(
    "cost_verification",
    _RATES
    + """, claims AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN 'bad' ELSE '010101001' END AS code, CASE WHEN o_orderstatus = 'P' THEN 'elsewhere' ELSE '深圳' END AS region FROM orders)
    SELECT c.k, CASE WHEN code = 'bad' OR region = 'elsewhere' OR (u.k IS NOT NULL AND c.k > 700 AND round(abs(unit_price - (unit_price + 1)), 2) > 0.02) THEN 'fail'
                     WHEN u.k IS NULL OR (labor <= 0 AND material <= 0) THEN 'doubt' ELSE 'pass' END AS verdict
    FROM claims c LEFT JOIN unit u USING (k)""",
)
def cost_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, fees = _components(spark, sf_dir), _fees(spark, sf_dir)
    made = K.unit_rates(parts, ["k"], fees, _KINDS).select("k", F.col("unit_price").alias("made"))
    claims = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderpriority") == "5-LOW", "bad").otherwise("010101001").alias("code"),
        F.when(F.col("o_orderstatus") == "P", "elsewhere").otherwise("深圳").alias("region"), F.lit("2013").alias("edition"),
    )
    claims = claims.join(made, "k", "left").withColumn("claimed", F.coalesce(F.col("made") + F.when(F.col("k") > 700, 1.0).otherwise(0.0), F.lit(9.0))).drop("made")
    return K.verify(claims, parts, fees, "k", ["深圳", "shenzhen", "Shenzhen"], ["2013"], _KINDS).select("k", "verdict")


@query("roll_up", "SELECT l_returnflag, sum(CASE WHEN l_linenumber % 4 > 1 THEN l_quantity ELSE 0 END) AS total, count(*) FILTER (WHERE l_linenumber % 4 > 1) AS included, count(*) FILTER (WHERE l_linenumber % 4 < 2) AS skipped FROM lineitem GROUP BY 1")
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text, some of them missing or no numbers."""
    given = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "CASE WHEN l_linenumber % 4 = 0 THEN concat('x', l_quantity) WHEN l_linenumber % 4 > 1 THEN CAST(l_quantity AS STRING) END AS amount")
    return K.roll_up(given, "amount", ["l_returnflag"])


@query(
    "bill_check",
    """
    SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 1 THEN 'invalid code' END, CASE WHEN p_size % 4 = 0 THEN 'missing name' END, CASE WHEN p_size % 3 = 0 THEN 'missing unit' END) AS issues,
           CASE WHEN p_partkey % 3 = 1 THEN 'error' WHEN p_size % 4 = 0 OR p_size % 3 = 0 THEN 'warn' END AS severity FROM part
    """,
)
def bill_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "lpad(CAST(p_partkey AS STRING), element_at(array(9, 8, 12), CAST(p_partkey % 3 AS INT) + 1), '0') AS code"
    given = table(spark, sf_dir, "part").selectExpr("p_partkey", code, "CASE WHEN p_size % 4 <> 0 THEN p_name END AS name", "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'm³' END AS unit")
    return K.check_bill(given).select("p_partkey", F.concat_ws(",", "issues").alias("issues"), "severity")


#: Lines as the resources of quotas (order, line status): a part's own price, else that of its supplier's material, else none.
_PRICED = """
    WITH prices AS (SELECT p_partkey AS id, p_size + 0.25 AS price, DATE '2026-04-01' AS a, CAST(DATE '2026-05-01' AS DATE) AS b FROM part WHERE p_partkey % 3 = 0
                    UNION ALL SELECT p_partkey, p_size + 0.5, DATE '2026-05-01', CASE WHEN p_size % 2 = 0 THEN DATE '2026-06-01' END FROM part WHERE p_partkey % 3 = 0
                    UNION ALL SELECT s_suppkey + 10000000, s_nationkey + 0.75, DATE '2026-03-01', NULL FROM supplier WHERE s_suppkey % 2 = 0),
    good AS (SELECT * FROM prices WHERE {when}), latest AS (SELECT id, arg_max(price, a) AS price FROM good GROUP BY id),
    composed AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_partkey, coalesce(d.price, m.price) AS price, CASE WHEN d.price IS NOT NULL THEN 'direct' WHEN m.price IS NOT NULL THEN 'mapped' END AS via,
        CAST(l_quantity * coalesce(d.price, m.price) * CASE WHEN d.price IS NULL AND l_linenumber % 2 = 0 THEN 100 ELSE 1 END AS DOUBLE) AS amount FROM @LINES LEFT JOIN latest d ON d.id = l_partkey LEFT JOIN latest m ON m.id = l_suppkey + 10000000)
""".replace("@LINES", LINES)


def _composed(spark: SparkSession, sf_dir: str, on=None) -> DataFrame:
    links = numbered_lines(spark, sf_dir).selectExpr(
        "l_orderkey * 1000 + l_linenumber AS link_id", "l_orderkey", "l_linenumber", "l_orderkey AS code", "l_linestatus AS quota_code", "CASE l_returnflag WHEN 'A' THEN '人工' WHEN 'N' THEN '材料' ELSE '机械' END AS category",
        "concat('r', lpad(CAST(l_partkey AS STRING), 9, '0'), l_linenumber) AS res_name", "CAST(NULL AS STRING) AS spec", "l_partkey AS resource_id", "l_suppkey + 10000000 AS price_resource_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN 100.0D END AS unit_factor", "l_quantity AS consumption",
    )
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    first = p.selectExpr("p_partkey AS rp_resource_id", "'深圳' AS region", "p_size + 0.25D AS price", "DATE '2026-04-01' AS period_start", "DATE '2026-05-01' AS period_end")
    second = p.selectExpr("p_partkey", "'深圳'", "p_size + 0.5D", "DATE '2026-05-01'", "CASE WHEN p_size % 2 = 0 THEN DATE '2026-06-01' END")
    elsewhere = p.selectExpr("p_partkey", "'广州'", "1.0D", "DATE '2027-01-01'", "CAST(NULL AS DATE)")
    material = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey + 10000000", "'深圳'", "s_nationkey + 0.75D", "DATE '2026-03-01'", "CAST(NULL AS DATE)")
    return K.compose(links, first.union(second).union(elsewhere).union(material), on, "深圳")


@query("price_composition", _PRICED.format(when="true") + "SELECT l_orderkey, l_linenumber, CAST(price AS DOUBLE) AS price, via, amount, CASE WHEN price IS NULL THEN 'no_source' ELSE 'matched' END AS price_status FROM composed")
def price_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "via", F.col("amount").cast("double").alias("amount"), "price_status")


@query("price_composition_on", _PRICED.format(when="a <= DATE '2026-06-15' AND (b IS NULL OR b > DATE '2026-06-15')") + "SELECT l_orderkey, l_linenumber, CAST(price AS DOUBLE) AS price, via FROM composed")
def price_composition_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir, dt.date(2026, 6, 15)).select("l_orderkey", "l_linenumber", "price", "via")


@query(
    "nested_quotas",
    _PRICED.format(when="true")
    + """SELECT l_orderkey AS code, l_linestatus AS quota_code, string_agg('r' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || l_linenumber, ',' ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_partkey, l_linenumber) AS resources,
    sum(amount) AS subtotal, count(*) FILTER (WHERE price IS NULL) AS unpriced FROM composed GROUP BY 1, 2""",
)
def nested_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.nested(_composed(spark, sf_dir), ["code"], ["quota_code"], "res_name", "price", order=("resource_id", "l_linenumber"))  # names sort line 10 before line 9
    return made.select("code", "quota_code", F.concat_ws(",", F.transform("resources", lambda r: r["res_name"])).alias("resources"), F.col("subtotal").cast("double").alias("subtotal"), "unpriced")


@query("missing_prices", _PRICED.format(when="true") + "SELECT DISTINCT l_orderkey || '::r' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || l_linenumber || '::' AS price_key FROM composed WHERE price IS NULL")
def missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_prices(_composed(spark, sf_dir))


@query(
    "price_write_back",
    "SELECT p_partkey AS price_key, CASE WHEN p_partkey % 5 = 0 THEN p_size + 0.5 WHEN p_size % 3 = 0 THEN p_retailprice END AS unit_price, CASE WHEN p_partkey % 5 = 0 THEN 'manual' WHEN p_size % 3 = 0 THEN 'matched' ELSE 'no_source' END AS price_status FROM part",
)
def price_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parts = p.selectExpr("p_partkey AS price_key", "CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS unit_price", "CASE WHEN p_size % 3 = 0 THEN 'matched' ELSE 'no_source' END AS price_status")
    return K.write_back(parts, p.where("p_partkey % 5 = 0").selectExpr("p_partkey AS price_key", "p_size + 0.5D AS unit_price"))


@query(
    "quota_schemes",
    f"""
    WITH q AS (SELECT l_orderkey AS bill, l_linenumber AS n, '01000' || (l_linenumber % 2) || '-' || l_linenumber AS code, ((l_orderkey + l_linenumber * 3) % 10) / 10 AS c, l_quantity AS p FROM {LINES} WHERE l_linenumber <= 4),
    k AS (SELECT bill, count(*) AS k FROM q GROUP BY bill), o AS (SELECT q.* FROM q WHERE n % 2 = 1), e AS (SELECT * FROM q WHERE n % 2 = 0),
    s AS (SELECT o.bill, CASE WHEN o.n < e.n THEN o.code || '|' || e.code ELSE e.code || '|' || o.code END AS codes, least(o.c, e.c) AS score, o.p + e.p AS base_price, o.c AS x, e.c AS y FROM o JOIN e USING (bill) JOIN k USING (bill) WHERE k > 2
          UNION ALL SELECT bill, string_agg(code, '|' ORDER BY n), min(c), sum(p), 0, 0 FROM q JOIN k USING (bill) WHERE k <= 2 GROUP BY bill)
    SELECT bill, CAST(row_number() OVER (PARTITION BY bill ORDER BY score DESC, x DESC, y DESC) AS INT) AS scheme, codes, CAST(score AS DOUBLE) AS score, CAST(base_price AS DOUBLE) AS base_price FROM s
    """,
)
def quota_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first four lines as quotas: the odd ones are alternatives, and so are the even ones."""
    given = numbered_lines(spark, sf_dir).where("l_linenumber <= 4").selectExpr(
        "l_orderkey AS bill", "l_linenumber AS ordinal", "concat('01000', l_linenumber % 2, '-', l_linenumber) AS quota_code", "((l_orderkey + l_linenumber * 3) % 10) / 10.0D AS confidence", "l_quantity AS base_price"
    )
    return K.schemes(given, "bill").withColumn("codes", F.concat_ws("|", "codes"))


@query(
    "price_trend",
    """
    WITH p AS (SELECT l_suppkey AS name, strftime(l_shipdate, '%Y') AS period, min(l_quantity) AS price FROM lineitem WHERE l_quantity > 3 GROUP BY ALL),
    q AS (SELECT *, lag(price) OVER w AS before, lag(period) OVER w AS from_period FROM p WINDOW w AS (PARTITION BY name ORDER BY period))
    SELECT name, from_period, period AS to_period, round(price - before, 2) AS delta, round((price - before) / before * 100, 2) AS pct FROM q WHERE before IS NOT NULL
    """,
)
def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "lineitem").where("l_quantity > 3").groupBy(F.col("l_suppkey").alias("name"), F.date_format("l_shipdate", "yyyy").alias("period")).agg(F.min("l_quantity").cast("string").alias("price"))
    return K.trend(least, ["name"], "period", "price")


@query("rule_table", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '管理费' WHEN 1 THEN '利润' END AS fee, CAST(CASE p_partkey % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 END AS DOUBLE) AS rate FROM part")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "element_at(array(concat('企业管理费率 ', p_name, ' 建筑'), concat(p_name, '利润率'), concat('管理费', p_name)), CAST(p_partkey % 3 AS INT) + 1) AS t")
    rules = [{"contains": ["管理费", "建筑"], "fee": "管理费", "rate": 0.1}, {"contains": ["利润"], "fee": "利润", "rate": 0.05}]
    return K.apply_rules(given, "t", rules, ["fee", "rate"]).select("id", "fee", "rate")


@query(
    "bill_matches",
    """
    WITH n AS (
        SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN lpad('0', 9, '0') ELSE lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS code, p_size FROM part
    ), c AS (
        SELECT p_partkey AS id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS candidate, CAST(0.4 + p_size % 6 / 10.0 AS DOUBLE) AS score FROM part WHERE p_size % 7 <> 0
        UNION ALL SELECT p_partkey, lpad(CAST(p_partkey + 1 AS VARCHAR), 9, '0'), CAST(0.3 + p_size % 4 / 10.0 AS DOUBLE) FROM part WHERE p_size % 7 <> 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS place FROM c
    ), b AS (
        SELECT id, max(candidate) FILTER (WHERE place = 1) AS best, max(score) FILTER (WHERE place = 1) AS score, max(score) FILTER (WHERE place = 2) AS next FROM r GROUP BY id
    ), t AS (
        SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code9 FROM part WHERE p_partkey > 0
    ), d AS (
        SELECT n.id, code, p_size, best, CASE WHEN code IS NULL THEN 'select' ELSE 'verify' END AS mode, coalesce(code = 'bad', false) AS malformed,
               code IS NULL AND coalesce(b.score >= 0.6 AND round(b.score - next, 9) >= 0.05, false) AS decided,
               EXISTS (SELECT 1 FROM c WHERE c.id = n.id AND c.candidate = code) AS recalled
        FROM n LEFT JOIN b USING (id)
    ), e AS (
        SELECT *, coalesce(CASE WHEN mode = 'verify' THEN code WHEN decided THEN best END IN (SELECT code9 FROM t), false) AS known, p_size % 2 = 1 AS bare FROM d
    ), f AS (
        SELECT *, mode = 'verify' AND NOT malformed AND NOT known AS lost, known AND bare AS lacks, mode = 'verify' AND NOT malformed AND NOT recalled AS missed FROM e
    )
    SELECT id, mode, CASE WHEN mode = 'verify' OR decided THEN 'done' ELSE 'need_review' END AS status,
           CASE WHEN mode = 'select' AND NOT decided THEN NULL WHEN malformed OR lost THEN 'fail' WHEN lacks OR missed THEN 'doubt' ELSE 'pass' END AS verdict,
           concat_ws(',', CASE WHEN malformed THEN 'code_format' END, CASE WHEN lost THEN 'code_not_found' END, CASE WHEN lacks THEN 'missing_feature' END, CASE WHEN missed THEN 'recall_miss' END,
                     CASE WHEN mode = 'select' AND best IS NULL THEN 'no_candidates' WHEN mode = 'select' AND NOT decided THEN 'low_confidence' END) AS findings,
           CASE WHEN decided THEN best END AS selected
    FROM f
    """,
)
def bill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests: with a code it is verified, without one it is selected from the candidates of a search."""
    p = table(spark, sf_dir, "part")
    nine = "lpad(CAST({} AS STRING), 9, '0')"
    asked = p.selectExpr(
        "p_partkey AS id", f"CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN {nine.format(0)} ELSE {nine.format('p_partkey')} END AS code", "concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' 厚度 20' ELSE '' END) AS feature"
    )
    truth = p.where("p_partkey > 0").selectExpr(f"{nine.format('p_partkey')} AS code9", "array('厚度') AS required")
    some = p.where("p_size % 7 <> 0")
    first = some.selectExpr("p_partkey AS id", f"{nine.format('p_partkey')} AS code9", "CAST(0.4 + p_size % 6 / 10.0 AS DOUBLE) AS score")
    second = some.selectExpr("p_partkey", f"{nine.format('p_partkey + 1')}", "CAST(0.3 + p_size % 4 / 10.0 AS DOUBLE)")
    made = K.match_bills(asked, truth, first.union(second).withColumnRenamed("code9", "candidate"), 0.6, 0.05)
    return made.select("id", "mode", "status", "verdict", F.concat_ws(",", F.transform("findings", lambda f: f["type"])).alias("findings"), "selected")
