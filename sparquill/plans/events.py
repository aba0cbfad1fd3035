"""Event-log queries, and the batch equivalents of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import events as V
from sparquill.plans.registry import query, rows
from sparquill.sources.tables import table
from sparquill.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "sequence_numbers",
    """
    WITH old AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE event_type = 'signup'),
         last AS (SELECT user_id, max(seq) AS last FROM old GROUP BY 1)
    SELECT event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) + coalesce(last, 0) AS seq FROM events e LEFT JOIN last USING (user_id) WHERE event_type <> 'signup'
    """,
)
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    old = V.with_sequence(e.where("event_type = 'signup'"), None, "user_id", ["event_id"])
    return V.with_sequence(e.where("event_type <> 'signup'"), old, "user_id", ["event_id"]).select("event_id", "seq")


@query("retained_log", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 16")
def retained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.retained(_events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 16)


@query("resumed_log", "SELECT event_id, user_id FROM events WHERE ts > coalesce((SELECT ts FROM events WHERE event_id = 50), TIMESTAMP '1970-01-01')")
def resumed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resumed(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "event_id", "ts", 50).select("event_id", "user_id")


@query("resumed_unknown", "SELECT event_id FROM events")
def resumed_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resumed(_events(spark, sf_dir).select("event_id"), "event_id", "event_id", -1)


@query(
    "token_usage",
    """
    WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS model, CAST(round(value) AS BIGINT) AS tokens, event_id FROM events WHERE user_id > 10)
    SELECT model, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ROLLUP (model)
    """,
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).where("user_id > 10").select(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("model"), F.round("value").cast("long").alias("tokens"))
    return V.usage(runs, F.col("model"), ["tokens"])


@query("priced_usage", "SELECT event_type AS model, round(sum((1000 * 0.5 + 500 * CASE WHEN event_type = 'view' THEN 2.0 ELSE 1.5 END) / 1000), 6) AS cost FROM events GROUP BY 1")
def priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _events(spark, sf_dir).select(F.col("event_type").alias("model"), F.lit(1000).alias("tokens_in"), F.lit(500).alias("tokens_out"))
    return V.priced(used, rows(spark, "model string, price_in double, price_out double", ("view", 0.5, 2.0)), 0.5, 1.5)


@query(
    "external_usage",
    """
    WITH r AS (SELECT event_id AS n, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE user_id || ':' || event_type END AS call, CAST(event_id % 4 AS INT) AS i, CAST(event_id % 3 AS INT) AS o,
                      CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 50 AS INT) ELSE 0 END AS t FROM events),
    k AS (SELECT n, call, CASE WHEN t > 0 THEN t ELSE i + o END AS total FROM r WHERE trim(call) <> '')
    SELECT call, total FROM k WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY call ORDER BY n) = 1
    """,
)
def external_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all events: blank calls, missing totals, totals of nothing, and calls that are told again."""
    given = _events(spark, sf_dir).selectExpr(
        "event_id AS n", "CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat(user_id, ':', event_type) END AS call",
        "CAST(event_id % 4 AS INT) AS tokens_in", "CAST(event_id % 3 AS INT) AS tokens_out", "CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 50 AS INT) ELSE 0 END AS total",
    )
    return V.external_usage(given, "call", "n").select("call", "total")


@query("feedback_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE value >= 100) AS positive, count(*) FILTER (WHERE value < 20) AS negative FROM events GROUP BY 1")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", F.when(F.col("value") >= 100, 1).when(F.col("value") < 20, -1).otherwise(0).alias("rating"))
    return V.feedback_counts(e, ["user_id"])


@query("latest_event", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_per(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    "overlay_runs",
    """
    WITH live AS (SELECT event_id AS run, 'live' AS origin, ts FROM events WHERE event_type = 'purchase'), stored AS (SELECT event_id AS run, 'stored' AS origin, ts FROM events)
    SELECT run, origin, ts FROM (SELECT * FROM live UNION ALL SELECT * FROM stored WHERE run NOT IN (SELECT run FROM live)) ORDER BY ts DESC, run LIMIT 200
    """,
)
def overlay_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    as_ = lambda d, o: d.select(F.col("event_id").alias("run"), F.lit(o).alias("origin"), "ts")
    return V.overlay(as_(e, "stored"), as_(e.where("event_type = 'purchase'"), "live"), "run", "ts", 200)


@query(
    "budgeted_facts",
    """
    SELECT user_id, event_id, CAST(run AS BIGINT) AS running_cost FROM (
        SELECT user_id, event_id, sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) WHERE run <= 500
    """,
)
def budgeted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_id", "value", F.round("value").cast("long").alias("cost"))
    return V.within_budget(e, ["user_id"], 500, "cost", F.desc("value"), "event_id").select("user_id", "event_id", "running_cost")


_LOOPS = """
    WITH w AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM events)
    SELECT event_id, CAST(len(list_filter(l, lambda x: x = event_type)) AS INTEGER) AS recent,
           CASE WHEN len(list_filter(l, lambda x: x = event_type)) >= 5 THEN 'stop' WHEN len(list_filter(l, lambda x: x = event_type)) >= 3 THEN 'warn' END AS flag FROM w
"""


@query("loop_detection", _LOOPS)
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.loop_flags(_events(spark, sf_dir), "user_id", "event_id", "event_type", window=10).select("event_id", "recent", "flag")


@query(
    "frequency_limits",
    """
    WITH c AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
    SELECT event_id, n AS count, CASE WHEN n >= CASE event_type WHEN 'error' THEN 3 ELSE 12 END THEN 'stop' WHEN n >= CASE event_type WHEN 'error' THEN 2 ELSE 8 END THEN 'warn' END AS flag FROM c
    """,
)
def frequency_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = rows(spark, "kind string, warn int, stop int", ("error", 2, 3))
    return V.frequency_flags(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", limits, 8, 12).select("event_id", "count", "flag")


_SESSIONS = """
    WITH d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM d)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM s GROUP BY user_id, session
"""


@query("debounced_sessions", _SESSIONS)
def debounced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sessions(_events(spark, sf_dir), "user_id", "ts", 6 * 3600, "event_id").drop("session")


@query(
    "tumbling_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL""",
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed(_events(spark, sf_dir), "ts", "1 hour", keys=["event_type"], n=F.count("*"), most=F.max("value"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "sliding_windows",
    """
    SELECT s AS start, s + INTERVAL 1 DAY AS "end", count(*) AS n, count(DISTINCT user_id) AS users FROM (
        SELECT user_id, unnest([time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR for i in range(0, 4)]) AS s FROM events) GROUP BY s
    """,
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed(_events(spark, sf_dir), "ts", "1 day", "6 hours", n=F.count("*"), users=F.count_distinct("user_id"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "session_windows",
    f"""SELECT user_id, start, "end" + INTERVAL 6 HOUR AS "end", n FROM ({_SESSIONS})""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.session_windows(_events(spark, sf_dir), "ts", "6 hours", ["user_id"], n=F.count("*"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("call_totals", "SELECT event_type AS caller, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS calls FROM (SELECT DISTINCT user_id, event_type, CAST(7 AS BIGINT) AS t FROM events) GROUP BY 1")
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", F.concat_ws("-", "user_id", "event_type").alias("call"), F.concat("event_type", F.lit(":x")).alias("caller"), F.lit(7).cast("long").alias("tokens"))
    return streams.usage_totals(e, "call", "caller", "tokens", "ts")


@query("first_of_kind", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5")
def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_of_kind(_events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", 5)


@query("pending_work", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    done = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().join(customers, "c_custkey", "left_semi")
    return V.pending(customers, done, "c_custkey")


@query("pending_runs", "SELECT event_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-05 00:00:00'")
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"), F.col("ts").alias("created_at"))
    return V.pending_before(runs, "2024-01-05 00:00:00").select("event_id")


@query(
    "structured_content",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '{"k":' || (props->>'$.k') || '}' ELSE '[' || user_id || ',"' || event_type || '"]' END AS content, event_id % 3 > 0 AS is_json, event_id % 3 = 1 AS is_dict, true AS same FROM events
    """,
)
def structured_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, objects and lists, packed as text with marks and restored."""
    kinds = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("x")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"x": '), "props", F.lit("}")))
    given = F.try_variant_get(F.parse_json(F.coalesce(kinds, F.concat(F.lit('{"x": ['), "user_id", F.lit(', "'), "event_type", F.lit('"]}')))), "$.x", "variant")
    e = _events(spark, sf_dir).select("event_id", given.alias("v"), F.create_map(F.lit("trace"), F.col("user_id").cast("string")).alias("m"))
    e = e.withColumn("p", V.packed_content(F.col("v"), F.col("m"))).withColumn("back", V.restored_content(F.col("p.content"), F.col("p.metadata")))
    marked = lambda k: F.map_contains_key("p.metadata", k)
    return e.select("event_id", "p.content", marked("content_is_json").alias("is_json"), marked("content_is_dict").alias("is_dict"), (F.to_json("back") == F.to_json("v")).alias("same"))


@query(
    "new_facts",
    """
    WITH k AS (SELECT DISTINCT event_type, user_id % 50 AS u FROM events WHERE event_id % 40 = 0) SELECT min(event_id) AS event_id FROM events e WHERE event_id % 40 > 0
    AND NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = e.event_type AND u = e.user_id % 50) GROUP BY event_type, user_id % 50
    """,
)
def new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    facts = e.where("event_id % 40 > 0").selectExpr("event_id", "concat(' ', CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END, repeat(' ', CAST(event_id % 3 AS INT) + 1), user_id % 50) AS content")
    known = e.where("event_id % 40 = 0").selectExpr("concat(event_type, ' ', user_id % 50, ' ') AS content")
    return V.new_facts(facts, known, "content", "event_id").select("event_id")
