"""Evaluation queries: set and ranking metrics, grouping-set summaries, calibration, repeated runs, deltas, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions.values import calibrated, ratio, set_scores
from sparquill.operators import evaluation as E
from sparquill.operators import retrieval as S
from sparquill.plans.registry import query
from sparquill.plans.search import _NEAR, neighbours
from sparquill.sources.tables import table

_PREDICTED = """
    p AS (SELECT source, lang, quality = 1 AS gold, length(coalesce(text, '')) >= 400 AS pred FROM documents JOIN labels USING (doc_id))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule on length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("source", "lang", (F.col("quality") == 1).alias("gold"), (F.length(F.coalesce("text", F.lit(""))) >= 400).alias("pred"))


_MICRO = """count(*) AS n, count(*) FILTER (WHERE gold AND pred) AS tp, round(count(*) FILTER (WHERE gold AND pred) / nullif(count(*) FILTER (WHERE pred), 0), 4) AS "precision",
    round(count(*) FILTER (WHERE gold AND pred) / nullif(count(*) FILTER (WHERE gold), 0), 4) AS recall, round(2 * count(*) FILTER (WHERE gold AND pred) / nullif(count(*) FILTER (WHERE pred) + count(*) FILTER (WHERE gold), 0), 4) AS f1"""


@query("prediction_summary", f"WITH {_PREDICTED} SELECT source, lang AS scope, {_MICRO} FROM p GROUP BY source, lang UNION ALL SELECT source, 'all', {_MICRO} FROM p GROUP BY source")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp, p, g = F.count_if(F.col("gold") & F.col("pred")), F.count_if("pred"), F.count_if("gold")
    measures = [F.count("*").alias("n"), tp.alias("tp"), ratio(tp, p, 4).alias("precision"), ratio(tp, g, 4).alias("recall"), ratio(2 * tp, p + g, 4).alias("f1")]
    return E.summarize(predictions(spark, sf_dir), "source", "lang", measures)


_HITS = "hits AS (SELECT n.query_id, min(CASE WHEN q.label = d.label THEN rank END) AS rank, min(q.label) AS label FROM near n JOIN v q ON q.vec_id = n.query_id JOIN v d ON d.vec_id = n.id GROUP BY 1)"


@query(
    "ranking_metrics",
    _NEAR + f", {_HITS} SELECT label, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS top3,"
    " round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 4) AS recall, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, round(avg(rank), 4) AS mean_rank FROM hits GROUP BY label",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = neighbours(spark, sf_dir).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    hits = near.groupBy("query_id", F.col("own").alias("label")).agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("rank"))
    return E.ranking(hits, 10, ["label"])


@query("score_histogram", _NEAR + "SELECT bucket, lo, hi, count(score) AS n FROM (VALUES (0, 0.0, 0.2), (1, 0.2, 0.4), (2, 0.4, 0.6), (3, 0.6, 0.75), (4, 0.75, 1.01)) b(bucket, lo, hi) LEFT JOIN (SELECT score FROM near WHERE rank = 1) ON score >= lo AND score < hi GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(neighbours(spark, sf_dir).where("rank = 1"), "score", [0.0, 0.2, 0.4, 0.6, 0.75, 1.01])


@query(
    "repeated_passes",
    """SELECT o_custkey, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed,
    count(*) >= 3 AND bool_and(o_orderstatus = 'F') AND NOT bool_or(o_totalprice > 400000) AS pass_k FROM orders GROUP BY o_custkey""",
)
def repeated_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_totalprice") > 400000).alias("violation"))
    return E.pass_k(runs, "o_custkey", 3)


@query(
    "spread_by_config",
    "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS stddev, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1",
)
def spread_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spread_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query(
    "judge_agreement",
    f"WITH {_PREDICTED} SELECT source, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS agreed, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 4) AS agreement FROM p GROUP BY source",
)
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.agreement(predictions(spark, sf_dir), "gold", "pred", ["source"])


#: Orders as questions of four kinds, and answers to them whose scores follow from the kind.
_ANSWERED = """
    WITH a AS (SELECT o_orderkey AS id, o_orderkey % 4 AS kind, o_custkey % 9 + 1 AS n, CASE WHEN o_orderkey % 4 = 2 AND o_custkey % 2 = 0 THEN NULL ELSE o_custkey % 50 END AS tokens, o_orderpriority AS model FROM orders),
    s AS (SELECT id, model, n, kind, tokens, CASE kind WHEN 0 THEN 'clause' WHEN 1 THEN 'clause' WHEN 2 THEN 'number' ELSE 'refuse' END AS type, CASE WHEN kind < 2 THEN 1 ELSE 0 END AS tp, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS predicted,
        CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS gold, CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 END AS p, CASE kind WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END AS r, CASE WHEN kind < 2 THEN 0.6667 END AS f1,
        CASE kind WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS wanted, CASE kind WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS matched FROM a)
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 4 AS INT) AS kind", "o_custkey % 9 + 1 AS n", "o_custkey", "o_orderpriority")
    of = lambda *x: f"element_at(array({', '.join(x)}), kind + 1)"
    gold = of("array(concat('GB50010-2010_8.2.', n), concat('GB50010-2010_8.3.', n))", "array(concat('GB50011-2010_5.', n))", "array()", "array()")
    values = of("array('20')", "array()", "array(concat('0.', n, '0'), '7')", "array()")
    evals = o.selectExpr("id", of("'clause'", "'clause'", "'number'", "'refuse'") + " AS type", "CASE kind WHEN 0 THEN concat('按《混规》8.2.', n) ELSE '问' END AS question", f"{gold} AS gold_clauses", f"{values} AS gold_values", "kind = 3 AS should_refuse")
    said = of("concat('GB50010-2010 第8.2.', n, '条，厚 20.0 mm')", "concat('第5.', n, '条和第9.9条')", "concat('0.', n)", "'信息不足'")
    answers = o.selectExpr("id", "o_orderpriority AS model_id", f"{said} AS answer", "CASE kind WHEN 2 THEN 'length' ELSE 'stop' END AS finish_reason", "CASE WHEN kind <> 2 OR o_custkey % 2 = 1 THEN CAST(o_custkey % 50 AS INT) END AS completion_tokens")
    return E.score_answers(evals, answers, evals.select(F.explode("gold_clauses").alias("clause_id")).distinct())


@query(
    "answer_scores",
    _ANSWERED
    + """SELECT id, tp AS clause_tp, predicted AS clause_predicted, gold AS clause_gold, CAST(p AS DOUBLE) AS clause_precision, CAST(r AS DOUBLE) AS clause_recall, CAST(f1 AS DOUBLE) AS clause_f1, wanted AS numeric_gold, matched AS numeric_matched,
    CASE WHEN wanted > 0 THEN wanted = matched END AS numeric_exact, kind = 3 AS refusal_pred, CASE WHEN kind = 1 THEN 'GB50011-2010_9.9' ELSE '' END AS invalid FROM s""",
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "clause_tp", "clause_predicted", "clause_gold", "clause_precision", "clause_recall", "clause_f1", "numeric_gold", "numeric_matched", "numeric_exact", "refusal_pred"]
    return _answers(spark, sf_dir).select(*cols, F.concat_ws(",", "invalid_clauses").alias("invalid"))


_SUMMED = """count(*) AS n, round(avg(p), 4) AS clause_precision, round(avg(r), 4) AS clause_recall, round(2 * sum(tp) / nullif(sum(predicted) FILTER (WHERE kind < 2) + sum(gold) FILTER (WHERE kind < 2), 0), 4) AS clause_f1_micro,
    round(avg(CASE WHEN kind = 1 THEN 1.0 ELSE 0 END), 4) AS hard_hallucination_rate, round(avg(CASE WHEN wanted > 0 THEN CASE WHEN wanted = matched THEN 1.0 ELSE 0 END END), 4) AS numeric_exact_accuracy,
    round(sum(matched) FILTER (WHERE wanted > 0) / sum(wanted) FILTER (WHERE wanted > 0), 4) AS numeric_value_accuracy, CAST(max(CASE WHEN kind = 3 THEN 1.0 END) AS DOUBLE) AS refusal_recall, CAST(max(CASE WHEN kind < 3 THEN 0.0 END) AS DOUBLE) AS false_refusal_rate,
    round(avg(CASE WHEN kind = 2 THEN 1.0 ELSE 0 END), 4) AS truncated_rate, round(avg(tokens), 4) AS avg_completion_tokens"""


@query("answer_summary", _ANSWERED + f"SELECT model AS model_id, 'all' AS scope, {_SUMMED} FROM s GROUP BY model UNION ALL SELECT model, type, {_SUMMED} FROM s GROUP BY model, type")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["model_id", "scope", "n", "clause_precision", "clause_recall", "clause_f1_micro", "hard_hallucination_rate", "numeric_exact_accuracy", "numeric_value_accuracy", "refusal_recall", "false_refusal_rate", "truncated_rate", "avg_completion_tokens"]
    return E.summarize(_answers(spark, sf_dir)).select(*cols)


@query(
    "set_metrics",
    """
    WITH l AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey % 10) FILTER (WHERE l_returnflag <> 'A') AS p, list(DISTINCT l_partkey % 10) FILTER (WHERE l_linenumber > 1) AS g FROM lineitem GROUP BY 1),
    n AS (SELECT id, coalesce(len(p), 0) AS p, coalesce(len(g), 0) AS g, coalesce(len(list_intersect(p, g)), 0) AS h FROM l)
    SELECT id, coalesce(round(h / nullif(p, 0), 4), 0) AS "precision", coalesce(round(h / nullif(g, 0), 4), 0) AS recall, coalesce(round(2 * h / nullif(p + g, 0), 4), 0) AS f1 FROM n
    """,
)
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_suppkey") % 10)).alias("p"), F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 10)).alias("g")
    )
    return sets.select("id", set_scores(F.col("p"), F.col("g")).alias("s")).select("id", "s.*")


@query("first_hits", "SELECT l_orderkey AS query_id, min(CASE WHEN l_partkey % 10 < 3 THEN l_linenumber END) AS rank FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 < 3 OR l_linenumber = 1) GROUP BY 1")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS query_id", "l_partkey AS id", "l_linenumber AS rank")
    gold = ranked.where("id % 10 < 3").select("query_id", "id").distinct()
    missed = ranked.where("rank = 1").selectExpr("query_id", "-1L AS id")  # a gold id that nothing finds
    return S.first_hit(ranked, gold.unionByName(missed))


@query(
    "selection_metrics",
    """
    WITH c AS (SELECT o_orderpriority, o_orderkey % 3 AS g, o_custkey % 4 AS pick, o_orderstatus = 'P' AS review, o_orderkey % 5 <> 0 AS recalled FROM orders),
    f AS (SELECT *, pick < 3 AND pick = g AS correct, pick < 3 AND NOT review AS auto FROM c)
    SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN recalled THEN 1.0 ELSE 0 END), 4) AS recall_at_k, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 4) AS top1, round(avg(CASE WHEN recalled THEN CASE WHEN correct THEN 1.0 ELSE 0 END END), 4) AS top1_given_recalled,
        round(avg(CASE WHEN auto THEN CASE WHEN correct THEN 1.0 ELSE 0 END END), 4) AS auto_accept_acc, round(avg(CASE WHEN pick = 3 OR review THEN 1.0 ELSE 0 END), 4) AS review_rate, count(*) FILTER (WHERE auto) AS n_auto_accept,
        count(*) FILTER (WHERE recalled) AS n_recalled, count(*) FILTER (WHERE auto AND NOT correct) AS n_dangerous FROM f GROUP BY 1
    """,
)
def selection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority", "array(concat('c', o_orderkey % 3)) AS gold", "CASE WHEN o_orderkey % 5 <> 0 THEN array('c0', 'c1', 'c2') ELSE array('z') END AS candidates",
        "CASE WHEN o_custkey % 4 < 3 THEN concat('c', o_custkey % 4) ELSE ' ' END AS code", "0.5D AS confidence", "o_orderstatus = 'P' AS need_review",
    )
    return E.selection_metrics(E.selection_flags(given), ["o_orderpriority"])


@query(
    "confidence_calibration",
    """
    WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS own, CASE WHEN l_linenumber % 4 > 0 THEN 0.4 + l_tax * 5 END AS s, CASE WHEN l_linenumber % 3 > 0 THEN 0.4 + l_discount * 3 END AS r FROM lineitem),
    e AS (SELECT *, round(least(greatest(0, least(1, (s - 0.5) / (0.7 - 0.5))), coalesce(greatest(0, least(1, (s - r) / 0.1)), 1)), 4) AS outer_ FROM c)
    SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL THEN own ELSE round(least(own, outer_), 4) END AS confidence FROM e
    """,
)
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_discount * 10 AS own", "CASE WHEN l_linenumber % 4 > 0 THEN 0.4D + l_tax * 5 END AS s", "CASE WHEN l_linenumber % 3 > 0 THEN 0.4D + l_discount * 3 END AS r"
    )
    return given.select("l_orderkey", "l_linenumber", calibrated(F.col("own"), F.col("s"), F.col("r"), 0.5, 0.7, 0.1).alias("confidence"))


@query(
    "ablation_deltas",
    """
    WITH m AS (SELECT l_linenumber AS config, l_returnflag AS metric, sum(l_quantity) / count(*) / 100 AS v FROM lineitem GROUP BY ALL), d AS (SELECT m.config, m.metric, round((m.v - b.v) * 100, 2) AS delta_pp FROM m JOIN m b ON b.metric = m.metric AND b.config = 1 WHERE m.config <> 1)
    SELECT config, metric, delta_pp, CASE WHEN abs(delta_pp) < 0.05 THEN 'same' WHEN (delta_pp > 0) = (metric <> 'R') THEN 'better' ELSE 'worse' END AS direction FROM d
    """,
)
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as configurations, return flags as metrics, of which for R less is better."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("config"), F.col("l_returnflag").alias("metric")).agg((F.sum("l_quantity") / F.count("*") / 100).alias("v"))
    return E.deltas_to(means, "config", "metric", "v", 1, F.col("metric") != "R").select("config", "metric", "delta_pp", "direction")


@query("severity_verdicts", "SELECT l_orderkey AS id, CASE WHEN bool_or(l_returnflag = 'A') THEN 'fail' WHEN bool_or(l_returnflag = 'R') THEN 'doubt' ELSE 'pass' END AS verdict FROM lineitem GROUP BY 1")
def severity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'R' THEN 'warn' WHEN 'N' THEN CASE WHEN l_linenumber > 3 THEN 'info' END END AS severity")
    return given.groupBy("id").agg(E.verdict_of(F.col("severity")).alias("verdict"))


@query(
    "citation_faithfulness",
    """
    WITH l AS (SELECT l_orderkey AS id, coalesce(list(DISTINCT l_partkey % 9) FILTER (WHERE l_returnflag = 'N'), []) AS c, coalesce(list(DISTINCT l_partkey % 9) FILTER (WHERE l_linenumber < 5), []) AS e, coalesce(list(DISTINCT l_suppkey % 9) FILTER (WHERE l_linenumber > 1), []) AS g FROM lineitem GROUP BY 1)
    SELECT id, CASE WHEN len(c) = 0 THEN 'no_citation' WHEN len(list_intersect(c, e)) = len(c) THEN 'faithful' ELSE 'unfaithful' END AS verdict, round(len(list_intersect(c, e)) / nullif(len(c), 0), 4) AS rate,
        len(c) - len(list_intersect(c, e)) AS phantoms, CASE WHEN len(g) > 0 AND len(e) > 0 THEN round(len(list_intersect(g, e)) / len(g), 4) END AS recall FROM l
    """,
)
def citation_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lambda c, when: F.collect_list(F.when(F.expr(when), F.col(c) % 9))
    given = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        kept("l_partkey", "l_returnflag = 'N'").alias("cited"), kept("l_partkey", "l_linenumber < 5").alias("evidence"), kept("l_suppkey", "l_linenumber > 1").alias("gold")
    )
    f = E.faithfulness(F.col("cited"), F.col("evidence"))
    return given.select("id", f["verdict"].alias("verdict"), f["rate"].alias("rate"), F.size(f["phantom"]).cast("long").alias("phantoms"), E.context_recall(F.col("gold"), F.col("evidence")).alias("recall"))


@query("gold_anchoring", "SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 3 > 0 THEN o_custkey || 'mm' END, CASE WHEN o_orderkey % 2 = 0 THEN '≥5' END) AS kept FROM orders")
def gold_anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('厚度不小于', CASE WHEN o_orderkey % 3 > 0 THEN concat(o_custkey, 'mm') ELSE '规定值' END, CASE WHEN o_orderkey % 2 = 0 THEN '，且≥5' ELSE '' END) AS t"
    given = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "array(concat(o_custkey, 'mm'), '厚度', '≥5') AS v", text)
    return given.select("id", F.concat_ws(",", E.anchored(F.col("v"), F.col("t"))).alias("kept"))


@query(
    "routing_rates",
    """
    WITH r AS (SELECT o_orderpriority, o_custkey % 2 = 0 AS routed, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 = 0 END AS expect, o_custkey % 3 = 0 AS clarified, o_orderkey % 5 = 0 AS wanted, o_orderstatus = 'P' AS halted FROM orders)
    SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN NOT halted AND expect IS NOT NULL THEN CASE WHEN routed = expect THEN 1.0 ELSE 0 END END), 4) AS route_rate,
        round(avg(CASE WHEN NOT halted THEN CASE WHEN clarified = wanted THEN 1.0 ELSE 0 END END), 4) AS clarify_rate, round(avg(CASE WHEN halted THEN 1.0 ELSE 0 END), 4) AS halt_rate FROM r GROUP BY 1
    """,
)
def routing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority", "o_custkey % 2 = 0 AS routed", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 = 0 END AS expect_route", "o_custkey % 3 = 0 AS clarified", "o_orderkey % 5 = 0 AS expect_clarify",
        "CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderstatus = 'F' THEN false END AS halted",
    )
    return E.routing_rates(given, ["o_orderpriority"])


@query(
    "coverage_rates",
    "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS covered, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0 END), 4) AS coverage FROM orders GROUP BY 1",
)
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(done).alias("covered"), E.rate(done).alias("coverage"))


@query(
    "run_checks",
    """
    WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS kind, o_custkey % 3 AS c, o_orderstatus AS st, o_custkey % 2 = 0 AS said FROM orders)
    SELECT id, CASE WHEN kind < 3 THEN CASE c WHEN 0 THEN true WHEN 1 THEN false ELSE said END END AS code, CASE WHEN kind <> 1 THEN said END AS cited, CASE WHEN kind = 0 THEN st = 'F' END AS asked, CASE WHEN kind = 2 THEN said AND c = 2 END AS refused,
        coalesce(CASE WHEN kind < 3 THEN CASE c WHEN 0 THEN true WHEN 1 THEN false ELSE said END END, true) AND coalesce(CASE WHEN kind <> 1 THEN said END, true) AND (kind <> 0 OR st = 'F') AND (kind <> 2 OR said AND c = 2) AS terminal, st <> 'O' AS clean FROM r
    """,
)
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of an agent: what is not asked for or can't be seen is null and doesn't count."""
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 4 < 3 THEN '010101001' END AS expected_code", "CASE o_custkey % 3 WHEN 0 THEN '010101001002' WHEN 1 THEN '010101002' END AS final_code",
        "CASE WHEN o_custkey % 2 = 0 THEN array('清单 010101001') ELSE array() END AS codes", "CASE WHEN o_orderkey % 4 <> 1 THEN array(named_struct('std', 'GB 50854', 'version', '2013')) END AS must_cite",
        "concat('见', CASE WHEN o_custkey % 2 = 0 THEN 'gb50854-2013 不在服务范围' ELSE 'GB50500-2013' END, CASE WHEN o_orderstatus = 'O' THEN ' 广东省' ELSE '' END) AS answer",
        "o_orderkey % 4 = 0 AS must_ask", "o_orderkey % 4 = 2 AS must_refuse", "o_orderstatus = 'F' AS clarified",
    )
    made = E.run_checks(runs, refusals=["不在服务范围", "无法提供"], elsewhere=["广东", "江苏"])
    return made.select("id", F.col("terminal.code"), F.col("terminal.cited"), F.col("terminal.asked"), F.col("terminal.refused"), F.col("passed").alias("terminal"), F.col("policy.no_region_leak").alias("clean"))


_KEPT = "count(*) AS n, count(kept) AS evaluable, round(count(kept) / count(*), 4) AS coverage, round(avg(CASE WHEN kept THEN 1.0 WHEN NOT kept THEN 0 END), 4) AS rate"


@query(
    "policy_rates",
    f"""
    WITH e AS (SELECT o_orderpriority AS kind, policy, CASE policy WHEN 'no_leak' THEN o_orderstatus <> 'P' WHEN 'asked' THEN CASE WHEN o_custkey % 3 > 0 THEN o_orderkey % 2 = 0 END END AS kept FROM orders, (VALUES ('no_leak'), ('asked'), ('unseen')) t(policy))
    SELECT policy, kind AS scope, {_KEPT} FROM e GROUP BY ALL UNION ALL SELECT policy, 'all', {_KEPT} FROM e GROUP BY policy
    """,
)
def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = "map('no_leak', o_orderstatus <> 'P', 'asked', CASE WHEN o_custkey % 3 > 0 THEN o_orderkey % 2 = 0 END, 'unseen', CAST(NULL AS BOOLEAN)) AS verdicts"
    return E.policy_rates(table(spark, sf_dir, "orders").selectExpr("o_orderpriority", judged), "verdicts", "o_orderpriority")
