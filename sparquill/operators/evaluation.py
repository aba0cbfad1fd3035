"""Evaluation: row scores, macro and micro aggregates, ranking metrics, calibration, repeated runs, deltas, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import citations, is_refusal, is_repetitive, number_values
from sparquill.functions.values import matched_count, ratio, set_scores


def rate(condition: Column, among: Column | None = None, places: int | None = 4) -> Column:
    """Share of rows where ``condition`` is true, of those where ``among`` holds and it is known; null of none."""
    value = F.when(condition, 1.0).when(condition.isNotNull(), 0.0)
    out = F.avg(value if among is None else F.when(among, value))
    return out if places is None else F.round(out, places)


def mean(value: Column, places: int = 4) -> Column:
    return F.round(F.avg(value), places)


def score_answers(evals: DataFrame, answers: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """One row per (model_id, id): citations against gold clauses, numbers against gold values, refusal, health.

    ``evals``: id, type, question, gold_clauses, gold_values (strings), should_refuse. ``answers``: id, model_id, answer,
    finish_reason, completion_tokens. ``valid``: clause_id of every clause that exists; citations of others are invalid.
    """
    asked = F.array_distinct(F.transform(citations(F.col("question")), lambda c: F.substring_index(c, "_", 1)))
    golden = F.array_distinct(F.transform(F.filter("gold_clauses", lambda c: F.contains(c, F.lit("_"))), lambda c: F.substring_index(c, "_", 1)))
    default = F.when(F.size(asked) == 1, asked[0]).when(F.size(golden) == 1, golden[0]).otherwise("")
    rows = evals.withColumn("_std", default).join(answers, "id")
    rows = rows.withColumn("predicted_clauses", F.array_sort(citations(F.col("answer"), F.col("_std"))))
    values = F.filter(F.transform("gold_values", lambda v: F.regexp_replace(F.trim(v), "%$", "").try_cast("double").cast("decimal(38,10)")), lambda v: v.isNotNull())
    scores = set_scores(F.col("predicted_clauses"), F.col("gold_clauses"))
    cited = F.size("gold_clauses") > 0
    out = rows.select(
        "model_id",
        "id",
        "type",
        "gold_clauses",
        "predicted_clauses",
        F.size(F.array_intersect("predicted_clauses", "gold_clauses")).alias("clause_tp"),
        F.size("predicted_clauses").alias("clause_predicted"),
        F.size("gold_clauses").alias("clause_gold"),
        F.when(cited, scores["precision"]).alias("clause_precision"),
        F.when(cited, scores["recall"]).alias("clause_recall"),
        F.when(cited, scores["f1"]).alias("clause_f1"),
        F.size(values).alias("numeric_gold"),
        matched_count(values, number_values(F.col("answer"))).alias("numeric_matched"),
        F.coalesce("should_refuse", F.lit(False)).alias("refusal_gold"),
        is_refusal(F.col("answer")).alias("refusal_pred"),
        (F.trim("answer") == "").alias("empty"),
        F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("truncated"),
        is_repetitive(F.col("answer")).alias("repetitive"),
        "completion_tokens",
    )
    out = out.withColumn("numeric_exact", F.when(F.col("numeric_gold") > 0, F.col("numeric_gold") == F.col("numeric_matched")))
    if valid is None:
        return out.withColumn("invalid_clauses", F.array().cast("array<string>"))
    said = out.select("model_id", "id", F.explode("predicted_clauses").alias("clause_id"))
    wrong = said.join(valid.select("clause_id"), "clause_id", "left_anti").groupBy("model_id", "id").agg(F.array_sort(F.collect_set("clause_id")).alias("invalid_clauses"))
    return out.join(wrong, ["model_id", "id"], "left").withColumn("invalid_clauses", F.coalesce("invalid_clauses", F.array().cast("array<string>")))


def summary_measures() -> list[Column]:
    """Aggregates over rows of ``score_answers``; null where a measure has no rows."""
    cited, numeric = F.col("clause_f1").isNotNull(), F.col("numeric_gold") > 0
    part = lambda c: F.sum(F.when(cited, F.col(c)))
    p, r = ratio(part("clause_tp"), part("clause_predicted")), ratio(part("clause_tp"), part("clause_gold"))
    return [
        F.count("*").alias("n"),
        F.count_if(cited).alias("clause_n"),
        mean(F.col("clause_precision")).alias("clause_precision"),
        mean(F.col("clause_recall")).alias("clause_recall"),
        mean(F.col("clause_f1")).alias("clause_f1"),
        F.round(p, 4).alias("clause_precision_micro"),
        F.round(r, 4).alias("clause_recall_micro"),
        F.round(ratio(2 * p * r, p + r), 4).alias("clause_f1_micro"),
        rate(F.size("invalid_clauses") > 0).alias("hard_hallucination_rate"),
        F.count_if(numeric).alias("numeric_n"),
        rate(F.col("numeric_exact")).alias("numeric_exact_accuracy"),
        ratio(F.sum(F.when(numeric, F.col("numeric_matched"))), F.sum(F.when(numeric, F.col("numeric_gold"))), 4).alias("numeric_value_accuracy"),
        rate(F.col("refusal_gold") == F.col("refusal_pred")).alias("refusal_accuracy"),
        rate(F.col("refusal_pred"), F.col("refusal_gold")).alias("refusal_recall"),
        rate(F.col("refusal_pred"), ~F.col("refusal_gold")).alias("false_refusal_rate"),
        rate(F.col("empty")).alias("empty_rate"),
        rate(F.col("truncated")).alias("truncated_rate"),
        rate(F.col("repetitive")).alias("repetitive_rate"),
        mean(F.col("completion_tokens")).alias("avg_completion_tokens"),
    ]


def summarize(rows: DataFrame, model: str = "model_id", kind: str = "type", measures: list[Column] | None = None) -> DataFrame:
    """Per model over all rows and per type, in one pass of grouping sets; ``scope`` is ``all`` or the type."""
    made = rows.groupingSets([[F.col(model)], [F.col(model), F.col(kind)]], F.col(model), F.col(kind))
    out = made.agg(F.grouping_id().alias("_g"), *(measures or summary_measures()))
    return out.withColumn("scope", F.when(F.col("_g") > 0, F.lit("all")).otherwise(F.col(kind))).drop("_g", kind)


def ranking(hits: DataFrame, cut: int = 10, keys: list[str] | None = None) -> DataFrame:
    """From (rank or null) per query: n, top1, top3, recall at ``cut``, MRR (a miss counts 0), mean rank of hits."""
    r = F.when(F.col("rank") <= cut, F.col("rank"))
    at = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 4)
    return hits.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), at(1).alias("top1"), at(3).alias("top3"), at(cut).alias("recall"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(r), 4).alias("mean_rank")
    )


def selection_flags(rows: DataFrame) -> DataFrame:
    """Flags of one choice: rows (gold array, candidates array, code, confidence, need_review)."""
    code = F.nullif(F.trim(F.col("code").cast("string")), F.lit(""))
    review = F.coalesce("need_review", F.lit(False))
    right = F.coalesce(F.array_contains("gold", code), F.lit(False))
    return rows.withColumns(
        {
            "recalled": F.arrays_overlap("gold", "candidates"),
            "correct": right,
            "auto_accept": code.isNotNull() & ~review,
            "dangerous": code.isNotNull() & ~review & ~right,
            "abstained": code.isNull() | review,
        }
    )


def selection_metrics(flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return flags.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        rate(F.col("recalled")).alias("recall_at_k"),
        rate(F.col("correct")).alias("top1"),
        rate(F.col("correct"), F.col("recalled")).alias("top1_given_recalled"),
        rate(F.col("correct"), F.col("auto_accept")).alias("auto_accept_acc"),
        rate(F.col("abstained")).alias("review_rate"),
        F.count_if("auto_accept").alias("n_auto_accept"),
        F.count_if("recalled").alias("n_recalled"),
        F.count_if("dangerous").alias("n_dangerous"),
    )


def histogram(rows: DataFrame, value: str, edges: list[float], correct: Column | None = None) -> DataFrame:
    """(bucket, lo, hi, n[, accuracy]): half-open buckets between the edges; empty ones are kept."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bucket int, lo double, hi double")
    which = F.coalesce(*[F.when((F.col(value) >= a) & (F.col(value) < b), F.lit(i)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    measures = [F.count("*").alias("n"), *([rate(correct).alias("accuracy")] if correct is not None else [])]
    found = rows.withColumn("bucket", which).where("bucket IS NOT NULL").groupBy("bucket").agg(*measures)
    return table.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pass_k(runs: DataFrame, task: str, k: int) -> DataFrame:
    """(task, runs, passed, pass_k): all runs pass, there are ``k`` at least, and none violates a policy."""
    return runs.groupBy(task).agg(
        F.count("*").alias("runs"), F.count_if("passed").alias("passed"), ((F.count("*") >= k) & F.bool_and(F.coalesce("passed", F.lit(False))) & ~F.bool_or(F.coalesce("violation", F.lit(False)))).alias("pass_k")
    )


def spread_by(rows: DataFrame, config: str, value: str) -> DataFrame:
    """(config, n, mean, stddev, min, max); the deviation of one row is 0."""
    return rows.groupBy(config).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def deltas_to(rows: DataFrame, config: str, metric: str, value: str, baseline: str, higher_is_better: Column | None = None, dead_band: float = 0.05) -> DataFrame:
    """Each metric of each configuration against the baseline's, in percentage points, with its direction."""
    base = rows.where(F.col(config) == baseline).select(metric, F.col(value).alias("base"))
    out = rows.where(F.col(config) != baseline).join(base, metric, "left").withColumn("delta_pp", F.round((F.col(value) - F.col("base")) * 100, 2))
    up = F.lit(True) if higher_is_better is None else higher_is_better
    flat = F.abs("delta_pp") < dead_band
    return out.withColumn("direction", F.when(F.col("delta_pp").isNull(), None).when(flat, "same").when((F.col("delta_pp") > 0) == up, "better").otherwise("worse"))


def agreement(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Share of rows on which two judges agree; two nulls (unparsable) agree."""
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("agreed"), F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")), 4).alias("agreement"))


def verdict_of(severity: Column) -> Column:
    """Aggregate: any critical fails, else any warning is a doubt, else pass."""
    rank = F.max(F.when(severity == "critical", 2).when(severity == "warn", 1).otherwise(0))
    return F.when(rank == 2, "fail").when(rank == 1, "doubt").otherwise("pass")


def faithfulness(cited: Column, evidence: Column) -> Column:
    """(verdict, rate, phantom): distinct citations that the evidence has."""
    own = F.array_distinct(cited)
    hit = F.size(F.array_intersect(own, evidence))
    return F.struct(
        F.when(F.size(own) == 0, "no_citation").when(hit == F.size(own), "faithful").otherwise("unfaithful").alias("verdict"),
        F.when(F.size(own) > 0, F.round(hit / F.size(own), 4)).alias("rate"),
        F.array_except(own, evidence).alias("phantom"),
    )


def context_recall(gold: Column, evidence: Column) -> Column:
    """Share of gold ids in the evidence; null if either has none."""
    return F.when((F.size(gold) > 0) & (F.size(evidence) > 0), F.round(F.size(F.array_intersect(gold, evidence)) / F.size(F.array_distinct(gold)), 4))


def anchored(values: Column, text: Column, most_chars: int = 20) -> Column:
    """Gold values that occur in the source text, start with a digit or sign, and are short."""
    return F.filter(values, lambda v: F.contains(text, v) & (F.length(v) <= most_chars) & v.rlike(r"^[-+±≥≤<>]?\s*\d"))


def routing_rates(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shares of requests routed, clarified and halted; halted ones are out of the first two; expectations decide."""
    live = ~F.coalesce("halted", F.lit(False))
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        rate(F.col("routed") == F.col("expect_route"), live & F.col("expect_route").isNotNull()).alias("route_rate"),
        rate(F.col("clarified") == F.col("expect_clarify"), live).alias("clarify_rate"),
        rate(~live).alias("halt_rate"),
    )


def run_checks(runs: DataFrame, refusals: list[str], elsewhere: list[str]) -> DataFrame:
    """``runs`` with ``terminal`` and ``policy`` (structs of true, false or null) and ``passed``.

    A check that a run doesn't ask for, or that can't be seen from outside, is null and does not count. ``runs``: answer,
    expected_code, final_code, codes (strings that it showed), must_cite (array of std, version), must_ask, must_refuse,
    clarified. ``refusals`` are words of which a refusal has one; ``elsewhere`` are words that leak another region.
    """
    nine = lambda c: F.nullif(F.regexp_extract(c, r"(?<!\d)(\d{9})(?:\d{3})?(?!\d)", 1), F.lit(""))
    told = F.coalesce("answer", F.lit(""))
    plain = lambda c: F.upper(F.regexp_replace(c, r"[\s-]", ""))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(told, w))
    shown = F.transform(F.coalesce("codes", F.array().cast("array<string>")), nine)
    code = F.when(nine(F.col("expected_code")).isNotNull(), F.coalesce(nine(F.col("final_code")) == nine(F.col("expected_code")), F.array_contains(F.array_compact(shown), nine(F.col("expected_code")))))
    std = lambda c: c["std"].isNull() | F.contains(plain(told), plain(c["std"]))
    version = lambda c: c["version"].isNull() | F.contains(told, c["version"])
    terminal = {
        "code": code,
        "cited": F.when(F.size("must_cite") > 0, F.forall("must_cite", lambda c: std(c) & version(c))),
        "asked": F.when(F.col("must_ask"), F.coalesce("clarified", F.lit(False))),
        "refused": F.when(F.col("must_refuse"), any_of(refusals) & F.col("final_code").isNull()),
    }
    policy = {"no_region_leak": ~any_of(elsewhere), "no_unseen_arithmetic": F.lit(None).cast("boolean")}
    passed = F.lit(True)
    for c in terminal.values():
        passed = passed & F.coalesce(c, F.lit(True))
    return runs.withColumns({"terminal": F.struct(*[c.alias(k) for k, c in terminal.items()]), "policy": F.struct(*[c.alias(k) for k, c in policy.items()]), "passed": passed})


def policy_rates(runs: DataFrame, policies: str, kind: str) -> DataFrame:
    """(policy, scope, n, evaluable, coverage, rate): each policy over all runs and per ``kind``; null verdicts can't be judged.

    ``policies`` is a map of verdicts. ``coverage`` is the share of runs that could be judged, ``rate`` that of these that kept the policy.
    """
    each = runs.select(F.col(kind).alias("_kind"), F.explode(policies).alias("policy", "_kept"))
    measures = [F.count("*").alias("n"), F.count("_kept").alias("evaluable"), F.round(F.count("_kept") / F.count("*"), 4).alias("coverage"), rate(F.col("_kept")).alias("rate")]
    return summarize(each, "policy", "_kind", measures)
