"""Costing: unit rates in rounded stages, line totals, roll-ups, independent verification, schemes, price composition and trend."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.functions.values import amount, cents, in_period
from sparquill.operators.relational import either_key_join

# Categories of cost, in display order; anything else is "other".
CATEGORIES = {"人工": "labor", "材料": "material", "机械": "machine"}
TOLERANCE, MOST_COMBINATIONS, MOST_SCHEMES, MOST_ALTERNATIVES = 0.02, 200, 8, 3


def category_order(category: Column) -> Column:
    out = F.when(category == "人工", 0)
    for i, name in enumerate(("材料", "机械"), 1):
        out = out.when(category == name, i)
    return out.otherwise(3)


def unit_rates(components: DataFrame, keys: list[str], rates: DataFrame | None = None, names: dict[str, str] = CATEGORIES) -> DataFrame:
    """One row per key: costs by category, base, management fee, profit, risk fee and unit price, each rounded as it is made.

    Decimal arithmetic, half up, so that half cents don't hang on binary fractions.

    ``components``: keys, category, consumption, unit_price; rows without both numbers are counted as ``skipped``.
    ``rates``: keys, management_rate, profit_rate, risk_rate; a missing rate is 0 and ``rates_missing`` says if all are.
    """
    number = lambda c: F.col(c).try_cast("decimal(18,6)")
    rows = components.withColumn("_a", F.round(number("consumption") * number("unit_price"), 2))
    named = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in names.items()], F.lit("other"))
    kinds = [*names.values(), "other"]
    base = rows.withColumn("_k", named).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_a").cast("decimal(18,2)"))), F.lit(0)).cast("decimal(18,2)").alias(k) for k in kinds],
        F.count_if(F.col("_a").isNull()).alias("skipped"),
    )
    base = base.withColumn("rmm", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])).cast("decimal(18,2)"))
    fees = ["management_rate", "profit_rate", "risk_rate"]
    base = base.join(rates.select(*keys, *fees), keys, "left") if rates is not None else base.withColumns({f: F.lit(None).cast("double") for f in fees})
    out = base.withColumn("rates_missing", F.coalesce(*fees).isNull())
    for fee, name in zip(fees, ("management_fee", "profit", "risk_fee"), strict=True):
        out = out.withColumn(name, F.round(F.col("rmm") * F.coalesce(F.col(fee).cast("decimal(9,6)"), F.lit(0)), 2).cast("decimal(18,2)"))
    out = out.withColumn("unit_price", F.col("rmm") + F.col("management_fee") + F.col("profit") + F.col("risk_fee"))
    money = [*kinds, "rmm", "management_fee", "profit", "risk_fee", "unit_price"]
    return out.drop(*fees).withColumns({c: F.col(c).cast("double") for c in money})


def line_totals(rows: DataFrame, price: str = "unit_price", quantity: str = "quantity") -> DataFrame:
    """``rows`` with ``line_total``; null where a number is missing."""
    return rows.withColumn("line_total", F.round(F.col(price).try_cast("decimal(18,6)") * F.col(quantity).try_cast("decimal(18,6)"), 2).cast("double"))


def roll_up(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Total of what is a number, with counts of rows included and skipped."""
    number = F.col(value).try_cast("double")
    return rows.groupBy(*(keys or [])).agg(F.coalesce(F.sum(number), F.lit(0.0)).alias("total"), F.count(number).alias("included"), F.count_if(number.isNull()).alias("skipped"))


def check_bill(rows: DataFrame) -> DataFrame:
    """(code, name, unit) rows with ``issues`` and ``severity``; a bad code is an error, a missing name or unit a warning."""
    bad = ~F.coalesce(F.length(F.trim("code")).isin(9, 12), F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issues = F.array_compact(F.array(F.when(bad, "invalid code"), F.when(blank("name"), "missing name"), F.when(blank("unit"), "missing unit")))
    return rows.withColumn("issues", issues).withColumn("severity", F.when(bad, "error").when(F.size("issues") > 0, "warn"))


def bill_verdict(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return checked.groupBy(*(keys or [])).agg(F.when(F.bool_or(F.coalesce(F.col("severity") == "error", F.lit(False))), "reject").otherwise("pass").alias("verdict"), F.sum(F.size("issues")).alias("issues"))


def code9(code: Column) -> Column:
    """First 9 digits of a 9- or 12-digit code, else null."""
    return F.when(F.trim(code).rlike(r"^\d{9}(\d{3})?$"), F.substring(F.trim(code), 1, 9))


def verify(claims: DataFrame, components: DataFrame, rates: DataFrame | None, key: str, regions: list[str], editions: list[str], names: dict[str, str] = CATEGORIES) -> DataFrame:
    """One row per claim (key, code, region, edition, claimed): ``findings`` as (type, severity) and ``verdict``.

    The unit price is recomputed from the components and must agree within the tolerance; claims whose components are
    incomplete or missing are doubts, claims of other regions or editions or with bad codes fail.
    """
    again = unit_rates(components, [key], rates, names).select(key, "labor", "material", "skipped", F.col("unit_price").alias("recomputed"))
    rows = claims.join(again, key, "left")
    whole = F.col("skipped") == 0
    off = F.round(F.abs(F.col("recomputed") - F.col("claimed")), 2) > TOLERANCE
    rule = lambda name, severity, c: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity")))
    findings = F.array_compact(
        F.array(
            rule("code_format", "critical", F.col("code").isNotNull() & code9(F.col("code")).isNull()),
            rule("region_leak", "critical", ~F.trim("region").isin(*regions)),
            rule("spec_invalid", "critical", ~F.trim("edition").isin(*editions)),
            rule("components_incomplete", "warn", F.col("skipped") > 0),
            rule("arith_mismatch", "critical", whole & off),
            rule("uncheckable_price", "warn", F.col("recomputed").isNull() & F.col("claimed").isNotNull()),
            rule("basis_empty", "warn", whole & (F.col("labor") <= 0) & (F.col("material") <= 0)),
        )
    )
    has = lambda s: F.exists("findings", lambda f: f["severity"] == s)
    return rows.withColumn("findings", findings).withColumn("verdict", F.when(has("critical"), "fail").when(has("warn"), "doubt").otherwise("pass"))


def missing_prices(composed: DataFrame) -> DataFrame:
    """Resources without a price, each once, by ``code::name::spec``."""
    return composed.where("price_status = 'no_source'").select(F.concat_ws("::", "code", "res_name", F.coalesce("spec", F.lit(""))).alias("price_key")).distinct()


def write_back(components: DataFrame, prices: DataFrame) -> DataFrame:
    """Components (price_key, unit_price, price_status) with the prices given by hand."""
    given = prices.select("price_key", F.col("unit_price").alias("_p"))
    joined = components.join(given, "price_key", "left")
    return joined.withColumns({"unit_price": F.coalesce("_p", "unit_price"), "price_status": F.when(F.col("_p").isNotNull(), "manual").otherwise(F.col("price_status"))}).drop("_p")


def compose(links: DataFrame, prices: DataFrame, on_date=None, region: str | None = None) -> DataFrame:
    """Each resource of each bill item with its price: its own if there is one, else that of the material it maps to.

    ``links``: link_id, resource_id, price_resource_id and unit_factor (of the mapping, may be null), consumption, ...
    ``prices``: rp_resource_id, region, price, period_start, period_end. Of several periods the latest counts.
    """
    rows = prices if region is None else prices.where(F.col("region") == region)
    if on_date is not None:
        rows = rows.where(in_period(F.lit(on_date), F.col("period_start"), F.col("period_end")))
    found = either_key_join(links, rows.drop("region"), "resource_id", "price_resource_id", "rp_resource_id", F.desc("period_start"), ids=["link_id"])
    factor = F.when(F.col("via") == "mapped", F.coalesce("unit_factor", F.lit(1.0))).when(F.col("via") == "direct", 1.0)
    return found.withColumns(
        {"factor": factor, "amount": amount(F.col("consumption"), F.col("price"), factor), "price_status": F.when(F.col("price").isNotNull(), "matched").otherwise("no_source")}
    )


def nested(composed: DataFrame, bill: list[str], quota: list[str], *columns: str, order: tuple[str, ...] = ("res_name",)) -> DataFrame:
    """One row per (bill, quota) with its resources in category order, those of one category by the columns of ``order``."""
    item = F.struct(category_order(F.col("category")).alias("o"), F.struct(*order).alias("n"), F.struct(*columns).alias("r"))
    made = composed.groupBy(*bill, *quota).agg(F.array_sort(F.collect_list(item)).alias("_r"), F.sum("amount").alias("subtotal"), F.count_if(F.col("price_status") == "no_source").alias("unpriced"))
    return made.withColumn("resources", F.transform("_r", lambda x: x["r"])).drop("_r")


def schemes(quotas: DataFrame, bill: str, most: int = MOST_SCHEMES, alternatives: int = MOST_ALTERNATIVES) -> DataFrame:
    """(bill, scheme, codes, score, base_price): ways to choose one quota from each group of alternatives.

    ``quotas``: bill, ordinal, quota_code, confidence, base_price. Codes of one six-character prefix are alternatives;
    a prefix with one code is in every scheme. Without alternatives, or with over 200 combinations, all codes are one
    scheme. The score is the least confidence. One bill's quotas are one group: a handful by nature.
    """
    kinds = dict(quotas.dtypes)
    item = F.struct("ordinal", "quota_code", F.col("confidence").cast("double").alias("c"), F.col("base_price").cast("double").alias("p"))
    listed = quotas.groupBy(bill).agg(F.array_sort(F.collect_list(item)).alias("q"))
    listed = listed.select(bill, F.col("q.quota_code"), F.col("q.c"), F.col("q.p"))  # a field of an array of structs is an array

    def ways(codes: list[str], trust: list[float | None], price: list[float | None]) -> list[tuple]:
        by: dict[str, list[int]] = {}
        for i, code in enumerate(codes):
            by.setdefault(code[:6], []).append(i)
        worth = [-1.0 if t is None or t != t else t for t in trust]
        choices = [sorted(g, key=lambda i: -worth[i])[:alternatives] for g in by.values() if len(g) > 1]
        fixed = [g[0] for g in by.values() if len(g) == 1]
        size = 1
        for c in choices:
            size *= len(c)
        picks = [sorted([*fixed, *p]) for p in product(*choices)] if choices and size <= MOST_COMBINATIONS else [list(range(len(codes)))]
        made = []
        for p in picks:
            known = [trust[i] for i in p if trust[i] is not None and trust[i] == trust[i]]
            priced = [price[i] for i in p if price[i] is not None and price[i] == price[i]]
            made.append(([codes[i] for i in p], min(known) if known else None, round(sum(priced), 2) if priced else None))
        made.sort(key=lambda m: -(m[1] if m[1] is not None else -1.0))
        return made[:most]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (b, n, *m) for b, codes, c, p in zip(batch[bill], batch["quota_code"], batch["c"], batch["p"], strict=True) for n, m in enumerate(ways(list(codes), list(c), list(p)), 1)
            ]
            yield pd.DataFrame(rows, columns=[bill, "scheme", "codes", "score", "base_price"])

    return listed.mapInPandas(run, f"{bill} {kinds[bill]}, scheme int, codes array<string>, score double, base_price double")


def trend(prices: DataFrame, keys: list[str], period: str, price: str) -> DataFrame:
    """(keys, from_period, to_period, delta, pct) between neighbouring periods that are there; none from 0 or without a number."""
    w = Window.partitionBy(*keys).orderBy(period)
    number = F.col(price).try_cast("double")
    rows = prices.withColumn("_p", number).withColumns({"_q": F.lag("_p").over(w), "from_period": F.lag(period).over(w)})
    good = rows.where("_q IS NOT NULL AND _q <> 0 AND _p IS NOT NULL")
    return good.select(*keys, "from_period", F.col(period).alias("to_period"), cents(F.col("_p") - F.col("_q")).alias("delta"), F.round((F.col("_p") - F.col("_q")) / F.col("_q") * 100, 2).alias("pct"))


def resolve_codes(rows: DataFrame, keys: list[str], name: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of one code: with one name they merge (units in order, each once), with several all of them are conflicts."""
    marked = rows.withColumn("_n", name)
    per = marked.groupBy(*keys).agg(F.countDistinct("_n").alias("names"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit"))), lambda x: x["unit"])).alias("units"), F.min_by("name", "ordinal").alias("name"))
    return per.where("names <= 1").drop("names"), marked.drop("_n").join(per.where("names > 1").select(*keys), keys, "left_semi")


def apply_rules(rows: DataFrame, text: str, rules: list[dict], then: list[str]) -> DataFrame:
    """The values of the first rule whose ``contains`` words are all in the text; rules are code, so they travel in the plan."""
    hit = lambda r: F.forall(F.array(*map(F.lit, r["contains"])), lambda w: F.contains(F.col(text), w))
    return rows.withColumns({c: F.coalesce(*[F.when(hit(r), F.lit(r.get(c))) for r in rules]) for c in then})


def components_of(frames: Iterator[DataFrame]) -> DataFrame:
    """Several component tables as one."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def match_bills(asked: DataFrame, truth: DataFrame | None, candidates: DataFrame | None, least: float = 0.86, margin: float = 0.08, top: int = 10, id_col: str = "id") -> DataFrame:
    """One row per request (id, code, feature): ``mode``, ``status``, ``verdict``, ``findings`` and ``selected``.

    A request with a code is verified: its form, that it exists, that required features are named, and that it is among
    the ``top`` candidates found for its description. One without a code is selected: the best candidate if it is good
    enough and clear of the next one, else it needs a review. ``truth``: code9, required (array); ``candidates``: id,
    candidate (9 digits), score. A request without description has no cross-check of candidates. If the requests have a
    column ``provided`` (array), required features must be in it, where it is not null; else they must occur in the text.

    A service that did not answer is no fault of the request: without ``truth`` (None) a verification is ``blocked`` and
    has no verdict, and without ``candidates`` a selection is; a verification then only notes that it wasn't cross-checked.
    """
    code = code9(F.col("code"))
    provided = F.col("provided") if "provided" in asked.columns else F.lit(None).cast("array<string>")
    rows = asked.select(id_col, "code", F.coalesce("feature", F.lit("")).alias("feature"), code.alias("_code9"), provided.alias("_provided"))
    no_truth, no_candidates = truth is None, candidates is None
    if no_truth:
        truth = asked.sparkSession.createDataFrame([], "code9 string, required array<string>")
    if no_candidates:
        candidates = asked.sparkSession.createDataFrame([], f"{id_col} {asked.schema[id_col].dataType.simpleString()}, candidate string, score double")
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "candidate")
    ranked = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    best = ranked.groupBy(id_col).agg(
        F.max(F.when(F.col("_n") == 1, F.col("candidate"))).alias("_first"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("_score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_next")
    )
    hits = ranked.select(id_col, F.col("candidate").alias("_code9")).distinct().withColumn("_recalled", F.lit(True))
    rows = rows.join(best, id_col, "left").join(hits, [id_col, "_code9"], "left")
    clear = F.col("_next").isNull() | (F.round(F.col("_score") - F.col("_next"), 9) >= margin)
    verify = F.col("code").isNotNull()
    decided = ~verify & F.coalesce((F.col("_score") >= least) & clear, F.lit(False))
    rows = rows.withColumns({"_decided": decided, "_wanted": F.when(verify, F.col("_code9")).when(decided, F.col("_first"))})
    known = truth.select(F.col("code9").alias("_wanted"), "required", F.lit(True).alias("_exists"))
    rows = rows.join(known, "_wanted", "left")
    exists = F.coalesce("_exists", F.lit(False))
    found = lambda name, severity, c: F.when(c, F.array(F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("about"))))
    named = lambda r: F.coalesce(F.array_contains("_provided", r), F.contains(F.col("feature"), r))
    lacking = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda r: ~named(r))
    lacks = F.transform(lacking, lambda r: F.struct(F.lit("missing_feature").alias("type"), F.lit("warn").alias("severity"), r.alias("about")))
    described = F.trim("feature") != ""
    blocked = F.when(verify, F.lit(no_truth) & F.col("_code9").isNotNull()).otherwise(F.lit(no_candidates))
    parts = [
        found("code_format", "critical", verify & F.col("_code9").isNull()),
        found("truth_unavailable" if no_truth else "code_not_found", "warn" if no_truth else "critical", verify & F.col("_code9").isNotNull() & ~exists),
        lacks,
        found("recall_unavailable" if no_candidates else "recall_miss", "info" if no_candidates else "warn", verify & ~blocked & F.col("_code9").isNotNull() & described & F.col("_recalled").isNull()),
        found("no_candidates", "warn", ~verify & ~blocked & F.col("_first").isNull()),
        found("low_confidence", "warn", ~verify & F.col("_first").isNotNull() & ~F.col("_decided")),
    ]
    none = F.array().cast("array<struct<type:string,severity:string,about:string>>")
    rows = rows.withColumn("findings", F.concat(*[F.coalesce(p, none) for p in parts]))
    has = lambda s: F.exists("findings", lambda f: f["severity"] == s)
    done = ~blocked & (verify | F.col("_decided"))
    return rows.select(
        id_col,
        "code",
        F.when(verify, "verify").otherwise("select").alias("mode"),
        F.when(blocked, "blocked").when(done, "done").otherwise("need_review").alias("status"),
        F.when(done, F.when(has("critical"), "fail").when(has("warn"), "doubt").otherwise("pass")).alias("verdict"),
        "findings",
        F.when(F.col("_decided"), F.col("_first")).alias("selected"),
    )
