"""Functions on vectors, sets, dates, money and JSON as column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    """0.0 where a norm is (nearly) zero."""
    return F.when((norm(a) > least) & (norm(b) > least), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def unit(a: Column, least: float = 1e-9) -> Column:
    """The vector over its norm, which counts at least ``least``."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(least)))


# ---- sets and scores


def set_scores(found: Column, gold: Column) -> Column:
    """(precision, recall, f1) of two sets, 4 places, 0 where undefined."""
    hit = F.size(F.array_intersect(F.array_distinct(found), F.array_distinct(gold)))
    n, m = F.size(F.array_distinct(found)), F.size(F.array_distinct(gold))
    return F.struct(
        F.when(n > 0, F.round(hit / n, 4)).otherwise(0.0).alias("precision"),
        F.when(m > 0, F.round(hit / m, 4)).otherwise(0.0).alias("recall"),
        F.when(n + m > 0, F.round(2 * hit / (n + m), 4)).otherwise(0.0).alias("f1"),
    )


def matched_count(gold: Column, found: Column) -> Column:
    """How many gold values are among those found; equal gold values count each."""
    return F.size(F.filter(gold, lambda x: F.array_contains(found, x)))


def subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def missing_features(required: Column, provided: Column) -> Column:
    """The required features that no provided one contains."""
    return F.filter(required, lambda r: ~F.exists(provided, lambda p: F.contains(p, r)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def external_confidence(score: Column, runner_up: Column, floor: float, ceil: float, full_margin: float) -> Column:
    """The lesser of how good the best score is and how far the next one is behind, 4 places; null without a score."""
    good = clamp01((score - floor) / (ceil - floor)) if ceil > floor else (score >= ceil).cast("double")
    apart = clamp01((score - runner_up) / full_margin) if full_margin > 0 else (score >= runner_up).cast("double")
    return F.when(score.isNotNull(), F.round(F.least(good, F.coalesce(apart, F.lit(1.0))), 4))


def calibrated(own: Column, score: Column, runner_up: Column, floor: float, ceil: float, full_margin: float) -> Column:
    """A stated confidence, not above the external one where that exists."""
    outer = external_confidence(score, runner_up, floor, ceil, full_margin)
    return F.when(outer.isNull(), own).otherwise(F.round(F.least(own, outer), 4))


def ratio(part: Column, whole: Column, places: int | None = None) -> Column:
    """Null over zero."""
    out = part / F.nullif(whole.cast("double"), F.lit(0.0))
    return out if places is None else F.round(out, places)


# ---- money


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def cents(x: Column) -> Column:
    """Two places, half up (as DuckDB and decimal SQL; binary half-even rounding of floats differs at exact half cents)."""
    return F.round(x, 2)


def amount(consumption: Column, price: Column, factor: Column) -> Column:
    """consumption * price * factor, two places half even on decimals; null without a price."""
    product = consumption.cast("decimal(18,6)") * price.cast("decimal(18,6)")
    return F.bround(product.cast("decimal(28,8)") * F.coalesce(factor, F.lit(1)).cast("decimal(9,4)"), 2)


# ---- dates


def month_start(year_month: Column) -> Column:
    return F.to_date(F.concat(year_month, F.lit("-01")))


def month_period(year_month: Column) -> Column:
    """The half-open period of a month."""
    start = month_start(year_month)
    return F.struct(start.alias("start"), F.add_months(start, 1).alias("end"))


def in_period(day: Column, start: Column, end: Column) -> Column:
    """Half open; a null bound is open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day < end))


def title_month(title: Column) -> Column:
    """``2024年3月`` or ``2024-03`` in a title as 2024-03."""
    year, month = (F.regexp_extract(title, r"(\d{4})\s*[年./-]\s*(\d{1,2})", i) for i in (1, 2))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0")))


def utc_iso(ts: Column) -> Column:
    """A time without zone is taken as UTC."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# ---- JSON

KEY = re.compile(r"^[A-Za-z0-9_-]+$")


def json_equals(doc: Column, key: str, value: None | bool | int | float | str) -> Column:
    """Typed equality of one key of a JSON string.

    JSON null is not a missing key, true is not 1, an int only equals integers, a float any number, a string only
    strings. Keys are of letters, digits, _ and -; ints are 64-bit. Never null.
    """
    if not isinstance(key, str) or not KEY.match(key):
        raise ValueError(f"key must match {KEY.pattern}: {key!r}")
    if not isinstance(value, bool | int | float | str | None):
        raise TypeError(f"no filter on {type(value).__name__}")
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        raise TypeError(f"not a 64-bit integer: {value}")
    field = F.try_variant_get(F.try_parse_json(doc), f"$['{key}']", "variant")
    kind = F.schema_of_variant(field)
    if value is None:
        hit = F.is_variant_null(field)
    elif isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(field, "$", "boolean") == value)
    elif isinstance(value, int):
        hit = (kind == "BIGINT") & (F.try_variant_get(field, "$", "bigint") == value)
    elif isinstance(value, float):
        hit = kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$") & (F.try_variant_get(field, "$", "double") == value)
    else:
        hit = (kind == "STRING") & (F.try_variant_get(field, "$", "string") == value)
    return F.coalesce(hit, F.lit(False))


def first_key(doc: Column, *keys: str, kind: str = "double") -> Column:
    """The first of several keys of a JSON string that casts."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{k}").try_cast(kind) for k in keys])
