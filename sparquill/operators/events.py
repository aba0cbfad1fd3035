"""Event logs: sequences, replay, usage roll-ups, feedback, loop windows, overlays, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.operators.relational import best_by, first_per


def with_sequence(new: DataFrame, old: DataFrame | None, thread: str, order: list[str], seq: str = "seq") -> DataFrame:
    """``new`` rows numbered per thread on from the greatest number in ``old``, from 1 where there is none."""
    n = F.row_number().over(Window.partitionBy(thread).orderBy(*order)).cast("long")
    if old is None:
        return new.withColumn(seq, n)
    last = old.groupBy(thread).agg(F.max(seq).alias("_last"))
    return new.join(last, thread, "left").withColumn(seq, n + F.coalesce("_last", F.lit(0))).drop("_last")


def retained(log: DataFrame, keys: list[str], offset: str, most: int = 256) -> DataFrame:
    """A bounded log: the last ``most`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(offset)))
    return log.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def resumed(log: DataFrame, id_col: str, offset: str, last_id) -> DataFrame:
    """Rows after the one with ``last_id``; an unknown id starts from the earliest retained."""
    at = log.agg(F.max(F.when(F.col(id_col) == F.lit(last_id), F.col(offset))).alias("_at"))
    return log.join(F.broadcast(at)).where(F.col("_at").isNull() | (F.col(offset) > F.col("_at"))).drop("_at")  # one row is broadcast


def usage(runs: DataFrame, model: Column, measures: list[str], statuses: list[str] | None = None, status: str = "status") -> DataFrame:
    """Sums and runs by model, then the grand total (``model`` null); an empty or null model is ``unknown``."""
    rows = runs if statuses is None else runs.where(F.col(status).isin(*statuses))
    named = rows.withColumn("model", F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")))
    return named.rollup("model").agg(F.count("*").alias("runs"), *[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures])


def priced(usage_rows: DataFrame, prices: DataFrame, default_in: float, default_out: float) -> DataFrame:
    """Cost by model: (in * price_in + out * price_out) / 1000, default prices where a model has none."""
    joined = usage_rows.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(default_in)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(default_out))) / 1000
    return joined.groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost"))


def external_usage(records: DataFrame, source: str, order: str) -> DataFrame:
    """First record of each call; blank ids and totals that are not positive go; a missing total is in + out."""
    total = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("total")).otherwise(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))
    good = records.where(F.trim(F.coalesce(F.col(source), F.lit(""))) != "").withColumn("total", total).where("total > 0")
    return first_per(good, [source], order)


def feedback_counts(feedback: DataFrame, keys: list[str]) -> DataFrame:
    return feedback.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))


def latest_per(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key, by a partial aggregate."""
    return best_by(rows, keys, -F.unix_micros(F.col(at).cast("timestamp")), -F.col(tie))


def overlay(stored: DataFrame, live: DataFrame, id_col: str, newest: str, limit: int | None = None) -> DataFrame:
    """Live rows over stored ones of the same id, newest first."""
    both = live.withColumn("_s", F.lit(0)).unionByName(stored.withColumn("_s", F.lit(1)))
    out = first_per(both, [id_col], "_s", F.desc(newest)).drop("_s").orderBy(F.desc(newest), id_col)
    return out if limit is None else out.limit(limit)


def within_budget(facts: DataFrame, keys: list[str], budget: int, cost: str, *order: Column | str) -> DataFrame:
    """Rows in order as long as their running cost fits; nothing after the first that does not."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return facts.withColumn("running_cost", F.sum(cost).over(w)).where(F.col("running_cost") <= budget)


def loop_flags(events: DataFrame, thread: str, order: str, what: str, window: int = 20, warn: int = 3, stop: int = 5) -> DataFrame:
    """Each event with the count of its like among the thread's last ``window`` events, and ``flag``: warn, stop or null."""
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(-(window - 1), Window.currentRow)
    same = F.size(F.filter(F.collect_list(what).over(w), lambda x: x == F.col(what)))
    return events.withColumn("recent", same).withColumn("flag", F.when(F.col("recent") >= stop, "stop").when(F.col("recent") >= warn, "warn"))


def frequency_flags(events: DataFrame, thread: str, order: str, what: str, limits: DataFrame | None = None, warn: int = 30, stop: int = 50) -> DataFrame:
    """Running count per thread and kind; ``limits`` (kind, warn, stop) override the defaults."""
    n = F.count("*").over(Window.partitionBy(thread, what).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("count", n)
    if limits is not None:
        rows = rows.join(limits.select(F.col("kind").alias(what), F.col("warn").alias("_w"), F.col("stop").alias("_s")), what, "left")
        hit = F.when(F.col("count") >= F.coalesce("_s", F.lit(stop)), "stop").when(F.col("count") >= F.coalesce("_w", F.lit(warn)), "warn")
        return rows.withColumn("flag", hit).drop("_w", "_s")
    return rows.withColumn("flag", F.when(F.col("count") >= stop, "stop").when(F.col("count") >= warn, "warn"))


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """Bursts of a key: events less than a gap apart; start, end, count, and the last payload id (debounce)."""
    order = Window.partitionBy(key).orderBy(at, tie)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    far = F.coalesce(seconds - F.lag(seconds).over(order) >= gap_seconds, F.lit(True))
    rows = events.withColumn("_new", far.cast("int")).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.max_by(tie, F.struct(at, tie)).alias("last_id"))


def pending(expected: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """What is left to do; results that are repeated or foreign raise an error."""
    twice = done.groupBy(id_col).count().where("count > 1").limit(1).count()
    foreign = done.join(expected, id_col, "left_anti").limit(1).count()
    if twice or foreign:
        raise ValueError("results are repeated" if twice else "results of unknown rows")
    return expected.join(done.select(id_col), id_col, "left_anti")


def first_of_kind(rows: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each kind; a kind with fewer raises an error."""
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("_n") <= n).drop("_n")
    short = out.groupBy(kind).count().where(F.col("count") < n).limit(1).collect()
    if short:
        raise ValueError(f"{short[0][0]} has fewer than {n} rows")
    return out


def pending_before(runs: DataFrame, before, status: str = "status", at: str = "created_at") -> DataFrame:
    """Pending rows up to a time (the present where it is null), oldest first."""
    limit = F.current_timestamp() if before is None else F.lit(before)
    return runs.where((F.col(status) == "pending") & (F.col(at) <= limit.cast(dict(runs.dtypes)[at]))).orderBy(at)


def packed_content(content: Column, metadata: Column) -> Column:
    """(content, metadata): structured content (a variant) as JSON text, marked in the metadata; a string stays as it is.

    ``metadata`` is a map of strings. ``restored_content`` gives the same variant back.
    """
    kind = F.schema_of_variant(content)
    text, whole = kind == "STRING", kind.startswith("OBJECT")
    marks = F.when(text, F.create_map().cast("map<string,string>")).when(whole, F.create_map(F.lit("content_is_json"), F.lit("true"), F.lit("content_is_dict"), F.lit("true"))).otherwise(F.create_map(F.lit("content_is_json"), F.lit("true")))
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("content_is_json", "content_is_dict"))
    return F.struct(F.when(text, F.try_variant_get(content, "$", "string")).otherwise(F.to_json(content)).alias("content"), F.map_concat(own, marks).alias("metadata"))


def restored_content(content: Column, metadata: Column) -> Column:
    """The variant that ``packed_content`` packed; text that is marked as JSON but doesn't parse stays text."""
    text = F.parse_json(F.to_json(F.struct(content.alias("t"))))
    plain = F.try_variant_get(text, "$.t", "variant")
    return F.when(F.coalesce(F.element_at(metadata, "content_is_json") == "true", F.lit(False)), F.coalesce(F.try_parse_json(content), plain)).otherwise(plain)


def new_facts(facts: DataFrame, known: DataFrame, content: str, order: str) -> DataFrame:
    """Facts whose content is not known yet, each once (the first in ``order``); case and white space don't count."""
    key = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    fresh = first_per(facts.withColumn("_key", key), ["_key"], order)
    return fresh.join(known.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")
