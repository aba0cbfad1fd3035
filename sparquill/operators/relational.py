"""Relational operators over any DataFrames: filters, ranked and as-of joins, keyed updates, paging, sampling, ordered fills."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

#: Sides under this many bytes (by the optimizer's statistics) may be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, with a broadcast hint only if the optimizer's estimate of its size is within ``most`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def in_parts(df: DataFrame, *keys: str, each: int = 4 << 20, by: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many tasks as the optimizer's estimate of its (or of ``by``'s) size has ``each`` bytes, so that a task's share does not grow."""
    size = int(str((by or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(size // each, 20_000)), *keys)


# ---- filters


def where_given(df: DataFrame, **filters) -> DataFrame:
    """Conjunction of the filters that are given: a value is equality, a list membership, a Column itself, None nothing."""
    for name, value in filters.items():
        if value is None:
            continue
        if isinstance(value, Column):
            df = df.where(value)
        elif isinstance(value, list | tuple | set):
            df = df.where(F.col(name).isin(*value))
        else:
            df = df.where(F.col(name) == value)
    return df


def has_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False))


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive LIKE of any pattern; a null value counts as empty."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit("")).ilike(p) for p in patterns], F.lit(False))


def clamped(limit: int | None, default: int = 20, most: int = 100) -> int:
    return max(1, min(limit or default, most))


def owned(df: DataFrame, user: str | None, bypass: bool = False, col: str = "user_id") -> DataFrame:
    """Row-level scope: rows of one user, unless bypassed."""
    if bypass:
        return df
    if user is None:
        raise ValueError("a user is needed unless the scope is bypassed")
    return df.where(F.col(col) == user)


# ---- first of a group


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order`` (which should end in a unique column)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key by a partial aggregate (least ``order`` struct): no sort, and hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def numbered_clashes(df: DataFrame, id_col: str, order: str, out: str = "new_id") -> DataFrame:
    """Later rows of an id get ``_2``, ``_3``, ..."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(id_col).cast("string")).otherwise(F.concat_ws("_", id_col, "_n"))).drop("_n")


# ---- joins


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its keys at or before (``strict``: before) its time; one shuffle, no pairs.

    Both sides are stacked and a running ``last`` carries the right row down. Left rows without one keep nulls.
    Of right rows of equal time, the one with the greatest other columns counts.
    """
    rest = [c for c in right.columns if c not in keys]
    a = left.select(*keys, F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"), F.col(left_time).alias("_t"), F.lit(0 if strict else 2).alias("_o"))
    b = right.select(*keys, F.lit(None).alias("_l"), F.struct(*rest).alias("_r"), F.col(right_time).alias("_t"), F.lit(1).alias("_o"))
    order = Window.partitionBy(*keys).orderBy("_t", "_o", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where(F.col("_l").isNotNull())
    return both.select("_l.*", *[F.col(f"_m.{c}").alias(c if c not in left.columns else f"right_{c}") for c in rest])


#: Cells that the longest spans are cut into, and how many powers of two a level is above the one below.
TOP_CELLS, LEVEL_STEP = 64, 2


def _axis(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> tuple[Callable[[str], Column], int, Column] | None:
    """Of the points' axis: a column's tick (a whole number from 0 on that keeps the order, outer values at its ends), the
    number of ticks, and which spans may hold a point at all; None without points."""
    kinds = [points.schema[at].dataType, spans.schema[start].dataType, spans.schema[end].dataType]
    if any(isinstance(k, TimestampType | TimestampNTZType) for k in kinds):
        value = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    elif isinstance(kinds[0], DateType):
        value = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    elif any(isinstance(k, FractionalType) for k in kinds):
        value = lambda c: F.col(c).cast("double")
    else:
        value = lambda c: F.col(c).cast("long")
    finite = F.when(F.abs(value(at).cast("double")) < 1e300, value(at))
    e = points.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    if e["first"] is None:
        return None
    lo, hi = e["lo"] or 0, e["hi"] or 0
    inside = (F.col(start).isNull() | (F.col(start) <= F.lit(e["last"]))) & (F.col(end).isNull() | (F.col(end) > F.lit(e["first"])))
    clamped = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(value(c), F.lit(hi)), F.lit(lo)))
    if isinstance(lo, int) and hi - lo < 1 << 61:
        return lambda c: clamped(c) - lo, hi - lo + 1, inside
    factor = 2.0 ** (40 - math.frexp(max(hi - lo, 1e-300))[1])
    return lambda c: F.floor((clamped(c).cast("double") - float(lo)) * factor).cast("long"), (1 << 40) + 1, inside


def cell_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """(points' columns, spans' columns but the keys): points with the spans [start, end) of equal ``keys`` that hold them.

    Cells are powers of two of the axis. A span lies in the one or two cells of the least level that is as wide as the span,
    a point in one cell of every level that spans use, and both meet by an equi-join on keys, level and cell, so that no
    width has to be chosen and a short span never meets points far away. The axis ends at the outermost points: there open
    (null) ends are cut off. The widest level has cells of a ``TOP_CELLS``th of the axis, and longer spans lie in up to so
    many of them; so the rows of a hot key, even under spans that hold them all, are dealt out over as many groups.
    Null points and keys match nothing, nor do empty spans. Points and spans are dates, timestamps or numbers.
    """
    axis = _axis(points, spans, at, start, end)
    if axis is None:
        both = points.select(*[points[c] for c in points.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema if f.name not in keys])
        return both.where(F.lit(False))
    tick, width, inside = axis
    top = -(-max(0, width // TOP_CELLS).bit_length() // LEVEL_STEP) * LEVEL_STEP
    cut = spans.where(inside).withColumns({"_a": F.coalesce(tick(start), F.lit(0)).cast("long"), "_b": F.coalesce(tick(end), F.lit(width - 1)).cast("long")}).where("_a <= _b")
    level = F.least(F.ceil(F.log2(F.col("_b") - F.col("_a") + 1) / LEVEL_STEP) * LEVEL_STEP, F.lit(top)).cast("int")
    cut = cut.withColumn("_level", level)
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 32 at most
    cell = lambda c: F.expr(f"shiftright({c}, _level)")
    posted = cut.withColumn("_cell", F.explode(F.sequence(cell("_a"), cell("_b")))).drop("_a", "_b")
    probes = points.where(F.col(at).isNotNull()).withColumn("_p", tick(at)).withColumn("_level", F.explode(F.lit(levels).cast("array<int>")))
    probes = probes.withColumn("_cell", cell("_p")).drop("_p")
    after = F.col(start).isNull() | (F.col(start) <= F.col(at))
    return probes.join(posted, [*keys, "_level", "_cell"]).where(after & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_level", "_cell")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the spans [start, end) of the same keys that hold them; a null start or end is open. See ``cell_join``."""
    return cell_join(points, spans, keys, at, start, end)


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points and spans [start, end) of one line, with no other key. See ``cell_join``."""
    return cell_join(points, spans, [], at, start, end)


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """The number of ``cuts`` below a value: buckets in the order of the values, of like sizes if the cuts are quantiles."""
    return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < value))


def range_counts(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points that lie in spans [start, end), numbers or null for open, with ``spans``: in how many; no pairs are made.

    A span adds one at its start and takes one off at its end. The running sum over all values is made in buckets of
    them, from the sum of the buckets before.
    """
    x = lambda c: F.col(c).cast("double")
    lo, hi = F.coalesce(x(start), F.lit(float("-inf"))), x(end)
    given = points.where(F.col(at).isNotNull()).withColumn("_v", x(at))
    ends = spans.where(hi.isNull() | (lo < hi)).select(F.inline(F.array(F.struct(lo.alias("_v"), F.lit(1).alias("_d")), F.struct(hi.alias("_v"), F.lit(-1).alias("_d"))))).where("_v IS NOT NULL")
    steps = ends.unionByName(given.select("_v", F.lit(0).alias("_d"))).groupBy("_v").agg(F.sum("_d").alias("_d"))
    cuts = ends.agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    steps = steps.withColumn("_b", bucket_of(F.col("_v"), sorted({c for c in cuts if c == c})))
    before, total = [], 0
    sums = dict(steps.groupBy("_b").agg(F.sum("_d")).collect())  # 64 rows at most
    for b in range(len(cuts) + 1):
        before.append(total)
        total += sums.get(b, 0)
    running = F.sum("_d").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = steps.withColumn("spans", running + F.element_at(F.lit(before).cast("array<long>"), F.col("_b") + 1)).where("spans > 0").select("_v", "spans")
    return given.join(counted, "_v").select(*points.columns, "spans")


def either_key_join(left: DataFrame, right: DataFrame, direct: str, mapped: str, right_key: str, *order: Column | str, ids: list[str]) -> DataFrame:
    """The best right row by the direct key or else by the mapped one: two equi-joins with a preference, no OR.

    Left rows (identified by ``ids``) that find nothing keep nulls. ``via`` says how a row was found.
    """
    one = left.join(right, left[direct] == right[right_key]).withColumn("via", F.lit("direct"))
    two = left.where(F.col(mapped).isNotNull() & ~F.col(mapped).eqNullSafe(F.col(direct))).join(right, F.col(mapped) == right[right_key]).withColumn("via", F.lit("mapped"))
    found = first_per(one.unionByName(two), ids, F.when(F.col("via") == "direct", 0).otherwise(1), *order)
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(found.select(*ids, *extra, "via"), ids, "left")


def pairs_within(df: DataFrame, keys: list[str], id_col: str, carry: list[str] | None = None) -> DataFrame:
    """Unordered pairs of a group, which must be small by nature (rows of one section, lines of one order)."""
    dealt = in_parts(df.select(*dict.fromkeys([*keys, id_col, *(carry or [])])), *keys)
    a = dealt.select(*keys, *[F.col(c).alias(f"{c}_a") for c in [id_col, *(carry or [])]])
    b = dealt.select(*keys, *[F.col(c).alias(f"{c}_b") for c in [id_col, *(carry or [])]])
    return a.join(b, keys).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))


def same_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids that only one side has, with the side that lacks them: empty if the two agree."""
    left, right = a.select(id_col).distinct(), b.select(id_col).distinct()
    return left.join(right, id_col, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(right.join(left, id_col, "left_anti").withColumn("missing_in", F.lit("left")))


# ---- keyed updates


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *newest: Column | str) -> DataFrame:
    """Rows of ``new`` replace those of equal keys; null keys equal null. Of several new rows the first in ``newest`` counts."""
    both = old.withColumn("_s", F.lit(1)).unionByName(new.withColumn("_s", F.lit(0)))
    return first_per(both, keys, "_s", *newest).drop("_s")  # grouping takes nulls as equal


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of ``new`` whose keys are not there yet; null keys equal null."""
    n = new.dropDuplicates(keys).alias("n")
    o = old.select(*keys).alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return old.unionByName(n.join(o, same, "left_anti"))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete then insert: all rows of the keys that ``new`` has give way to it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Delete: rows where the condition is true go; unknown stays."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def overlaps(df: DataFrame, keys: list[str], start: str, end: str, *tie: str) -> DataFrame:
    """Rows whose half-open period overlaps an earlier one of the same keys: empty if the constraint holds.

    A null end is open. Of equal periods the first by ``tie`` counts as the earlier one. Ends keep their type.
    """
    before = Window.partitionBy(*keys).orderBy(start, end, *tie).rowsBetween(Window.unboundedPreceding, -1)
    open_end, latest = F.max(F.col(end).isNull()).over(before), F.max(end).over(before)
    return df.withColumns({"_open": open_end, "_end": latest}).where(F.col("_open") | (F.col(start) < F.col("_end"))).drop("_open", "_end")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def split_by_reason(df: DataFrame, **reasons: Column) -> DataFrame:
    """``df`` with ``reject_reason``: the name of the first rule that holds, null for rows that stay."""
    return df.withColumn("reject_reason", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]) if reasons else F.lit(None).cast("string"))


# ---- paging


def page_after(df: DataFrame, key: str, after=None, limit: int = 20) -> DataFrame:
    """Keyset page forward: the next rows by ``key``, ascending."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def page_before(df: DataFrame, key: str, before=None, limit: int = 20) -> DataFrame:
    """Keyset page backward: the last rows before the cursor, returned ascending."""
    return (df if before is None else df.where(F.col(key) < before)).orderBy(F.desc(key)).limit(limit).orderBy(key)


def page_at(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


# ---- samples


def hash_order(id_col: str, seed: str) -> Column:
    """A shuffle order that other engines can repeat: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``n`` rows, the same for a seed whatever the partitioning: the first in ``hash_order``."""
    return df.orderBy(hash_order(id_col, str(seed)), id_col).limit(n)


def stratified_sample(df: DataFrame, stratum: str, quotas: dict[str, int], total: int, id_col: str, seed: str) -> DataFrame:
    """Up to a quota from each stratum in hashed order, topped up from the rest to ``total``."""
    order = hash_order(id_col, seed)
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum)), F.lit(0))
    ranked = df.withColumn("_h", order).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col)))
    ranked = ranked.withColumn("_top_up", F.col("_n") > quota)
    return ranked.orderBy("_top_up", "_h", id_col).limit(total).drop("_h", "_n", "_top_up")


def batches_of(df: DataFrame, keys: list[str], order: str, size: int, out: str = "batch") -> DataFrame:
    """Consecutive rows of a key in batches of ``size``, from 1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, (F.floor((n - 1) / size) + 1).cast("int"))


# ---- order within groups


def running(df: DataFrame, keys: list[str], order: str, **sums: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})


def filled_forward(df: DataFrame, keys: list[str], order: str, *cols: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, out: str = "island") -> DataFrame:
    """Runs of rows where ``flag`` holds, numbered from 1 per key, with their length; other rows have nulls."""
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.coalesce(flag, F.lit(False))
    starts = (hit & ~F.coalesce(F.lag(hit).over(w), F.lit(False))).cast("int")
    runs = df.withColumn("_hit", hit).withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumns({out: F.when(F.col("_hit"), F.col("_run")), f"{out}_size": F.when(F.col("_hit"), size)}).drop("_hit", "_start", "_run")


def until_blank_run(df: DataFrame, keys: list[str], order: str, blank: Column, most: int) -> DataFrame:
    """Rows before the first run of ``most`` blank rows; blank rows go."""
    marked = islands(df, keys, order, blank, "_blank")
    first = F.min(F.when(F.col("_blank_size") >= most, F.col(order))).over(Window.partitionBy(*keys))
    return marked.withColumn("_stop", first).where((F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))) & F.col("_blank").isNull()).drop("_stop", "_blank", "_blank_size")


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Difference and percent to the row before; no percent from nothing."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    out = df.withColumn("previous", before).withColumn("delta", F.round(F.col(value) - F.col("previous"), 2))
    return out.withColumn("pct", F.when(F.col("previous") != 0, F.round((F.col(value) - F.col("previous")) / F.col("previous") * 100, 2)))


def gaps(df: DataFrame, keys: list[str], number: str, most: int = 3) -> DataFrame:
    """Rows whose number is more than ``most`` after the one before."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(number))
    return df.withColumn("previous", before).where(F.col(number) - F.col("previous") > most)


def merged_first(df: DataFrame, keys: list[str], order: str, *cols: str) -> DataFrame:
    """One row per key: of each column the first value in order that is not null."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*firsts)
