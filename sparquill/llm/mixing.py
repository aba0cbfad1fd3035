"""Operator 2, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are summed per source; targets share the whole size by weight, none above ``most`` times its source
   (the excess is shared again by weight among the others until none is above).
2. A source is dealt by hash into blocks of about ``block_size``. Its target is whole passes over all blocks and a
   part of a pass. That part is shared by size class (sizes of as many binary digits), each by its share of the
   source: of a class, the blocks in order (which is random, since documents are dealt by hash) up to its aim. What
   lies within a few of the source's longest texts of the aims is settled document by document, the longest
   class first, and what a class misses passes to the shorter ones (``settle``). So long texts cost no more than a
   rounding that shorter documents make good; a source misses its target by less than a document that
   outweighs all documents of the shorter classes together.
3. Every taken (pass, block) is one unit of its source's quota. The tree starts with all quotas at the root and
   all output shards; each node draws the left child's share of every source from a multivariate hypergeometric
   distribution, exactly as many units as the left shards hold, and passes the rest to the right, down to single
   shards: shards are equal in units, and the quotas add up exactly.
4. A source's units, permuted by hash, are cut by the shards' quotas into disjoint runs, so each unit is drawn by
   one shard. Within a shard, documents are shuffled by a hash of (seed, document, pass).

Sources, targets, quotas, units and documents stay in Spark, whatever their number: the driver holds a few sums a
round of resharing. Running sums over a source's blocks and shards go by chunks, so a hot source is not one task. The
tree's upper part is drawn in one group (one number a source), the subtrees under its ``SPAN`` nodes in a group each.
Blocks grow with the corpus beyond ``MAX_UNITS`` of them, so that every draw is from numpy's exact sampler.

Edge cases: a null source is a source of its own, weighted last; empty and null texts have size 0 and are never
taken; very long texts are settled one by one; a table without words gives every row taken 0; repeated rows are rows
of their own; a null id is kept; columns of any name do no harm; reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.llm.common import KEY, WORD, keyed, materialize

BLOCK_SIZE, CHUNK, UNITS_A_SHARD, SPAN, MAX_UNITS = 20_000, 512, 64, 256, 250_000_000
#: So many rows of sources are broadcast at most; a longer table is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def split_tree(quotas: np.ndarray, lo: int, hi: int, ends: Callable[[int], int], seed: int, leaf: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(lo, hi, units of each source) of the nodes of at most ``leaf`` shards under the node of the shards lo .. hi - 1.

    Shard s ends at unit ``ends(s)`` of all; a node's left child gets exactly the units of its shards, drawn from the
    multivariate hypergeometric distribution of the node's quotas.
    """
    out, todo = [], [(lo, hi, quotas.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo <= leaf:
            out.append((lo, hi, have))
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, ends(mid) - ends(lo), method="marginals")
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def shard_quotas(quotas: DataFrame, units: int, shards: int, seed: int) -> DataFrame:
    """(shard, nth, n): how many of the units of each source in ``quotas(nth, units)`` each shard draws; zeros are left out."""
    ends = lambda s: units * s // shards
    leaf = -(-shards // SPAN)

    def nodes(group: pd.DataFrame, lo: int, hi: int, leaf: int) -> pd.DataFrame:
        group = group.sort_values("nth", ignore_index=True)
        nth = group["nth"].to_numpy()
        made = [(a, b, nth[n > 0], n[n > 0]) for a, b, n in split_tree(group["units"].to_numpy(), lo, hi, ends, seed, leaf)]
        size = [len(m[2]) for m in made]
        return pd.DataFrame({"lo": np.repeat([m[0] for m in made], size), "hi": np.repeat([m[1] for m in made], size), "nth": np.concatenate([m[2] for m in made]), "units": np.concatenate([m[3] for m in made])})

    kind = "lo long, hi long, nth long, units long"
    upper = quotas.groupBy(F.lit(0).alias("all")).applyInPandas(lambda g: nodes(g, 0, shards, leaf), kind)
    lower = upper.groupBy("lo", "hi").applyInPandas(lambda g: nodes(g, int(g["lo"].iat[0]), int(g["hi"].iat[0]), 1), kind)
    return lower.select(F.col("lo").alias("shard"), "nth", F.col("units").alias("n"))


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """Of a source's documents near the aims (class, total of the class, rest, start of the cell, block, order, size), those taken.

    From the longest class down: a random order's prefix up to the class's share of what is left, rounded up or down
    by chance where the shorter classes can make up for both; else the one addition, exchange or removal after which
    what is left comes nearest to what they can hold. Rounding errors halve with each class, so all of the cells that
    can matter lie within three of the longest texts of the aims.
    """
    group = group.sort_values(["class", "block", "order", KEY], ascending=[False, True, True, True], ignore_index=True)
    left, below = float(group["rest"].iat[0]), float(group.groupby("class")["total"].first().sum())
    taken = np.zeros(len(group), bool)
    for _, part in group.groupby("class", sort=False):
        at, size, total = part.index.to_numpy(), part["size"].to_numpy(), int(part["total"].iat[0])
        base = int(part["start"].iat[0])
        aim = max(0.0, left * total / below)
        below -= total
        ends = base + np.cumsum(size)
        k = int(np.searchsorted(ends, aim, side="right"))
        have = int(ends[k - 1]) if k else base
        low, high = left - have - below, left - have  # what may still be added
        mine = np.arange(len(at)) < k
        up = k < len(at) and size[k] <= high
        if up and (low > 0 or (aim - have) * 2**20 > (int(part["order"].iat[k]) & (2**20 - 1)) * int(size[k])):
            mine[k] = True
        elif low > 0 or high < 0:
            add, drop = (np.concatenate([[0], np.unique(size[m])]) for m in (~mine, mine))
            spot = np.searchsorted(drop, add - high)  # the least removal that does not go beyond ``high``, and the one before
            pairs = [np.minimum(spot, len(drop) - 1), np.maximum(spot - 1, 0)]
            change = np.concatenate([add - drop[p] for p in pairs])
            best = int(np.argmin(np.maximum(np.maximum(low - change, change - high), 0)))
            more, less = add[best % len(add)], drop[pairs[best // len(add)][best % len(add)]]
            if more != less:
                if more:
                    mine[np.flatnonzero(~mine & (size == more))[0]] = True
                if less:
                    mine[np.flatnonzero((np.arange(len(at)) < k) & (size == less))[-1]] = False
        taken[at] = mine
        left -= base + int(size[mine].sum())
    return group.loc[taken, ["nth", "block", KEY]]


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``sources(source, source_size, longest)`` with ``nth`` (in code-point order, null last), ``target`` (a share of
    the whole size by weight, none above ``most`` times its own size), whole ``passes`` and the ``rest`` of a target."""
    order = sources.orderBy(F.col("source").isNull(), "source")
    order = materialize(order.withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = order.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select("part", before.alias("base"))  # one row a partition
    ranked = order.join(parts, F.shiftright("at", 33) == F.col("part"))
    ranked = ranked.withColumn("nth", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "base")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    # the level of the uncapped: what is left of the whole, over their weights; it only rises, and ends where no more source is capped
    big = lambda c: F.col(c).cast("decimal(38,0)")
    left, share, capped = None, None, -1
    while True:
        over = F.lit(False) if left is None else (big("weight") * F.lit(left) > big("source_size") * F.lit(most * share))
        r = ranked.where("source_size > 0").select("source_size", "weight", over.alias("over")).agg(
            F.sum("source_size"), F.sum(F.when(F.col("over"), F.col("source_size"))), F.sum(F.when(~F.col("over"), F.col("weight"))), F.count(F.when(F.col("over"), True))
        ).first()
        if r[3] == capped:
            break
        left, share, capped = (r[0] or 0) - most * (r[1] or 0), r[2] or 1, r[3]
        if not r[2]:  # all are capped
            break
    over = big("weight") * F.lit(left) > big("source_size") * F.lit(most * share)
    free = F.col("weight") * F.lit(float(left)) / F.lit(float(share))
    whole = (big("weight") * F.lit(left) / (big("source_size") * F.lit(share))).cast("long")
    some = F.col("source_size") > 0
    out = ranked.withColumn("target", F.when(~some, 0.0).when(over, F.col("source_size") * float(most)).otherwise(free))
    out = out.withColumn("passes", F.when(~some, 0).when(over, most).otherwise(whole).cast("int"))
    return materialize(out.withColumn("rest", F.when(some & ~over, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)), "targets")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(seed: int, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 11,
    block_size: int = BLOCK_SIZE,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``_row_key`` (from the column ``key`` of unique longs, if there is one), id, size, source_size, target, and
    ``draws``, an array of (pass, shard, place) with one entry for each time that the mix takes the document.

    ``weights`` repeat over the sources in code-point order, null last.
    """
    if key is None:
        docs, key = keyed(docs.select(*{id_col, text_col, source_col}), id_col)
    sized = materialize(
        docs.select(F.col(key).alias(KEY), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size")), "sized"
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest")), weights, most)
    n_sources, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    block_size = max(block_size, -(-(total or 0) // MAX_UNITS))
    plan = sources.select(F.col("source").alias("of"), "nth", "source_size", "longest", "target", "passes", "rest", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_size)).alias("blocks"))
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    dealt = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).drop("of")
    dealt = dealt.withColumn("block", F.pmod(_hash(seed, KEY), F.col("blocks"))).withColumn("class", F.length(F.bin("size")))

    # running size of a class's blocks in block order, which is a random order: documents are dealt by hash
    cell = materialize(
        dealt.where("size > 0")
        .groupBy("nth", "class", "block", F.floor(F.col("block") / CHUNK).alias("chunk"))
        .agg(F.sum("size").alias("held"), *[F.first(c).alias(c) for c in ("passes", "rest", "source_size", "longest")]),
        "cells",
    )
    zero = F.lit(0).cast("long")
    earlier = (Window.unboundedPreceding, -1)

    def before(*keys: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(*earlier)), zero).alias("base")

    in_chunk = Window.partitionBy("nth", "class", "chunk").orderBy("block").rowsBetween(*earlier)
    chunks = cell.groupBy("nth", "class", "chunk").agg(F.sum("held").alias("n"))
    chunks = chunks.select("nth", "class", "chunk", before("nth", "class"), F.sum("n").over(Window.partitionBy("nth", "class")).alias("total"))
    cell = cell.join(chunks, ["nth", "class", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("held").over(in_chunk), zero))
    aim, near = F.col("rest") * F.col("total") / F.col("source_size"), 3 * F.col("longest")
    state = F.when(F.col("start") + F.col("held") <= aim - near, 1).when(F.col("start") < aim + near, 2)
    cell = cell.withColumn("state", F.when(F.col("rest") > 0, state))
    cell = materialize(cell.select("nth", "class", "block", "passes", "total", "start", "state"), "states")

    edge = dealt.join(cell.where("state = 2").select("nth", "class", "block", "total", "start"), ["nth", "class", "block"])
    edge = edge.select("nth", "class", "block", KEY, "size", "total", "start", "rest", _hash(seed + 2, KEY).alias("order"))
    filled = materialize(edge.groupBy("nth").applyInPandas(settle, f"nth long, block long, {KEY} long"), "filled")

    # the classes of a block that the extra pass takes whole; it is one unit more if it takes any document
    block = cell.groupBy("nth", "block").agg(F.first("passes").alias("passes"), F.collect_list(F.when(F.col("state") == 1, F.col("class"))).alias("whole"))
    block = block.join(filled.select("nth", "block").distinct().withColumn("some", F.lit(True)), ["nth", "block"], "left")
    extra = (F.size("whole") > 0) | F.coalesce("some", F.lit(False))
    block = materialize(block.select("nth", "block", "whole", (F.col("passes") + extra.cast("int")).alias("units")), "units")

    quotas = materialize(block.groupBy("nth").agg(F.sum("units").cast("long").alias("units")).where("units > 0"), "quotas")
    all_units = quotas.agg(F.sum("units")).first()[0] or 0
    shards = max(1, min(shards or -(-all_units // UNITS_A_SHARD), all_units))
    cuts = materialize(shard_quotas(quotas, all_units, shards, seed).withColumn("chunk", F.floor(F.col("shard") / CHUNK)), "cuts")
    bases = cuts.groupBy("nth", "chunk").agg(F.sum("n").alias("n")).select("nth", "chunk", before("nth"))
    earlier_cuts = Window.partitionBy("nth", "chunk").orderBy("shard").rowsBetween(*earlier)
    first = F.col("base") + F.coalesce(F.sum("n").over(earlier_cuts), zero)
    places = cuts.join(bases, ["nth", "chunk"]).select("nth", "shard", "n", first.alias("first"))
    places = places.select("nth", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))

    # a unit's rank among its source's units, in hashed order, says which shard draws it
    units = block.where("units > 0").select("nth", "block", F.explode(F.sequence(F.lit(0), F.col("units").cast("int") - 1)).alias("pass"))
    units = units.withColumn("mark", _hash(seed + 1, "nth", "block", "pass"))
    units = units.withColumn("chunk", F.shiftright("mark", 50))  # its leading bits: chunks are in the order of marks
    bases = units.groupBy("nth", "chunk").agg(F.count("*").alias("n")).select("nth", "chunk", before("nth"))
    in_order = Window.partitionBy("nth", "chunk").orderBy("mark", "block", "pass")
    units = units.join(bases, ["nth", "chunk"]).select("nth", "block", "pass", (F.col("base") + F.row_number().over(in_order) - 1).alias("rank"))

    drawn = units.join(places, ["nth", "rank"])
    drawn = drawn.groupBy("nth", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))  # at most ``most`` entries
    drawn = materialize(block.join(drawn, ["nth", "block"], "left").select("nth", "block", "whole", "drawn"), "drawn")

    placed = dealt.join(drawn, ["nth", "block"], "left").join(filled.select(KEY, F.lit(True).alias("filled")), KEY, "left")
    more = F.coalesce(F.array_contains("whole", F.col("class")), F.lit(False)) | F.coalesce("filled", F.lit(False))
    draws = F.filter(
        F.coalesce("drawn", F.array().cast("array<struct<pass:int,shard:long>>")),
        lambda d: (F.col("size") > 0) & ((d["pass"] < F.col("passes")) | more),
    )
    return placed.select(
        KEY,
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.transform(draws, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), _hash(seed + 3, KEY, d["pass"]).alias("place"))).alias("draws"),
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as drawn, by shard and shuffled within each shard."""
    rows, key = keyed(docs)
    spots = mix(rows, key=key, **how).select(F.col(KEY).alias("k"), F.explode("draws").alias("d"))
    spots = spots.select("k", F.struct("d.shard", "d.place", "k").alias("spot"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    drawn = rows.select(F.struct(*own).alias("row"), F.col(key).alias("k")).join(spots, "k").select("row", "spot")
    return drawn.repartition("spot.shard").sortWithinPartitions("spot").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
