"""Operator 10, exact dedup by deterministic block naming. DataFrame and SQL functions only.

A text, without its white space, is cut into blocks of ``block_chars`` characters. The distinct blocks of the
whole corpus are sorted into integer names, so that two blocks share a name only if they are the same string.
Then adjacent pairs of names are themselves sorted into names, level by level, until each document is left with
one integer: two documents have the same (depth, name) if and only if their texts are equal.

Block texts are shuffled once, after map-side combining: the distinct (digest, block) rows prove that a block's
SHA-256 stands for one block only, and from there on the 32-byte digest travels in its place. Should two blocks
ever share a digest, names are joined on the block texts themselves.

Skew: copies collapse in the partial aggregates, and names go back to rows by plain equi-joins, whose hot
partitions AQE can split. No group is gathered in one task.

Edge cases: null and blank texts are the same empty text; a null id sorts after any other in a tie; repeated rows
(same id, same text) form one group in which exactly one row is kept; a very long text is named whole, in as many
levels as it has binary digits of blocks; only the id and text columns are read, so further columns of any name do no
harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import KEY, SPACE, key_id_text, keyed, materialize

BLOCK_CHARS = 4096


def sha256(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _named(keys: DataFrame, label: str) -> DataFrame:
    """The distinct rows of ``keys``, in sorted order, each with a positive integer ``name``."""
    ordered = keys.distinct().orderBy(*keys.columns)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id() + 1), label)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    digest: Callable[[Column], Column] = sha256,
    key: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``_row_key``, id, keep_id, group_size, kept, text_sha256.

    ``key`` names a column of unique longs, if ``docs`` has one.
    """
    rows = key_id_text(docs, id_col, text_col, key)
    text = F.coalesce("text", F.lit(""))
    base = rows.select(
        KEY, "id", F.length(text).alias("n_points"), F.regexp_replace(text, f"{SPACE}+", "").alias("norm")
    )
    blocks = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), 0)
    marks = materialize(
        base.select(KEY, "id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(blocks, digest).alias("digests")),
        "marks",
    )
    pos = F.posexplode("digests").alias("pos", "digest")

    parts = base.select(F.explode(blocks).alias("block")).select(digest(F.col("block")).alias("digest"), "block").distinct()
    stands = parts.groupBy("digest").agg(F.count("*").alias("n_blocks_of"))
    names = materialize(
        stands.orderBy("digest").withColumn("name", F.monotonically_increasing_id() + 1), "block-names"
    )
    if names.where("n_blocks_of > 1").take(1):  # one digest, several blocks: the blocks themselves are the key
        texts = _named(parts.select("digest", "block"), "block-names")
        cells = base.select(KEY, F.size(blocks).alias("n"), F.posexplode(blocks).alias("pos", "block"))
        cells = cells.withColumn("digest", digest(F.col("block"))).join(texts, ["digest", "block"])
    else:
        cells = marks.select(KEY, F.size("digests").alias("n"), pos).join(names, "digest")
    cells = materialize(cells.select(KEY, "n", "pos", "name"), "level-0")

    named = [cells.where("n = 1").select(KEY, F.lit(0).alias("depth"), "name")]
    named.append(marks.where(F.size("digests") == 0).select(KEY, F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("name")))
    longest = cells.agg(F.max("n")).first()[0] or 0
    depth = 0
    while longest > 1 << depth:
        depth += 1
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        side = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(0).cast("long"))
        pairs = cells.where(F.col("n") > (1 << (depth - 1))).groupBy(KEY, "n", half).agg(side(0).alias("l"), side(1).alias("r"))
        names = _named(pairs.select("l", "r"), "pair-names")
        cells = materialize(pairs.join(names, ["l", "r"]).select(KEY, "n", "pos", "name"), f"level-{depth}")
        named.append(cells.where(F.col("n") <= (1 << depth)).select(KEY, F.lit(depth).alias("depth"), "name"))

    identity = named[0]
    for more in named[1:]:
        identity = identity.unionByName(more)
    members = materialize(
        marks.select(KEY, "id", "n_points", "text_sha256").join(identity, KEY), "members"
    )
    # bitwise-not turns "largest" into "smallest" for ids without overflow
    order = F.struct("n_points", F.bitwise_not("id").alias("not_id"), F.bitwise_not(KEY).alias("not_key"))
    groups = members.groupBy("depth", "name").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    groups = materialize(groups, "groups")  # the join below then reads plain shuffles, which AQE can split
    return members.join(groups, ["depth", "name"]).select(
        KEY,
        F.col("id").alias(id_col),
        F.bitwise_not("best.not_id").alias("keep_id"),
        "group_size",
        (F.bitwise_not("best.not_key") == F.col(KEY)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they came."""
    rows, key = keyed(docs, id_col)
    kept = exact_groups(rows, id_col, text_col, key=key).where("kept").select(F.col(KEY).alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
