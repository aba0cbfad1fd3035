"""Many needles in one pass: which of a set of strings every text holds, where first and how often.

Needles make one automaton (Aho-Corasick), which is broadcast as long as they have at most ``NEEDLE_CHARS`` characters: every
text is then read once, whatever the number of needles, and texts are not shuffled. Beyond that, needles and texts meet
on the needle's rarest gram by an equi-join (``by_grams``). Both find the same.

Null and empty needles are in no text, null and empty texts hold none; repeated needles and texts are rows of their own;
case and every character count. Occurrences are counted from the left without overlap; positions are characters from 1.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import windows
from sparquill.operators.relational import small

#: Characters of the distinct needles of an automaton: about 100 MB in a Python worker.
NEEDLE_CHARS = 1 << 20

_HITS = pa.list_(pa.struct([("needle", pa.string()), ("hits", pa.int32()), ("first", pa.int32())]))


def _finder(shared):
    built: list = []

    def find(texts: pa.Array) -> pa.Array:
        words = shared.value
        if not built:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, w in enumerate(words):
                automaton.add_word(w, i)
            automaton.make_automaton()
            built.append(automaton)
        out = []
        for text in texts.to_pylist():
            met: dict[int, list[int]] = {}  # needle: hits, first start, end of the last one
            for last, i in built[0].iter(text) if text and words else ():
                start = last + 1 - len(words[i])
                m = met.get(i)
                if m is None:
                    met[i] = [1, start, last]
                elif start > m[2]:
                    m[0] += 1
                    m[2] = last
            out.append([{"needle": words[i], "hits": n, "first": start + 1} for i, (n, start, _) in met.items()])
        return pa.array(out, _HITS)

    return F.arrow_udf(find, "array<struct<needle: string, hits: int, first: int>>")


def _in_bound(needles: DataFrame, needle: str, most: int) -> list[str] | None:
    """The distinct needles if they have at most ``most`` characters in all, else None."""
    words = needles.select(F.col(needle).alias("w")).where("w <> ''").distinct()
    if (words.agg(F.sum(F.length("w"))).first()[0] or 0) > most:
        return None
    return sorted(r["w"] for r in words.collect())


def substring_join(short: DataFrame, long: DataFrame, needle: str, hay: str, most: int = NEEDLE_CHARS) -> DataFrame:
    """Columns of both sides with ``hits`` and ``first``: the pairs in which ``hay`` contains ``needle``.

    Columns have different names on the two sides, none of them ``hits`` or ``first``.
    """
    words = _in_bound(short, needle, most)
    if words is None:
        return by_grams(short, long, needle, hay)
    found = _finder(short.sparkSession.sparkContext.broadcast(words))(F.col(hay))
    met = long.where(F.length(hay) > 0).withColumn("_h", F.explode(found))
    met = met.select(*long.columns, F.col("_h.needle").alias("_w"), F.col("_h.hits").alias("hits"), F.col("_h.first").alias("first"))
    return small(short).join(met, F.col(needle) == F.col("_w")).select(*short.columns, *long.columns, "hits", "first")


def _hits(needle: Column, hay: Column) -> Column:
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("int")


def by_grams(short: DataFrame, long: DataFrame, needle: str, hay: str, gram: int = 3) -> DataFrame:
    """``substring_join`` for any number of needles: candidates share the needle's rarest gram, then are checked.

    Needles shorter than ``gram`` characters are compared by their own length of gram.
    """
    out = None
    for n in range(1, gram + 1):
        some = short.where(F.length(needle) >= n if n == gram else F.length(needle) == n)
        hays = long.withColumn("_g", F.explode(F.array_distinct(windows(F.col(hay), n))))
        often = hays.groupBy("_g").agg(F.count("*").alias("_n"))
        each = some.select(F.col(needle).alias("_w")).distinct().withColumn("_g", F.explode(F.array_distinct(windows(F.col("_w"), n)))).join(often, "_g")
        rare = each.groupBy("_w").agg(F.min(F.struct("_n", "_g")).alias("_m")).select("_w", F.col("_m._g").alias("_g"))
        found = rare.join(hays, "_g").where(F.contains(F.col(hay), F.col("_w"))).drop("_g")
        found = some.join(found, F.col(needle) == F.col("_w"))
        out = found if out is None else out.unionByName(found)
    return out.select(*short.columns, *long.columns, _hits(F.col(needle), F.col(hay)).alias("hits"), F.expr(f"CAST(locate(`{needle}`, `{hay}`) AS INT)").alias("first"))
