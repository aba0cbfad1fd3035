"""Operator 11, ranked lexical search: a threshold-seeded join of items with the postings of all documents.

1. One pass over the whole texts counts terms and keeps, a row per document, those that an item may have: terms whose
   CRC is set in a bitmap of 2**24 marks, which is all that is broadcast, whatever the number of items (a term that is let
   through by chance meets no item later on). The pass also sums the documents and terms of the corpus.
2. Per term of the items the ``k`` best impacts are stored with their documents, and the document frequency. An impact is
   what a term adds to a document's score, less the term's weight; Spark keeps the k best of every task before the shuffle.
3. Seeds: the weighted k-th impact of any of its terms bounds an item's k-th score from below. The stored documents of
   its ``SEEDS`` best terms and those that its rarest terms put first are scored exactly; the k-th score raises the bound.
4. Terms are put in order of document frequency; the most frequent ones whose greatest impacts together stay under
   the bound (``KEPT`` times the bound) can't lift a document into the list by themselves: their postings are not joined.
5. The other terms' postings meet the items by an equi-join on the term and add up per (item, document), combined before
   the shuffle. Candidates that can't reach the bound with all pruned terms go. The first of the others, scored exactly,
   raise the bound once more; what is left is scored exactly over all terms, and the k best of each item stay.

All arithmetic but a term's weight is in 64-bit integers: ``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` times
``(1000000000 tf) div (1000 tf + 8 m)`` with ``m = 100 - 90 + (90 n N) div L``.

Edge cases: null and empty texts have no term: such documents are not counted and never ranked, such items have no
rows; every row of ``items`` is an item of its own and every row of ``docs`` a document, also where ids repeat or are null
(null ids rank last among equal scores, then rows go by their number); text ids rank in their own order; terms repeated in
an item count once; very long texts are counted in pieces of four megabytes; a table without rows on either side gives an
empty result; only the named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.llm.common import KEY, keyed, materialize, raw_texts
from sparquill.operators.relational import small

#: Terms of an item whose stored documents are seeds, and the share of its terms, the rarest, that find further ones.
SEEDS, RARE = 8, 0.5
#: Terms are pruned while all of them together stay under this share of the bound. At 1 the fewest postings are joined, but
#: then nearly every document that has a joined term is a candidate; at a half, one must reach half of the bound by joined terms.
KEPT = 0.5
MARKS = 1 << 24
PIECE = 4 << 20

#: Letters, digits and all bytes of other characters stay, capitals of ASCII are lowered, the rest parts terms.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def term_counts(raw: bytes) -> Counter:
    """How often each term is in a text, piece by piece."""
    folded = raw.translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [list(term_counts(raw)) for raw in raw_texts(batch.column("text"))]
        q = np.repeat(batch.column("q").to_numpy(), [len(t) for t in terms])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([t for of in terms for t in of], pa.binary())], ["q", "term"])


def _marks(terms: DataFrame) -> np.ndarray:
    """A bit per CRC of a term, modulo ``MARKS``: at most MARKS / 64 rows reach the driver, two megabytes."""
    slots = terms.select((F.crc32("term") % MARKS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS INT))")).alias("bits"))
    out = np.zeros(MARKS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _counted(keys: pa.Array, ids: pa.Array, n: list, terms: list, tfs: list, docs: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([keys, ids, *map(pa.array, (n, terms, tfs, docs), kinds)], [KEY, "id", "n", "term", "tf", "docs"])


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value.view(np.uint8), bitorder="little").tobytes()
        mask = MARKS - 1
        docs = words = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            at, sizes, terms, tfs = [], [], [], []
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                counts = term_counts(raw)
                if not counts:
                    continue
                n = counts.total()
                docs, words = docs + 1, words + n
                mine = [t for t in counts if marks[crc32(t) & mask]]
                if mine:
                    at.append(i)
                    sizes.append(n)
                    terms.append(mine)
                    tfs.append([counts[t] for t in mine])
            spots = pa.array(at, pa.int64())
            yield _counted(batch.column(KEY).take(spots), batch.column("id").take(spots), sizes, terms, tfs, [None] * len(at))
        if kind is not None:  # one row a task for the statistics, without a key
            yield _counted(pa.nulls(1, pa.int64()), pa.nulls(1, kind), [words], [[]], [[]], [docs])

    return run


class Index:
    """Counted documents, restricted to terms that items may have, with the corpus's statistics and the stored impacts."""

    def __init__(self, docs: DataFrame, terms: DataFrame, k: int):
        """``docs`` is (_row_key, id, text), ``terms`` (term) of all items."""
        self.k = k
        terms = terms.distinct()
        shared = docs.sparkSession.sparkContext.broadcast(_marks(terms))
        kind = docs.schema["id"].dataType.simpleString()
        made = docs.mapInArrow(_counter(shared), f"{KEY} long, id {kind}, n long, term array<binary>, tf array<long>, docs long")
        made = materialize(made, "counted")
        total = made.where("docs IS NOT NULL").agg(F.sum("docs").alias("docs"), F.sum("n").alias("words")).first()
        self.docs, self.words = total["docs"] or 0, total["words"] or 0
        self.rows = made.where("docs IS NULL").drop("docs")
        self.impacts = materialize(self._stored(self.postings().join(small(terms), "term", "left_semi")), "impacts")

    def postings(self) -> DataFrame:
        """(_row_key, term, impact)."""
        each = self.rows.select(KEY, "n", F.inline(F.arrays_zip("term", "tf")))
        return each.select(KEY, "term", self.impact().alias("impact"))

    def impact(self) -> Column:
        m = f"(100L - 90L + (90L * n * {self.docs}L) div {max(1, self.words)}L)"
        return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")

    def _stored(self, postings: DataFrame) -> DataFrame:
        """(term, df, w, best): per term its weight and the k best (impact, document), greatest first."""
        first = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), KEY))
        best = postings.withColumn("r", first).where(F.col("r") <= self.k).groupBy("term")
        best = best.agg(F.sort_array(F.collect_list(F.struct("impact", KEY)), asc=False).alias("best"))  # k at most
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        w = F.floor(1000 * F.log(F.lit(2 * self.docs + 2).cast("double") / (2 * F.col("df") + 1)))
        return df.join(best, "term").select("term", "df", w.alias("w"), "best")

    def parts(self, terms: DataFrame) -> DataFrame:
        """(q, _row_key, part): what ``terms`` (q, term, w) alone add to the score of every document that has one."""
        return self.postings().join(small(terms), "term").groupBy("q", KEY).agg(F.sum(F.col("w") * F.col("impact")).alias("part"))

    def exact(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(q, _row_key, id, score): the score of each of ``pairs`` (q, _row_key) over all terms of the item."""
        each = pairs.join(self.rows, KEY).select("q", KEY, "id", "n", F.inline(F.arrays_zip("term", "tf")))
        each = each.select("q", KEY, "id", "term", self.impact().alias("impact")).join(small(asked.select("q", "term", "w")), ["q", "term"])
        return each.groupBy("q", KEY).agg(F.first("id").alias("id"), F.sum(F.col("w") * F.col("impact")).alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(q, score): the k-th greatest score of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    return scored.select("q", "score").withColumn("r", place).where(F.col("r") == k).select("q", "score")


def _first(parts: DataFrame, k: int) -> DataFrame:
    """(q, _row_key): the k documents of greatest ``part`` of each item."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("part"), KEY))
    return parts.withColumn("r", place).where(F.col("r") <= k).select("q", KEY)


def seeded(index: Index, asked: DataFrame) -> DataFrame:
    """(q, least): a lower bound of each item's k-th score, 0 if there is none.

    The weighted k-th stored impacts bound it; so do exact scores of any k documents: here of those that are stored with
    the item's ``SEEDS`` best terms, and of those that the rarest ``RARE`` of its terms together put first.
    """
    k = index.k
    kth = F.when(F.size("best") >= k, F.col("w") * F.col("best")[k - 1]["impact"]).otherwise(0)
    bounds = asked.withColumn("kth", kth)
    stored = bounds.groupBy("q").agg(F.max("kth").alias("stored"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("kth"), "term"))
    pairs = bounds.withColumn("nth", nth).where(F.col("nth") <= SEEDS).select("q", F.explode("best").alias("b")).select("q", F.col(f"b.{KEY}").alias(KEY))
    place = F.percent_rank().over(Window.partitionBy("q").orderBy("df", "term"))
    rare = asked.withColumn("place", place).where(F.col("place") <= RARE).select("q", "term", "w")
    pairs = pairs.unionByName(_first(index.parts(rare), k)).distinct()
    return stored.join(_kth(index.exact(pairs, asked), k), "q", "left").select("q", F.greatest("stored", F.coalesce("score", F.lit(0))).alias("least"))


def pruned(asked: DataFrame, least: DataFrame) -> DataFrame:
    """``asked`` with ``least`` and with ``bound``: what the term and all more frequent ones of the item can add at most.

    Terms whose ``bound`` is under ``least`` can't make a candidate without a rarer one.
    """
    most = F.col("w") * F.col("best")[0]["impact"]
    upto = Window.partitionBy("q").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asked.join(least, "q").withColumn("bound", F.sum(most).over(upto)).drop("best")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` documents of greatest score above 0 for each row of ``items``."""
    rows, key = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    rows = rows.select(F.col(key).alias(KEY), "id", "text")
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.col(item_text).alias("text")), "items")
    terms = materialize(numbered.select("q", "text").mapInArrow(_item_terms, "q long, term binary"), "item_terms")
    index = Index(rows, terms.select("term"), k)
    asked = materialize(terms.join(index.impacts, "term"), "asked")
    bounded = materialize(pruned(asked, seeded(index, asked)), "bounded")
    kept = (F.col("bound") >= KEPT * F.col("least")) & (F.col("bound") > 0)
    joined = bounded.where(kept).select("q", "term", "w")
    rest = bounded.groupBy("q").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(~kept, F.col("bound"))), F.lit(0)).alias("rest"))
    met = materialize(index.parts(joined).join(small(rest), "q").where("part + rest >= least"), "met")
    higher = _kth(index.exact(_first(met, k), asked), k)  # once more, now that most of every score is known
    candidates = met.join(higher, "q", "left").where("part + rest >= coalesce(score, 0)").select("q", KEY)
    scored = index.exact(materialize(candidates, "candidates"), asked).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), KEY)
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
