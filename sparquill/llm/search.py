"""Operator 9, exact top-k search: BM25 over an inverted index with stored block maxima, by shard.

1. One pass over the whole texts builds an index shard from every ``SHARD_BYTES`` of text or so. Within a shard,
   documents are ordered by their most frequent word, then by length, so that the ``BLOCK`` documents of a block are
   alike and bounds are tight. For each term and block the index stores the maximum: the greatest term frequency and
   the least document length there, which bound the term's score for whatever mean length the corpus has in the end.
2. Query rows are numbered and packed into blocks of at most ``QUERY_ROWS`` rows and about ``QUERY_BYTES`` of text (a
   longer text is a block of its own). A packed block, not the texts, is what the driver reads and broadcasts.
   Document frequencies are summed over all shards first, once for all blocks, and joined to the terms of each, so
   every shard scores with global statistics. A shard gives one row for each of its terms, however many queries come.
3. Shards are searched in rounds, each ``GROWTH`` times as many as the one before; the k best so far give each
   query's threshold for the next round, so all rounds together return about ``GROWTH`` * k rows per query and round,
   and the number of rounds grows with the logarithm of the shards.
4. A block of queries is inverted too: of each term the queries that have it. In a shard, all queries of a block meet a
   run of document blocks at once. Terms that are rare there or among the queries are added up from the two lists, exactly.
   Terms that are frequent in both are bounded by their stored block maxima; only queries whose bound, with the greatest of
   their sums, reaches the threshold are scored, by a product in single precision, and what comes within its rounding error
   of the threshold is scored in double precision. Alike queries are next to each other, as alike documents are, so that
   the product covers whole stretches. The threshold rises to the k-th best score met by this task so far.
   A task keeps only the k best of a query over all its shards. The union's top k is exact.

   Queries may be whole documents, whose bounds cost as much as a third of their scores and leave 0.4 of the blocks; so
   bounds are added up for frequent terms alone, and no step is taken query by query.

Score: sum over query terms of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)),
rounded to 6 places; ties go to the smaller id.

Edge cases: null and empty texts match nothing and, as queries, return no row; documents without a common term are
not returned, so a query may have fewer than k rows; repeated documents are ranked each; every row of ``queries`` is a
query of its own, also where ids repeat; null ids are not indexed (as queries they are answered under a null id); very
long texts are indexed whole, in a shard of their own if need be; only the named columns are read, so further columns
of any name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.llm.common import ONE_ROW_GROUPS, arrow_rows, materialize, raw_texts

K1, B = 1.5, 0.75
SHARD_BYTES, BLOCK = 8 << 20, 64
QUERY_ROWS, QUERY_BYTES = 4000, 16 << 20
GROWTH, FIRST_SHARDS = 16, 6
#: Numbers of the matrix of frequent terms by queries, and the share of the queries from which on a term is one. Cells of a run of documents by queries, and
#: of those whose lists are summed at once; the share of a run's cells from which on a product sums a term; queries apart that are multiplied together.
QUICK, SELDOM, CELLS, CHUNK, DENSE, APART = 1 << 23, 0.01, 1 << 21, 1 << 15, 0.002, 32


def terms_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


class _Shard:
    """One shard under construction: words are numbered as they come, so that only numbers are held."""

    def __init__(self, block: int):
        self.block = block
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int, raw: bytes) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.words.append(np.array([number.setdefault(w, len(number)) for w in terms_of(raw)], np.int32))
        self.held += len(raw) + 64

    def row(self) -> dict:
        n, v = len(self.ids), max(1, len(self.number))
        size = np.array([len(w) for w in self.words], np.int64)
        cell = np.concatenate(self.words).astype(np.int64)
        self.words = []
        cell += np.repeat(np.arange(n) * v, size)
        cell.sort()
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        tf = np.diff(np.append(head, len(cell)))
        cell = cell[head]
        doc, term = cell // v, cell % v
        # alike documents next to each other: by most frequent word, then length
        top = np.full(n, -1, np.int64)
        by_count = np.argsort(tf, kind="stable")
        top[doc[by_count]] = term[by_count]  # the last write of a document is its most frequent word
        order = np.lexsort((size, top))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        size, doc = size[order], place[doc]
        by_term = np.lexsort((doc, term))
        doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        n_blocks = -(-n // self.block)
        entry = term * n_blocks + doc // self.block
        first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.empty(0, np.int64)
        most = np.maximum.reduceat(tf, first) if len(first) else first
        least = np.minimum.reduceat(size[doc], first) if len(first) else first
        return {
            "ids": np.array(self.ids, "<i8")[order].tobytes(),
            "size": size.astype("<i4").tobytes(),
            "terms": b"\n".join(self.number),
            "df": np.bincount(term, minlength=len(self.number)).astype("<i4").tobytes(),
            "doc": doc.astype("<i4").tobytes(),
            "tf": tf.astype("<i4").tobytes(),
            "entry_term": np.bincount(entry[first] // n_blocks, minlength=len(self.number)).astype("<i4").tobytes(),
            "entry_block": (entry[first] % n_blocks).astype("<i4").tobytes(),
            "entry_first": first.astype("<i4").tobytes(),
            "entry_most": most.astype("<i4").tobytes(),
            "entry_least": least.astype("<i4").tobytes(),
            "n_docs": n,
            "n_words": int(size.sum()),
        }


_BLOBS = "ids size terms df doc tf entry_term entry_block entry_first entry_most entry_least".split()
_SHARD = pa.schema([*((c, pa.binary()) for c in _BLOBS), ("n_docs", pa.int64()), ("n_words", pa.int64())])
_SHARD_KIND = ", ".join(f"{c} binary" for c in _BLOBS) + ", n_docs long, n_words long"


def _builder(shard_bytes: int, block: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(block)
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                shard.add(i, raw)
                if shard.held >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard.row()], _SHARD)
                    shard = _Shard(block)
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], _SHARD)

    return build


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """The index table: one row a shard, ``round`` says in which round the shard is searched (0 is the last)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    made = rows.mapInArrow(_builder(shard_bytes, block), _SHARD_KIND)
    # the share of shards of round r and earlier ones is GROWTH ** -r: as many leading zeros of a hash in base GROWTH
    draw = F.pmod(F.xxhash64("ids"), F.lit(GROWTH**8))
    return materialize(made.withColumn("round", sum((draw < GROWTH ** (8 - r)).cast("int") for r in range(1, 9))), "index", **ONE_ROW_GROUPS)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Query rows of a block (which are neighbours) as numbers into the block part's own term list."""
    part: list[tuple] = []
    held, now = 0, None

    def done() -> pd.DataFrame:
        number: dict[bytes, int] = {}
        term = [number.setdefault(t, len(number)) for *_, c in part for t in c]
        size = [len(c) for *_, c in part]
        return pd.DataFrame(
            [
                {
                    "block": now,
                    "query": np.array([q for q, _, _ in part], "<i8").tobytes(),
                    "size": np.array(size, "<i4").tobytes(),
                    "words": b"\n".join(number),
                    "term": np.array(term, "<i4").tobytes(),
                    "tf": np.array([n for *_, c in part for n in c.values()], "<i4").tobytes(),
                }
            ]
        )

    for batch in batches:
        for block, query, text in batch[["block", "query", "text"]].itertuples(index=False):
            if part and (block != now or held > 1 << 20):
                yield done()
                part, held = [], 0
            counts = Counter(terms_of((text or "").encode("utf-8", "surrogatepass")))
            now = block
            if counts:
                part.append((query, block, counts))
                held += len(text) + 64
    if part:
        yield done()


def _packed(queries: DataFrame, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """The numbered query rows, and their packed blocks (rows of about a megabyte)."""
    numbered = queries.select(F.monotonically_increasing_id().alias("query"), F.col("id").cast("long").alias("query_id"), "text")
    numbered = materialize(numbered, "queries")
    # blocks: rows and bytes before a row, summed over chunks of rows first, so that no task holds all of them
    sized = numbered.select("query", (F.octet_length(F.coalesce("text", F.lit(""))) + 64).cast("long").alias("n"), F.shiftright("query", 10).alias("chunk"))
    chunks = sized.groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"))
    own = Window.partitionBy("chunk").orderBy("query")
    spot = sized.join(chunks, "chunk").select(
        "query",
        F.floor((F.col("bytes") + F.sum("n").over(own) - F.col("n")) / QUERY_BYTES).alias("a"),
        F.floor((F.col("rows") + F.row_number().over(own) - 1) / query_rows).alias("b"),
    )
    spot = spot.select("query", (F.col("a") * (1 << 31) + F.col("b")).alias("block"))
    rows = numbered.join(spot, "query").repartition("block").sortWithinPartitions("block", "query")
    packed = rows.select("block", "query", "text").mapInPandas(_pack, "block long, query binary, size binary, words binary, term binary, tf binary")
    return numbered, materialize(packed, "packed")


class _Queries:
    """One packed block: its distinct words, and of each query the terms with their frequencies."""

    def __init__(self, parts: list):
        number: dict[bytes, int] = {}
        ids, sizes, terms, tf = [], [], [], []
        for p in sorted(parts, key=lambda p: np.frombuffer(p["query"], "<i8", 1)[0]):
            local = np.array([number.setdefault(w, len(number)) for w in p["words"].split(b"\n")], np.int64)
            ids.append(np.frombuffer(p["query"], "<i8"))
            sizes.append(np.frombuffer(p["size"], "<i4").astype(np.int64))
            terms.append(local[np.frombuffer(p["term"], "<i4")])
            tf.append(np.frombuffer(p["tf"], "<i4").astype(np.float64))
        self.ids, self.term, self.tf = np.concatenate(ids), np.concatenate(terms), np.concatenate(tf)
        self.start = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.words = pa.array(list(number), pa.binary())
        self.idf = np.zeros(len(number))
        self.least = np.zeros(len(self.ids))
        self.mean = 1.0
        self.order: np.ndarray | None = None

    def invert(self) -> None:
        """Of each term the queries that have it, as often as they do, and the numbers of frequent ones as a matrix; a worker does it once for all its tasks."""
        if self.order is not None:
            return
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.start))
        # alike queries next to each other: by their most frequent word
        by_tf = np.argsort(self.tf, kind="stable")
        top = np.empty(len(self.ids), np.int64)
        top[owner[by_tf]] = self.term[by_tf]
        self.order = np.argsort(top, kind="stable")
        place = np.empty(len(self.ids), np.int64)
        place[self.order] = np.arange(len(self.ids))
        n = self.tf[by_term := np.argsort(self.term, kind="stable")].astype(np.int64)
        query, term = place[owner[by_term]], self.term[by_term]
        self.list_query = np.repeat(query, n)
        self.list_size = np.bincount(term, n, len(self.words)).astype(np.int64)
        self.list_first = np.cumsum(self.list_size) - self.list_size
        rows = np.argsort(-self.list_size, kind="stable")[: QUICK // len(self.ids)]
        rows = rows[self.list_size[rows] >= max(32, SELDOM * len(self.ids))]
        rows = rows[~np.isin(rows, term[n >= 1 << 24])]  # numbers are whole in single precision
        self.quick_row = np.full(len(self.words), -1)
        self.quick_row[rows] = np.arange(len(rows))
        self.quick = np.zeros((len(rows), len(self.ids)), np.float32)
        held = self.quick_row[term] >= 0
        self.quick[self.quick_row[term[held]], query[held]] = n[held]
        self.term = self.tf = self.start = None


def _terms(blob: bytes) -> list[bytes]:
    return blob.split(b"\n") if blob else []


def _term_array(blob: bytes) -> pa.Array:
    """The terms of a blob, without a Python object for each."""
    raw = np.frombuffer(blob, np.uint8)
    gap = raw == ord("\n")
    at = np.flatnonzero(gap)
    ends = np.append(at, len(raw)) - np.arange(len(at) + 1) if len(raw) else np.empty(0, np.int64)
    starts = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(raw[~gap])])


def _index_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob, df in zip(batch.column("terms"), batch.column("df"), strict=True):
            n = pa.array(np.frombuffer(df.as_py(), "<i4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([_term_array(blob.as_py()), n], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, blob in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            terms = _term_array(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), b)), terms], ["block", "term"])


def _frequencies(index: DataFrame, packed: DataFrame) -> DataFrame:
    """(block, term, df): in how many documents of the whole index each term of a block of queries is."""
    found = index.select("terms", "df").mapInArrow(_index_terms, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = packed.select("block", "words").mapInArrow(_query_terms, "block long, term binary").distinct()
    with arrow_rows(index.sparkSession, 1):
        # sorted, so that reading one block skips the pages of others
        return materialize(found.join(asked.hint("merge"), "term").select("block", "term", "df").sortWithinPartitions("block"), "frequencies")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for every range, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Best:
    """The k best (score, id) of each query that a task has met, ties to the smaller id; hits wait until there are as many as queries."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.n_held += len(query)
        if self.n_held >= len(self.least):
            self.merge()

    def merge(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip((self.query, self.ids, self.score), *self.held, strict=True))
        kept = np.flatnonzero((score >= self.least[query]) & (score > 0))
        order = kept[np.lexsort((ids[kept], -score[kept], query[kept]))]
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        best = order[place < self.k]
        last = order[place == self.k - 1]  # of queries that have k
        self.query, self.ids, self.score = query[place < self.k], ids[best], score[best]
        self.least[query[place == self.k - 1]] = score[last]
        self.held, self.n_held = [], 0


def _walk(shard, block: _Queries, best: _Best) -> None:
    """All queries of a block over one shard."""
    width = len(block.ids)
    ids, dl = np.frombuffer(shard.ids, "<i8"), np.frombuffer(shard.size, "<i4")
    found = pc.index_in(_term_array(shard.terms), block.words).fill_null(-1).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(found >= 0)
    found = found[mine]
    # postings and entries of the queries' terms, which are numbered among those
    df = np.frombuffer(shard.df, "<i4").astype(np.int64)
    spot = _ranges((np.cumsum(df) - df)[mine], df[mine])
    if not len(spot):
        return
    doc, tf = np.frombuffer(shard.doc, "<i4")[spot], np.frombuffer(shard.tf, "<i4")[spot]
    by_doc = np.argsort(doc.astype(np.uint16) if len(ids) <= 1 << 16 else doc, kind="stable")
    term, doc, tf = np.repeat(np.arange(len(mine)), df[mine])[by_doc], doc[by_doc].astype(np.int64), tf[by_doc]
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / block.mean)[doc])
    value *= block.idf[found][term]
    n_entries = np.frombuffer(shard.entry_term, "<i4").astype(np.int64)
    spot = _ranges((np.cumsum(n_entries) - n_entries)[mine], n_entries[mine])
    where = np.frombuffer(shard.entry_block, "<i4")[spot]
    by_block = np.argsort(where, kind="stable")
    spot, where, of = spot[by_block], where[by_block], np.repeat(np.arange(len(mine)), n_entries[mine])[by_block]
    high, low, first = (np.frombuffer(x, "<i4")[spot] for x in (shard.entry_most, shard.entry_least, shard.entry_first))
    most = high * (K1 + 1) / (high + K1 * (1 - B + B * low / block.mean)) * block.idf[found][of]  # the stored maxima, for the corpus's mean length
    # runs of blocks: from the least document of their first block to that of the next run's
    head = np.flatnonzero(np.append(True, np.diff(where) != 0))
    start = np.minimum.reduceat(np.frombuffer(shard.doc, "<i4")[first], head)
    head = head[np.append(True, np.diff(start // max(1, CELLS // width)) != 0)]
    start = np.minimum.reduceat(np.frombuffer(shard.doc, "<i4")[first], head)
    cuts = [(*x, *np.searchsorted(doc, x[:2]).tolist()) for x in zip(start.tolist(), [*start[1:].tolist(), len(ids)], head.tolist(), [*head[1:].tolist(), len(where)], strict=True)]
    list_first, list_size, quick_row = block.list_first[found], block.list_size[found], block.quick_row[found]
    for at, end, e, e_end, a, b in cuts:
        t, row, x, rows = term[a:b], doc[a:b] - at, value[a:b], end - at
        # a term that is frequent here and among the queries is summed by a product
        often = np.flatnonzero((quick_row >= 0) & (np.bincount(t, minlength=len(mine)) * list_size > DENSE * rows * width))
        column = np.full(len(mine), -1)
        column[often] = np.arange(len(often))
        product = column[t]
        rest = np.flatnonzero(product < 0)
        hold = np.flatnonzero(product >= 0)
        docs = np.zeros((rows, len(often)))
        docs[row[hold], product[hold]] = x[hold]
        quick, quick_docs = block.quick.take(quick_row[often], 0), docs.astype(np.float32)
        # the others query by query: every document's lists, a few documents at a time
        sums, peak = np.empty((rows, width)), np.zeros(width)
        t, row, x = t[rest], row[rest], x[rest]
        step = max(1, CHUNK // width)
        cut = np.searchsorted(row, np.arange(0, rows + step, step)).tolist()
        for i, (c, d) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            n, size = list_size[t[c:d]], min(step, rows - i * step)
            cell = block.list_query[_ranges(list_first[t[c:d]], n)]
            cell += np.repeat((row[c:d] - i * step) * width, n)
            part = np.bincount(cell, np.repeat(x[c:d], n), size * width).reshape(size, width)
            np.maximum(peak, part.max(axis=0), out=peak)
            sums[i * step : i * step + size] = part
        # what no document of the run can exceed: the stored maxima of its blocks, and the others' sums
        top = np.zeros(len(often))
        own = np.flatnonzero(column[of[e:e_end]] >= 0) + e
        np.maximum.at(top, column[of[own]], most[own])
        slack = 1 + (len(often) + 8) * 2.0**-22  # single precision of sums of positive numbers
        limit = (top.astype(np.float32) @ quick) * slack**2 + peak
        some = np.flatnonzero((limit >= best.least - 1e-5) & (limit > 0))
        if not len(some):
            continue
        # alike queries are next to each other: stretches of them are multiplied
        apart = np.diff(some) > APART
        for q, q_end in zip(some[np.append(True, apart)].tolist(), (some[np.append(apart, True)] + 1).tolist(), strict=True):
            least = np.maximum(best.least[q:q_end] / slack - 1e-5, 1e-7).astype(np.float32)
            score = quick_docs @ quick[:, q:q_end]
            score += sums[:, q:q_end]
            hit = score >= least
            if rows > best.k and np.count_nonzero(hit) > 2 * best.k * (q_end - q):
                hit &= score >= np.partition(score, rows - best.k, axis=0)[rows - best.k] / slack**2 - 1e-5
            r, c = np.divmod(np.flatnonzero(hit), q_end - q)
            c += q
            for i in range(0, len(r), 1 << 12):
                ri, ci = r[i : i + (1 << 12)], c[i : i + (1 << 12)]
                best.add(ci, ids[at + ri], np.round(sums[ri, ci] + np.einsum("ij,ji->i", docs[ri], quick[:, ci]), 6))


def _searcher(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        block.invert()
        best = _Best(block.least[block.order], k)
        for batch in batches:
            for shard in batch.itertuples(index=False):
                _walk(shard, block, best)
        best.merge()
        yield pd.DataFrame({"query": block.ids[block.order[best.query]], "doc_id": best.ids, "score": best.score})

    return run


def _top(tops: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of ``index`` for each row of ``queries(id, text)``."""
    spark = index.sparkSession
    kind = "query_id long, rank int, doc_id long, score double"
    by_round = {r["round"]: (r["shards"], r["docs"], r["words"]) for r in index.groupBy("round").agg(F.count("*").alias("shards"), F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).collect()}
    n_docs, n_words = sum(x[1] for x in by_round.values()), sum(x[2] for x in by_round.values())
    if not n_words:
        return spark.createDataFrame([], kind)
    # the first rounds are joined until they have a few shards
    rounds: list[list[int]] = [[]]
    held = 0
    for r in sorted(by_round, reverse=True):
        rounds[-1].append(r)
        held += by_round[r][0]
        if r and held >= FIRST_SHARDS:
            rounds.append([])
    rounds = [r for r in rounds if r]
    numbered, packed = _packed(queries, query_rows)
    frequencies = _frequencies(index, packed)
    found = []
    for b in [r["block"] for r in packed.select("block").distinct().orderBy("block").toLocalIterator()]:
        block = _Queries(packed.where(F.col("block") == b).collect())  # at most query_rows rows and QUERY_BYTES, or one text
        df = np.zeros(len(block.words))
        hits = frequencies.where(F.col("block") == b).select("term", "df").toArrow()  # at most one row per term of this block
        df[pc.index_in(hits["term"], block.words).to_numpy()] = hits["df"].to_numpy()
        block.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        block.mean = n_words / n_docs
        tops = None
        for nth, some in enumerate(rounds):
            shared = spark.sparkContext.broadcast(block)
            more = index.where(F.col("round").isin(some)).drop("round").mapInPandas(_searcher(shared, k), "query long, doc_id long, score double")
            with arrow_rows(spark, 1):
                tops = materialize(_top(more if tops is None else more.unionByName(tops), k).select("query", "doc_id", "score"), "tops")
            shared.unpersist()
            if nth + 1 < len(rounds):  # the k-th best so far, of queries that have k
                full = tops.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toPandas()
                at = np.searchsorted(block.ids, full["query"].to_numpy(np.int64))
                block.least = np.zeros(len(block.ids))
                block.least[at] = full["least"].to_numpy()
        found.append(tops)
    if not found:
        return spark.createDataFrame([], kind)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _top(out, k).join(numbered.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")
