"""Operator 7, repeated-substring dedup by a hash-compared suffix sort.

Every byte covered by a ``length``-byte string that also starts anywhere else, in the same or another text, goes.

1. One pass over each whole text: polynomial prefix hashes give every ``GRAM``-byte hash; of the grams inside each
   ``length``-byte window the least (leftmost on a tie) is its anchor. Equal windows have the same anchor at the same
   place, so the windows of an anchor can only repeat at anchors of equal gram. There is an anchor every
   (length - GRAM) / 2 bytes or so; its context is the union of the windows that it anchors.
2. Anchors of a gram met once end here. The others form classes of equal contexts (128-bit digests, partial
   aggregates): in a class of two or more, every window is repeated, and the class is done.
3. Of each class of a gram with several classes one context is fetched. Per gram, the suffixes that start at the
   anchor are merge-sorted; two suffixes are compared by binary search for their longest common extension on prefix
   hashes, so a comparison takes a logarithmic number of steps. From each suffix a walk over its neighbours in
   sorted order, where the right extension only shrinks, collects the left extensions (again by binary search) that
   add windows. What hashes claim is verified on the bytes; a collision makes the batch be sorted on bytes.
4. A group of more than ``HOT`` contexts is never gathered. Its windows are split by how many bytes they have before
   the anchor, into ``PARTS`` ranges; all windows of a range share a core, the bytes that every one of them covers, so
   contexts, cut to the range, are regrouped by (range, core), equal ones collapse into classes, and the smaller
   groups are sorted as in 3. Groups that are still too large are split again; a range of one offset has the whole
   window as its core, so at most ``ceil(log(length - GRAM + 1, PARTS))`` rounds are needed, mostly none.
5. The repeated spans of each text are merged and cut out.

Work grows with the text and its repeats; nothing is capped. The texts are shuffled once, by key, for 3 and 5.

Edge cases: null and empty texts have 0 bytes and the digest of nothing; texts shorter than ``length`` stay
whole; very long texts go through in segments of window starts, so no match is lost between segments; repeated rows
are texts of their own, so a row that comes twice loses its long passages in both; a null id is kept; only the id
and text columns are read, so further columns of any name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import KEY, key_id_text, materialize, raw_texts

LENGTH, GRAM, HOT, PARTS, SEGMENT = 400, 64, 4000, 8, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_INVERSE, m, 1 << 64))))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """hash of data[i:j] is (out[j] - out[i]) * down[i]."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first and last window start) of every anchor of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    span = length - gram + 1
    for at in range(0, len(data) - length + 1, SEGMENT):  # window starts at .. at + SEGMENT - 1
        part = data[at : at + SEGMENT + length - 1]
        sums = powers.prefix(part)
        h = _stir((sums[gram:] - sums[:-gram]) * powers.down[: len(part) - gram + 1])
        rank = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        full = np.full(-(-len(rank) // span) * span, 0xFFFFFFFFFFFFFFFF, np.uint64)
        full[: len(rank)] = rank
        blocks = full.reshape(-1, span)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        place = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], n) - 1
        out.append((h[place[first]], place[first] + at, first + at, last + at))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = pa.schema([(KEY, pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("context", pa.binary())])
_CONTEXT = pa.schema([(KEY, pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])
_CONTEXT_KIND = f"{KEY} long, h long, place long, before long, n long, hot boolean, bytes binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _finder(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows: list[tuple] = []
            digests: list[bytes] = []
            held = 0

            def flush() -> pa.RecordBatch:
                key, h, place, first, last = (np.concatenate(x) for x in zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([*map(pa.array, (key, h.view(np.int64), place, first, last)), pa.array(digests, pa.binary())], schema=_FOUND)

            for key, raw in zip(batch.column(KEY).to_pylist(), raw_texts(batch.column("text")), strict=True):
                if len(raw) < length:
                    continue
                found = anchors(np.frombuffer(raw, np.uint8), powers, length, gram)
                rows.append((np.full(len(found[0]), key), *found))
                digests += [xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(found[2].tolist(), found[3].tolist(), strict=True)]
                held += len(found[0])
                if held > 20_000:
                    yield flush()
                    rows, digests, held = [], [], 0
            if rows:
                yield flush()

    return find


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, raw, wanted in zip(batch.column(KEY).to_pylist(), raw_texts(batch.column("text")), batch.column("wanted"), strict=True):
            for w in wanted.as_py():
                out.append((key, w["h"], w["place"], w["place"] - w["first"], w["n"], w["hot"], raw[w["first"] : w["end"]]))
            if len(out) > 5000:
                yield _table(out, _CONTEXT)
                out = []
        if out:
            yield _table(out, _CONTEXT)


_PART = pa.schema([(KEY, pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary()), ("context", pa.binary())])


def _splitter(length: int, width: int):
    """Contexts cut to ranges of ``width`` offsets, each with a hash of (group, range, core) and a digest of the cut."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key, h, place, before, raw = row[KEY], row["h"], row["place"], row["before"], row["bytes"]
                least, most = max(0, before + length - len(raw)), min(before, length)  # bytes that a window has before the anchor
                for a in range(least // width * width, most + 1, width):
                    lo, hi = max(a, least), min(a + width - 1, most)
                    core = raw[before - a : before + length - (a + width - 1)] if lo <= hi else b""
                    if lo <= hi:
                        cut = raw[before - hi : before + length - lo]
                        group = xxhash.xxh3_64_intdigest(core, seed=(h ^ a * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                        out.append((key, group - (1 << 63), place, hi, row["n"], cut, xxhash.xxh3_128_digest(cut + hi.to_bytes(4, "little"))))
                if len(out) > 5000:
                    yield _table(out, _PART)
                    out = []
            if out:
                yield _table(out, _PART)

    return split


class Suffixes:
    """Contexts laid end to end: suffixes start at their anchors, and prefix hashes compare them."""

    def __init__(self, contexts: list[bytes], before: np.ndarray, powers: Powers):
        self.data = b"".join(contexts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.sums, self.down = powers.prefix(self.bytes), powers.down
        size = np.array([len(c) for c in contexts], np.int64)
        self.start = np.cumsum(size) - size
        self.at = self.start + before
        self.right, self.left = size - before, before

    def _search(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        lo, hi, p, q = np.zeros_like(most), most.copy(), self.at[i], self.at[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            a, b = (p - mid, q - mid) if back else (p, q)
            same = (self.sums[a + mid] - self.sums[a]) * self.down[a] == (self.sums[b + mid] - self.sums[b]) * self.down[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def common_right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._search(i, j, np.minimum(self.right[i], self.right[j]), False)

    def common_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._search(i, j, np.minimum(self.left[i], self.left[j]), True)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffix i before suffix j; of equal ones, or if one ends, the shorter is first."""
        n = self.common_right(i, j)
        over = (n == self.right[i]) | (n == self.right[j])
        last = len(self.bytes) - 1
        a, b = self.bytes[np.minimum(self.at[i] + n, last)], self.bytes[np.minimum(self.at[j] + n, last)]
        return np.where(over, self.right[i] < self.right[j], a < b)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Merge sort of all groups at once (``group`` is ascending): each round merges neighbouring runs."""
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        width = 1
        while n and width < size.max():
            slot = np.arange(n)
            nth = (slot - first) // width  # this slot's run
            other = np.where(nth % 2 == 0, nth + 1, nth - 1)
            lo = first + np.minimum(other * width, size)
            hi = first + np.minimum((other + 1) * width, size)
            base, odd = lo.copy(), nth % 2 == 1
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) >> 1
                mine, theirs = order[todo], order[mid]
                # a suffix of the left run goes before its equals in the right run
                ahead = np.where(odd[todo], ~self.less(mine, theirs), self.less(theirs, mine))
                lo[todo], hi[todo] = np.where(ahead, mid + 1, lo[todo]), np.where(ahead, hi[todo], mid)
            place = first + (nth // 2) * 2 * width + (slot - first - nth * width) + (lo - base)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
        """What the hashes say is true of the bytes: equal so far, and different or over after it."""
        d, p, q = self.data, self.at[i], self.at[j]
        end_p, end_q = (self.at + self.right)[i], (self.at + self.right)[j]
        return all(
            d[a - m : a + n] == d[b - m : b + n] and (a + n >= x or b + n >= y or d[a + n] != d[b + n])
            for a, b, m, n, x, y in zip(p.tolist(), q.tolist(), left.tolist(), right.tolist(), end_p.tolist(), end_q.tolist(), strict=True)
        )

    def exact(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same order and neighbours' extensions, from the bytes themselves."""
        tail = [self.data[a : a + n] for a, n in zip(self.at.tolist(), self.right.tolist(), strict=True)]
        order = sorted(range(len(tail)), key=lambda i: (group[i], tail[i]))
        ext = []
        for i, j in zip(order[:-1], order[1:], strict=True):
            n = min(len(tail[i]), len(tail[j]))
            diff = np.flatnonzero(np.frombuffer(tail[i][:n], np.uint8) != np.frombuffer(tail[j][:n], np.uint8))
            ext.append(int(diff[0]) if len(diff) else n)
        return np.array(order, np.int64), np.array(ext, np.int64)


def repeats(group: np.ndarray, contexts: list[bytes], before: np.ndarray, alone: np.ndarray, powers: Powers, length: int) -> list[tuple[int, int, int]]:
    """(context, bytes left, bytes right of its anchor) for spans made of windows that another context of the group has too.

    ``alone``: contexts that stand for one place only; the others are known to be repeated whole.
    """
    s = Suffixes(contexts, before, powers)
    order = s.sort(group)
    ext = s.common_right(order[:-1], order[1:])
    near = group[order[:-1]] == group[order[1:]]
    if not s.verified(order[:-1][near], order[1:][near], np.zeros(near.sum(), np.int64), ext[near]):
        order, ext = s.exact(group)
    ext = np.where(group[order[:-1]] == group[order[1:]], ext, 0)
    out: list[tuple[int, int, int]] = []
    n = len(order)
    for way in (1, -1):
        slot = np.flatnonzero(alone[order])
        right, best, step = s.right[order[slot]].copy(), np.full(len(slot), -1), 0
        while len(slot):
            step += 1
            other = slot + way * step
            inside = (other >= 0) & (other < n)
            slot, right, best, other = slot[inside], right[inside], best[inside], other[inside]
            right = np.minimum(right, ext[other - 1] if way == 1 else ext[other])
            i, j = order[slot], order[other]
            live = right + s.left[i] >= length
            slot, right, best, i, j = slot[live], right[live], best[live], i[live], j[live]
            left = s.common_left(i, j)
            for x in np.flatnonzero((left > best) & (left + right >= length)).tolist():
                a, b, m, r = int(s.at[i[x]]), int(s.at[j[x]]), int(left[x]), int(right[x])
                while m >= 0 and s.data[a - m : a] != s.data[b - m : b]:  # a collision: the true extension is shorter
                    m -= 1
                if m + r >= length:
                    out.append((int(i[x]), m, r))
            best = np.maximum(best, left)
            go = best < s.left[i]
            slot, right, best = slot[go], right[go], best[go]
    return out


def _sorter(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, size = Powers(), [], 0

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            found = repeats(frame["h"].to_numpy(), frame["bytes"].tolist(), frame["before"].to_numpy(), (frame["n"] == 1).to_numpy(), powers, length)
            who = [x[0] for x in found]
            place = frame["place"].to_numpy()[who] if who else np.empty(0, np.int64)
            return pd.DataFrame({KEY: frame[KEY].to_numpy()[who], "lo": place - [x[1] for x in found], "hi": place + [x[2] for x in found]}, dtype="int64")

        for batch in batches:  # sorted by h: a group is over when the next begins
            for at in range(0, len(batch), 1000):
                held.append(batch.iloc[at : at + 1000])
                size += len(held[-1])
                if size >= 2000 and held[-1]["h"].iat[-1] != held[0]["h"].iat[0]:
                    frame = pd.concat(held, ignore_index=True)
                    cut = int(np.searchsorted(frame["h"].to_numpy(), frame["h"].iat[-1]))
                    yield done(frame.iloc[:cut].reset_index(drop=True))
                    held, size = [frame.iloc[cut:]], len(frame) - cut
        if size:
            yield done(pd.concat(held, ignore_index=True))

    return run


_KEPT = pa.schema(
    [
        (KEY, pa.int64()),
        ("id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("removed", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
    ]
)


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, i, raw, spans in zip(batch.column(KEY).to_pylist(), batch.column("id").to_pylist(), raw_texts(batch.column("text")), batch.column("spans"), strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in spans.as_py() or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            kept = hashlib.sha256()
            at = 0
            for lo, hi in merged:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            out.append((key, i, len(raw), sum(hi - lo for lo, hi in merged), len(merged), kept.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged]))
        if out:
            yield _table(out, _KEPT)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, key: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and ``removed``, the byte spans.

    ``key`` names a column of unique longs, if ``docs`` has one.
    """
    texts = key_id_text(docs, id_col, text_col, key)
    found = texts.select(KEY, "text").mapInArrow(_finder(length, gram), f"{KEY} long, h long, place long, first long, last long, context binary")
    found = materialize(found, "anchors")
    # aggregates are written before their join, which then reads plain shuffles, so that AQE can split a hot gram
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "grams")
    again = materialize(found.join(twice.hint("merge"), "h").withColumn("before", F.col("place") - F.col("first")), "repeated")
    same = ["h", "context", "before"]
    spot = F.struct(KEY, "place", "first", (F.col("last") + length).alias("end"))
    classes = materialize(again.groupBy(*same).agg(F.count("*").alias("n"), F.min(spot).alias("one")), "classes")
    whole = again.join(classes.where("n > 1").select(*same).hint("merge"), same, "left_semi").select(KEY, F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))

    several = materialize(classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
    want = classes.join(several.hint("merge"), "h").select(
        F.col(f"one.{KEY}").alias(KEY), F.struct("h", "one.place", "one.first", "one.end", "n", (F.col("m") > hot).alias("hot")).alias("w")
    )
    want = materialize(want.groupBy(KEY).agg(F.collect_list("w").alias("wanted")), "wanted")  # at most an anchor every byte of one text
    by_key = texts.repartition(KEY)  # one shuffle of the texts for both joins below, which take the same columns
    context = by_key.join(want.hint("merge"), KEY).select(KEY, "id", "text", "wanted").mapInArrow(_fetch, _CONTEXT_KIND)
    large = None
    if several.where(F.col("m") > hot).take(1):
        context = materialize(context, "contexts")
        large = context.where("hot")
    spans = [whole]

    def sort(rows: DataFrame) -> None:
        spans.append(rows.repartition("h").sortWithinPartitions("h").mapInPandas(_sorter(length), f"{KEY} long, lo long, hi long"))

    sort(context.where("NOT hot").select(KEY, "h", "place", "before", "n", "bytes"))
    width = length - gram + 1
    while large is not None:
        width = -(-width // PARTS)
        part = materialize(large.select(KEY, "h", "place", "before", "n", "bytes").mapInArrow(_splitter(length, width), f"{KEY} long, h long, place long, before long, n long, bytes binary, context binary"), "parts")
        one = F.min(F.struct(KEY, "place", "bytes")).alias("one")
        kinds = materialize(part.groupBy(*same).agg(F.sum("n").alias("n"), F.count("*").alias("k"), one), "kinds")
        span = (KEY, (F.col("place") - F.col("before")).alias("lo"), (F.col("place") - F.col("before") + F.octet_length("bytes")).alias("hi"))
        spans.append(part.join(kinds.where("k > 1").select(*same).hint("merge"), same, "left_semi").select(*span))
        several = materialize(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
        left = kinds.join(several.hint("merge"), "h").select(f"one.{KEY}", "h", "one.place", "before", "n", "one.bytes", (F.col("m") > hot).alias("hot"))
        left = materialize(left, "contexts")
        sort(left.where("NOT hot").drop("hot"))
        large = left.where("hot") if width > 1 and several.where(F.col("m") > hot).take(1) else None
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    every = every.groupBy(KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = by_key.join(every.hint("merge"), KEY, "left").select(KEY, "id", "text", "spans").mapInArrow(
        _remover, f"{KEY} long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>"
    )
    return out.withColumnRenamed("id", id_col)


def _marker(gram: int, window: int):
    """Distinct winnowed hashes of runs of ``gram`` words: the least of every ``window`` neighbours."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), {}
        for batch in batches:
            keys, marks, held = [], [], 0
            for key, raw in zip(batch.column(KEY).to_pylist(), raw_texts(batch.column("text")), strict=True):
                words = raw.split()
                if len(words) < gram + window - 1:
                    continue
                if len(known) > 100_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                sums = powers.prefix(np.array([known[w] for w in words], np.uint64))
                h = _stir((sums[gram:] - sums[:-gram]) * powers.down[: len(words) - gram + 1])
                least = np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))
                keys.append(np.full(len(least), key))
                marks.append(least.view(np.int64))
                held += len(least)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], names=[KEY, "mark"])
                    keys, marks, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], names=[KEY, "mark"])

    return mark


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51, gram: int = 38, key: str | None = None) -> DataFrame:
    """(``_row_key``, n_shared) of the rows whose text shares a passage with another row's: ``n_shared`` counts the
    fingerprints that do. Every common passage of ``words`` words has one, none is shorter than ``gram`` words.

    A report beside the byte-exact removal: passages shorter than its ``length`` bytes are named here, and not cut.
    """
    texts = key_id_text(docs, id_col, text_col, key)
    marks = materialize(texts.select(KEY, "text").mapInArrow(_marker(gram, words - gram + 1), f"{KEY} long, mark long"), "marks")
    shared = marks.groupBy("mark").agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).where("lo < hi").select("mark")
    shared = materialize(shared, "shared")  # the join then reads plain shuffles, which AQE can split
    return marks.join(shared.hint("merge"), "mark").groupBy(KEY).agg(F.count("*").alias("n_shared"))
