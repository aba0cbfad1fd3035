"""Operator 5, packing token sequences by non-negative least squares.

1. One Arrow pass tokenizes each whole text and cuts it into full windows and one remainder, with the checksum of
   each piece; token ids themselves are not shuffled or stored.
2. The histogram of piece lengths (at most ``WINDOW`` rows) goes to the driver. Shallow combinations of two to four
   lengths that fill a window exactly are enumerated; non-negative least squares solves how often each should be
   used to match the histogram; the counts are rounded down to what the histogram holds; the residual is packed
   greedily, longest first, each time as often as the lengths last. Work and result are bounded by the window.
3. Pieces of a length are ranked (by buckets of a hash, so that a length that holds a third of all rows is many
   small groups), and the rank says which slot of which sequence a piece takes.

Edge cases: null and empty texts are the one id 0; very long texts are tokenized whole and cut into as many pieces as
they fill; repeated rows are packed each; null ids are kept; special-token strings in a
text are ordinary text; an empty table gives an empty result; of the input only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import batched, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.llm.common import KEY, materialize, raw_texts

WINDOW, BUCKETS, BUCKET_ROWS = 1024, 64, 200_000
KEEP_FIRST, KEEP_LATER, ENCODE_AT_ONCE = 500_000, 200_000, 4096
#: Bytes of texts, characters of a segment and words of a dictionary that are taken at a time.
TEXTS_AT_ONCE, SEGMENT, WORDS_AT_ONCE = 4_000_000, 4_000_000, 1_000_000

#: Texts of these characters only are split into words here as the tokenizer's own rule does; others go to it whole.
_PLAIN = "\t\n\r\x20-\x7e¡«»¿-ɏ"
_OTHER = re.compile(f"[^{_PLAIN}]")
#: The rule always begins a word at a space with another character right after it, so texts may be cut there.
_CUT = re.compile(r" (?=\S)")
_END = "\0"  # after each segment; no plain text has it
_END_KIND, _SPACE, _BLANK, _LETTER, _DIGIT, _SIGN = range(6)


def _kind(c: str) -> int:
    if c in "\0 \t\n\r":
        return _END_KIND if c == _END else _SPACE if c == " " else _BLANK
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN


_KIND = np.array([_kind(chr(c)) for c in range(ord("ɏ") + 1)], np.uint8)


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _word_starts(codes: np.ndarray) -> np.ndarray:
    """Where words begin in plain segments, each with an end after it, by the tokenizer's rule: runs of letters, digits or
    signs with a space before them, 's 't 're 've 'm 'll 'd, and other white space but the last before a visible sign."""
    kind = _KIND[codes]
    visible = kind >= _LETTER
    blank = (kind == _SPACE) | (kind == _BLANK)
    begins = np.ones(len(codes), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & visible[1:]
    begins[1:] |= blank[1:] & ~blank[:-1]
    begins[:-1] |= blank[:-1] & visible[1:]
    begins |= kind == _END_KIND
    at = np.flatnonzero((codes == ord("'")) & begins)
    after = codes[at + 1]
    short = at[np.isin(after, [ord(c) for c in "stmd"])]
    at, after = at[kind[at + 1] == _LETTER], after[kind[at + 1] == _LETTER]
    third = codes[at + 2]
    long = at[((third == ord("e")) & ((after == ord("r")) | (after == ord("v")))) | ((third == ord("l")) & (after == ord("l")))]
    begins[short + 1] = begins[long + 1] = False
    begins[short + 2] = begins[long + 3] = True
    return np.flatnonzero(begins)


class TokenBytes:
    """Token ids of a text as little-endian 32-bit words.

    Words are found in the code points of many texts at a time, and Arrow numbers the distinct ones; only those are
    looked up among the words seen before, of which the first ones stay and later ones leave in the order in which they
    came. New words are encoded many at a time as one text, whose ids are dealt out by the bytes that each stands for.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]  # a character for each byte
        self.known: dict[str, bytes] = {_END: b""}
        self.later: deque[list[str]] = deque()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encode_words(self, words: tuple[str, ...]) -> list[bytes]:
        # a line feed before a word without a space parts it from the one before
        parts = [p for w in words for p in (("", w) if w[0] == " " else ("\n", w))]
        raw = self._encode("".join(parts))
        borders = np.cumsum([0, *(len(p) if p.isascii() else len(p.encode()) for p in parts)])
        ends = np.concatenate(([0], np.cumsum(self.width[np.frombuffer(raw, "<u4")])))
        at = np.searchsorted(ends, borders)
        if at[-1] == len(ends) or (ends[at] != borders).any():
            raise ValueError("a token lies across the border of two words")
        return [raw[a:b] for a, b in zip((4 * at[1::2]).tolist(), (4 * at[2::2]).tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        spaces = [w for w in words if w.isspace()]
        self.known.update(zip(spaces, map(self._encode, spaces), strict=True))
        for some in batched((w for w in words if not w.isspace()), ENCODE_AT_ONCE):
            self.known.update(zip(some, self._encode_words(some), strict=True))
        if len(self.known) > KEEP_FIRST:
            self.later.append(words)

    def _ids(self, raw: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of UTF-16 text between neighbouring ``borders``, end to end, and how many each word has."""
        words = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(2 * borders), pa.py_buffer(raw)]).dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        text, at = data.to_pybytes().decode("utf-16-le"), (np.frombuffer(offsets, np.int64)[: len(words.dictionary) + 1] // 2).tolist()
        distinct = [text[a:b] for a, b in pairwise(at)]
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        found = list(map(self.known.__getitem__, distinct))
        while self.later and len(self.known) > KEEP_FIRST + KEEP_LATER:
            for w in self.later.popleft():
                del self.known[w]
        which = words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[which]
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.frombuffer(b"".join(found), "<u4")[places], n

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [None if _OTHER.search(t) else list(_segments(t)) for t in texts]
        raw = "".join(s + _END for p in cut if p is not None for s in p).encode("utf-16-le")
        codes = np.frombuffer(raw, "<u2")
        borders = np.append(_word_starts(codes), len(codes))
        made = [self._ids(raw, borders[at : at + WORDS_AT_ONCE + 1]) for at in range(0, len(borders) - 1, WORDS_AT_ONCE)]
        ids = b"".join(x.tobytes() for x, _ in made)
        upto = 4 * np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in made)]))
        ends = iter(upto[codes[borders[:-1]] == 0].tolist())
        out, at = [], 0
        for t, p in zip(texts, cut, strict=True):
            if p is None:
                out.append(self._encode(t))
            else:
                *_, end = islice(ends, len(p))
                out.append(ids[at:end])
                at = end
        return out


_TOKENS: dict[str, TokenBytes] = {}


def _tokens(path: str) -> TokenBytes:
    """One for each Python worker and file, so that later tasks of a worker find its words known."""
    if path not in _TOKENS:
        _TOKENS[path] = TokenBytes(path)
    return _TOKENS[path]


_PIECES = pa.schema([(KEY, pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _cutter(path: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)

        def pieces(keys: list[int], ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            out: list[tuple] = []
            for k, i, raw in zip(keys, ids, tokens.of(texts), strict=True):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start : 4 * (start + window)]
                    out.append((k, i, start, len(part) // 4, zlib.crc32(part), n))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PIECES)

        for batch in batches:
            keys, ids, texts, held = batch.column(KEY).to_pylist(), batch.column("id").to_pylist(), [], 0
            for at, raw in enumerate(raw_texts(batch.column("text")), 1):
                texts.append(raw.decode("utf-8", "replace"))
                held += len(raw)
                if held >= TEXTS_AT_ONCE or at == len(keys):
                    yield pieces(keys[at - len(texts) : at], ids[at - len(texts) : at], texts)
                    texts, held = [], 0

    return cut


def combinations(window: int, step: int = 8) -> np.ndarray:
    """Rows of four lengths (0: none) that add up to ``window``: all pairs, triples and fours on a grid."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, 0 * a, 0 * a], axis=1)
    g = np.arange(step, window, step)
    x, y = np.meshgrid(g, np.arange(1, window), indexing="ij")
    keep = (x + y < window) & (y <= window - x - y)
    triples = np.stack([x[keep], y[keep], window - x[keep] - y[keep], 0 * x[keep]], axis=1)
    g = np.arange(4 * step, window, 4 * step)
    x, y, z = np.meshgrid(g, g, np.arange(step, window, step), indexing="ij")
    keep = (x <= y) & (x + y + z < window) & (z <= window - x - y - z)
    fours = np.stack([x[keep], y[keep], z[keep], window - x[keep] - y[keep] - z[keep]], axis=1)
    return np.unique(np.sort(np.concatenate([pairs, triples, fours]), axis=1), axis=0)


def solve(sets: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error against the histogram, by accelerated projected gradient."""
    size = len(histogram)
    flat = sets.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        u = np.bincount(flat, np.repeat(x, sets.shape[1]), minlength=size)
        u[0] = 0
        return u

    v = np.ones(len(sets))
    for _ in range(20):  # largest eigenvalue
        v = used(v)[sets].sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(sets))
    t = 1.0
    for _ in range(rounds):
        miss = used(y) - histogram
        miss[0] = 0
        z = np.maximum(0, y - miss[sets].sum(1) / (1.1 * norm))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, repeats) pairs, count), ...] that uses up ``histogram`` (index: length) exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if left[window]:
        out.append(([(window, 1)], int(left[window])))
        left[window] = 0
    sets = combinations(window)
    sets = sets[(left[sets] > 0)[:, :].astype(int).sum(1) + (sets == 0).sum(1) == sets.shape[1]]
    if len(sets):
        x = solve(sets, left[:window].astype(float))
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            lengths, uses = np.unique(sets[p][sets[p] > 0], return_counts=True)
            times = int(min(np.floor(x[p]), (left[lengths] // uses).min()))
            if times:
                left[lengths] -= uses * times
                out.append(([(int(a), int(b)) for a, b in zip(lengths, uses, strict=True)], times))
    while left.any():  # longest first, then always the longest that still fits
        room, pattern, rest = window, [], left.copy()
        while room and (fit := np.flatnonzero(rest[: room + 1])).size:
            n = int(fit[-1])
            uses = int(min(rest[n], room // n))
            pattern.append((n, uses))
            room -= n * uses
            rest[n] = 0
        times = min(int(left[n]) // uses for n, uses in pattern)
        for n, uses in pattern:
            left[n] -= uses * times
        out.append((pattern, times))
    return out


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset, repeats), by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n, uses in pattern:
            out.setdefault(n, []).append((taken.get(n, 0), sequence, offset, uses))
            taken[n] = taken.get(n, 0) + uses * times
            offset += n * uses
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # numbered in the one pass that reads the texts: all that follows reads the written pieces
    texts = docs.select(F.monotonically_increasing_id().alias(KEY), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = f"{KEY} long, id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(texts.mapInArrow(_cutter(tokenizer_path, window), kinds), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most one row per length
        histogram[r["length"]] = r["count"]
    where = slots(plan(histogram, window))
    buckets = max(BUCKETS, int(histogram.sum()) // BUCKET_ROWS)

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy(KEY, "start")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, sequence, offset = batch["rank"].to_numpy(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n, at in batch.groupby("length").indices.items():
                first, seq, off, uses = where[int(n)].T
                i = np.searchsorted(first, rank[at], side="right") - 1
                own = rank[at] - first[i]
                sequence[at], offset[at] = seq[i] + own // uses[i], off[i] + own % uses[i] * n
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    out = ranked.mapInPandas(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
