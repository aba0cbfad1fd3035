"""Operator 1, LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history), where a class that is too large for one softmax is
factored again in the same way:

* The root has ``width`` slots: half of them the end token and the most frequent words, the others classes of the
  remaining words by a hash of their last two bytes.
* A class has ``width`` slots: half of them its most frequent words, the others subclasses by a hash of the word.
* A subclass has ``width`` slots: its most frequent words, and one slot for the rest, seen or not. Within that rest
  a word has its smoothed share, (c + 1) / (N_rest + V_rest + 1), which leaves one share for unseen words.

Each softmax is log-linear: a slot's log frequency, plus hashed features of the history. At the root these are the
word before, the word two back (a skip feature), the classes of the two words before (an n-gram), and the classes one
and three back (a skip-gram); in a class or subclass the word before and the word two back, each hashed with the class.
Every word, frequent or not, is a feature under its own hash.

What is gathered grows with the corpus: counts of all words; ``width`` with the logarithm of the vocabulary, so that
the number of words with weights of their own (width ** 3 / 4) and the rows of weights (about 8 * sqrt of the
vocabulary) grow with it.

Training: word counts over all training texts by partial sums; then ``ROUNDS`` rounds that together read every
training text once. In a round each part of about ``PART_TOKENS`` tokens (however large the cluster is) starts from the
current weights, makes sparse mini-batch gradient updates over its texts, and hands on the rows that it touched; these
are averaged, weighted by use, in Spark, and the driver gets the one table of weights.

Scoring: sparse numpy batches over whole texts. Counts of the ``HEAD`` most frequent words (a bound, so they are
broadcast) are looked up in place; all other tokens go through an equi-join with the count table. The frequent
words being out of that join, no key in it is hot.

Edge cases: a null text is empty: its only token is the end; a null id is scored and learnt from; without training
texts every probability is uniform over what is known; repeated rows are scored and learnt from each; very long texts
are read whole, in one batch of numbers each; only the id and text columns and those of ``held_out`` are read, so
further columns of any name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import KEY, materialize, raw_texts

HEAD, LEAST_WIDTH, LEAST_BUCKETS = 400_000, 32, 1 << 14
ROUNDS, BATCH, PART, RATE, PART_TOKENS = 2, 8192, 512, 0.3, 5_000_000
END = b""
_START = np.uint64(0x5851F42D4C957F2D)  # before the first word


def width_of(vocabulary: int) -> int:
    return max(LEAST_WIDTH, 8 * math.ceil(math.log2(vocabulary + 2) / 5))


def buckets_of(vocabulary: int) -> int:
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(8 * math.sqrt(vocabulary + 1))))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    out = raw.lower().split()
    out.append(END)
    return out


def mark_of(word: bytes) -> int:
    return zlib.crc32(word)


def class_of(word: bytes, half: int) -> int:
    return zlib.crc32(word[-2:]) % half


def subclass_of(mark: int | np.ndarray, half: int) -> int | np.ndarray:
    return (mark >> 7) % half


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    done = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
    for batch in batches:
        for raw in raw_texts(batch.column("text")):
            seen.update(words_of(raw))
            if len(seen) > 200_000:
                yield done()
                seen.clear()
    if seen:
        yield done()


def _cell_sums(half: int):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(half * half, np.int64), np.zeros(half * half, np.int64)
        for batch in batches:
            cell = np.array([class_of(w, half) * half + subclass_of(mark_of(w), half) for w in batch["word"]], np.int64)
            n += np.bincount(cell, batch["c"].to_numpy(), half * half).astype(np.int64)
            v += np.bincount(cell, minlength=half * half)
        yield pd.DataFrame({"cell": np.arange(half * half), "n": n, "v": v})

    return sums


class Tree:
    """Slots of the head words (most frequent first) and the log frequencies of all slots.

    Node 0 is the root, 1 + k the class k, 1 + half + k * half + j the subclass j of k. ``slots`` has three columns:
    the slot at the root, in the class (-1: none) and in the subclass (-1: none).
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, n: np.ndarray, v: np.ndarray, width: int):
        """``n`` and ``v``: tokens and distinct words of each (class, subclass) over all counted words."""
        self.width, half = width, width // 2
        self.words, self.counts, self.half = words, counts, half
        self.marks = np.array([mark_of(w) for w in words], np.int64)
        kind = np.array([class_of(w, half) for w in words], np.int64)
        sub = subclass_of(self.marks, half).astype(np.int64) if len(words) else kind
        slots = np.full((len(words), 3), -1, np.int64)
        single = [i for i, w in enumerate(words) if w == END][:1]
        single += [i for i in range(min(half + 1, len(words))) if i not in single][: half - len(single)]
        slots[single, 0] = np.arange(len(single))
        rest = np.setdiff1d(np.arange(len(words)), single)  # ascending: most frequent first
        slots[rest, 0] = half + kind[rest]
        nth = _place(kind[rest])
        top = nth < half
        slots[rest[top], 1] = nth[top]
        rest = rest[~top]
        slots[rest, 1] = half + sub[rest]
        nth = _place(kind[rest] * half + sub[rest])
        slots[rest, 2] = np.minimum(nth, width - 1)  # the last slot is the rest
        self.slots = slots
        cell = kind * half + sub
        own = slots[:, 2] < width - 1  # has a slot of its own
        n_rest, v_rest = n.copy(), v.copy()
        np.subtract.at(n_rest, cell[own], counts[own])
        np.subtract.at(v_rest, cell[own], 1)
        self.norm = np.log10(n_rest + v_rest + 1.0)
        slot_n = np.zeros((1 + half + half * half, width))
        deep = np.flatnonzero(slots[:, 2] >= 0)
        own_deep = deep[own[deep]]
        np.add.at(slot_n, (1 + half + cell[own_deep], slots[own_deep, 2]), counts[own_deep])
        slot_n[1 + half :, width - 1] += n_rest
        middle = np.flatnonzero((slots[:, 1] >= 0) & (slots[:, 2] < 0))
        np.add.at(slot_n, (1 + kind[middle], slots[middle, 1]), counts[middle])
        slot_n[1 : 1 + half, half:] += slot_n[1 + half :].sum(axis=1).reshape(half, half)
        slot_n[0, slots[single, 0]] = counts[single]
        slot_n[0, half:] += slot_n[1 : 1 + half].sum(axis=1)
        used = np.zeros(slot_n.shape, bool)  # slots without a word have no probability
        used[0, slots[single, 0]] = used[: 1 + half, half:] = used[1 + half :, width - 1] = True
        used[1 + kind[middle], slots[middle, 1]] = used[1 + half + cell[own_deep], slots[own_deep, 2]] = True
        slot_n = np.where(used, slot_n + 1, 0)
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(slot_n / slot_n.sum(axis=1, keepdims=True)), -1e4).astype(np.float32)


def _place(group: np.ndarray) -> np.ndarray:
    """Of each row its place among the rows of its group, in order."""
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(sorted_, sorted_)
    return out


class Reader:
    """Texts as arrays: the softmax decisions of their tokens at each level, with hashed features."""

    def __init__(self, tree: Tree, buckets: int):
        self.tree, self.shift = tree, np.uint64(65 - buckets.bit_length())
        self.number = dict(zip(tree.words, range(len(tree.words)), strict=True))
        self.slots = np.vstack([tree.slots, np.full((1, 3), -1, np.int64)])
        self.marks = np.append(tree.marks, 0)

    def _rows(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(features[0]), len(features)), np.int64)
        for i, m in enumerate(features):
            m = m * np.uint64(0x9E3779B97F4A7C15)
            m ^= m >> np.uint64(29)
            m *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, i] = m >> self.shift
        return out

    def read(self, raw: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """(words, tokens of each text, head numbers, slots, levels), a level being (tokens, nodes, rows, slots)."""
        tree, half, words, size = self.tree, self.tree.half, [], np.empty(len(raw), np.int64)
        for i, t in enumerate(raw):
            w = words_of(t)
            size[i] = len(w)
            words += w
        get = self.number.get
        at = np.array([get(w, -1) for w in words], np.int64)
        slots, marks = self.slots[at], self.marks[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            marks[miss] = [mark_of(words[i]) for i in miss.tolist()]
            slots[miss, 0] = [half + class_of(words[i], half) for i in miss.tolist()]
            slots[miss, 1] = half + subclass_of(marks[miss], half)
            slots[miss, 2] = tree.width - 1
        nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)  # place in its text

        def back(values: np.ndarray, k: int, start: np.uint64) -> np.ndarray:
            out = np.full(len(values), start, np.uint64)
            out[k:] = values[: len(values) - k]
            out[nth < k] = start
            return out

        mark, kind, wide = marks.astype(np.uint64), slots[:, 0].astype(np.uint64), np.uint64(tree.width)
        one, two, three = (back(kind, k, wide) for k in (1, 2, 3))
        near, far = back(mark, 1, _START), back(mark, 2, _START)
        far = far ^ np.uint64(0xA0761D6478BD642F)
        pair = lambda a, b, salt: a * np.uint64(1024) + b + np.uint64(salt << 40)
        levels = [(np.arange(len(at)), np.zeros(len(at), np.int64), self._rows([near, far, pair(one, two, 1), pair(one, three, 2)]), slots[:, 0])]
        for depth in (1, 2):
            who = np.flatnonzero(slots[:, depth] >= 0)
            node = 1 + slots[who, 0] - half
            if depth == 2:
                node = 1 + half + (slots[who, 0] - half) * half + slots[who, 1] - half
            salt = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            levels.append((who, node, self._rows([near[who] + salt, far[who] + salt]), slots[who, depth]))
        return words, size, at, slots, levels


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row of features the slots' sums, less the greatest. ``bias``: a row of slots, or one for each row."""
    z = weights.take(rows[:, 0], axis=0)
    for i in range(1, rows.shape[1]):
        z += weights.take(rows[:, i], axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log probability of each row's slot ``y``."""
    z = logits(weights, bias, rows)
    own = z[np.arange(len(y)), y]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def update(weights: np.ndarray, power: np.ndarray, used: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """One sparse mini-batch step: each row of weights moves against its gradient, scaled by what it has met so far."""
    g = logits(weights, bias, rows)
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(y)), y] -= 1
    short = np.uint16 if len(weights) <= 1 << 16 else np.int64  # a radix sort where it fits
    for i in range(rows.shape[1]):
        order = np.argsort(rows[:, i].astype(short), kind="stable")
        key = rows[order, i]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(g.take(order, axis=0), first, axis=0)
        hit = key[first]
        used[hit] += np.diff(np.append(first, len(key)))
        power[hit] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        total *= (RATE / 4 / np.sqrt(power[hit]))[:, None]
        weights[hit] -= total


def _parts(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def _trainer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights = shared.value
        reader, weights = Reader(tree, len(weights)), weights.astype(np.float32)
        power, used = np.full(len(weights), 1e-3, np.float32), np.zeros(len(weights), np.int64)
        for batch in batches:
            for part in _parts(raw_texts(batch.column("text")), 200_000):
                for _, node, rows, y in reader.read(part)[4]:
                    for b in range(0, len(y), BATCH):
                        bias = tree.bias[0] if len(node) and node[0] == 0 else tree.bias.take(node[b : b + BATCH], axis=0)
                        update(weights, power, used, bias, rows[b : b + BATCH], y[b : b + BATCH])
        out = []
        for at in range(0, len(weights), PART):
            hit = np.flatnonzero(used[at : at + PART]) + at
            if len(hit):
                out.append((at, hit.astype("<i4").tobytes(), used[hit].astype("<i8").tobytes(), weights[hit].astype("<f2").tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(_TRAINED.names, x, strict=True)) for x in out], _TRAINED)

    return train


_TRAINED = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("used", pa.binary()), ("weights", pa.binary())])


def _averager(width: int):
    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Mean of what tasks made of each row, weighted by how often they met it; a running sum for each part."""
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, rows, used, weights in batch[["part", "rows", "used", "weights"]].itertuples(index=False):
                s = sums.setdefault(part, [np.zeros(PART, np.float64), np.zeros((PART, width), np.float64)])
                r, n = np.frombuffer(rows, "<i4") - part, np.frombuffer(used, "<i8").astype(np.float64)
                s[0][r] += n
                s[1][r] += n[:, None] * np.frombuffer(weights, "<f2").astype(np.float64).reshape(len(r), width)
        out = [(p, (s[0] > 0).tobytes(), (s[1] / np.maximum(1, s[0])[:, None]).astype("<f4").tobytes()) for p, s in sums.items()]
        yield pd.DataFrame(out, columns=["part", "hit", "weights"])

    return average


def token_scores(tree: Tree, weights: np.ndarray, number: np.ndarray, slots: np.ndarray, levels: list[tuple]) -> np.ndarray:
    """log10 probability of each token, but for log10(c + 1) of tokens that are not in the head."""
    out = np.zeros(len(number))
    for who, node, rows, y in levels:
        for b in range(0, len(y), BATCH):
            some = y[b : b + BATCH]
            bias = tree.bias[0] if len(node) and node[0] == 0 else tree.bias.take(node[b : b + BATCH], axis=0)
            out[who[b : b + BATCH]] += log_softmax(weights, bias, rows[b : b + BATCH], some)
    out /= np.log(10)
    rest = np.flatnonzero(slots[:, 2] == tree.width - 1)
    out[rest] -= tree.norm[(slots[rest, 0] - tree.half) * tree.half + slots[rest, 1] - tree.half]
    known = rest[number[rest] >= 0]
    out[known] += np.log10(tree.counts[number[known]] + 1.0)
    return out


_SCORED = pa.schema(
    [(KEY, pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("seen", pa.float64()), ("shape", pa.float64()), ("rest", pa.list_(pa.binary()))]
)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights = shared.value
        reader, logs = Reader(tree, len(weights)), np.append(np.log10(tree.counts + 1.0), 0.0)
        for batch in batches:
            at = 0
            for part in _parts(raw_texts(batch.column("text")), 500_000):
                words, size, number, slots, levels = reader.read(part)
                first = np.cumsum(size) - size
                total = lambda x, first=first: pa.array(np.add.reduceat(x, first))
                miss = np.flatnonzero(number < 0)
                cut = np.searchsorted(miss, np.append(first, len(number))).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cut), pa.array([words[i] for i in miss.tolist()], pa.binary()))
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [own.column(KEY), own.column("id"), own.column("held_out"), pa.array(size), total((number >= 0).astype(np.int64)), total(logs[number]), total(token_scores(tree, weights, number, slots, levels)), rest],
                    schema=_SCORED,
                )

    return score


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD, width: int | None = None) -> DataFrame:
    """Learn from the rows where ``held_out`` is false; score all. One row per row: id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams), score (this model), both log10."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias(KEY), F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where("NOT held_out").select("text")

    counts = materialize(train.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    # the head: all words above a count that at most ``head_words`` reach; counts fall into some 1000 bins at most
    level = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r["l"], r["count"], r["s"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("count"), F.sum("c").alias("s")).collect()), reverse=True)
    total, kinds_of = sum(b[2] for b in bins), sum(b[1] for b in bins)
    floor, held = 1 << 20, 0
    for at, n, _ in bins:
        if held + n > head_words:
            break
        floor, held = at, held + n
    top = sorted(((int(r["c"]), bytes(r["word"])) for r in counts.where(level >= floor).collect()), key=lambda x: (-x[0], x[1]))
    width = width or width_of(kinds_of)
    half = width // 2
    n, v = np.zeros(half * half, np.int64), np.zeros(half * half, np.int64)
    for r in counts.mapInPandas(_cell_sums(half), "cell int, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["cell"]], v[r["cell"]] = r["n"], r["v"]
    tree = Tree([w for _, w in top], np.array([c for c, _ in top], np.int64), n, v, width)

    weights = np.zeros((buckets_of(kinds_of), width), np.float32)
    for turn in range(ROUNDS if total else 0):
        shared = spark.sparkContext.broadcast((tree, weights))
        some = train.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).coalesce(-(-total // PART_TOKENS))
        made = some.mapInArrow(_trainer(shared), "part int, rows binary, used binary, weights binary").repartition("part")
        weights = weights.copy()
        for r in made.mapInPandas(_averager(width), "part int, hit binary, weights binary").collect():  # the table of weights
            hit = np.frombuffer(r["hit"], bool)
            weights[r["part"] : r["part"] + PART][hit] = np.frombuffer(r["weights"], "<f4").reshape(PART, width)[hit]
        shared.unpersist()

    shared = spark.sparkContext.broadcast((tree, weights))
    kind = f"{KEY} long, id long, held_out boolean, n_tokens long, known long, seen double, shape double, rest array<binary>"
    scored = materialize(rows.mapInArrow(_scorer(shared), kind), "scored")
    shared.unpersist()
    rare = scored.select(KEY, F.explode("rest").alias("word")).join(counts.where(level < floor), "word")
    rare = rare.groupBy(KEY).agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("found"))
    both = scored.drop("rest").join(rare, KEY, "left")
    found = F.coalesce("found", F.lit(0.0))
    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("seen") + found - F.col("n_tokens") * F.log10(F.lit(float(total + kinds_of + 1)))).alias("base_score"),
        (F.col("shape") + found).alias("score"),
    )
