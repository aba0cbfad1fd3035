"""Operator 4, quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes. Every passage of the whole text is encoded (frequencies
of byte-class pairs, how well it compresses, its length) and embedded; gated attention weights the passages of a
document; a logistic unit scores the weighted sum. Only the document's label trains encoder, attention and scorer.

Training takes at most ``SAMPLE_DOCS`` labelled documents and ``SAMPLE_PASSAGES`` passages in all, the first by a hash
of the id among those that are documents of the table: the one bounded sample here. Scoring reads every whole text in
Arrow batches, with no shuffle; only the text goes to Python and only the score comes back.

Edge cases: null and empty texts are one empty passage and get a score; very long texts are scored whole, in runs of passages that are folded into one attention, but one of
more than ``SAMPLE_PASSAGES`` passages is not learnt from; a label row that is null, repeated or has no document is
ignored (of repeated labels the least counts); without labels of both classes the score is the share of label 1, or
1.0 without any; repeated rows are scored each; columns of any other name stay as they are; an empty table gives an
empty result.
"""

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import free_name, raw_texts

PASSAGE, SAMPLE_DOCS, SAMPLE_PASSAGES = 512, 3000, 40_000
#: Bytes from which a text is encoded in runs of passages.
LONG, RUN = 1 << 20, 2048
HIDDEN, ATTENTION, EPOCHS, BATCH = 32, 16, 20, 64
THRESHOLD = 0.3

#: Classes of bytes; what is named nowhere is "other".
_GROUPS = [" ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "$", "%", "&", "#", "*", "|", "@/\\:", "<>", "()[]{}", "\"'`", "-_", ";=+~^", "\t\r\x0b\x0c"]
_OTHER, _LEAD, _TAIL, _END = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2, len(_GROUPS) + 3
KINDS = _END + 1
CLASS = np.full(256, _OTHER, np.int32)
for _i, _g in enumerate(_GROUPS):
    CLASS[[ord(c) for c in _g]] = _i
CLASS[0x80:0xC0], CLASS[0xC0:] = _TAIL, _LEAD
PAIRS = KINDS * KINDS
WIDTH = PAIRS + 3


def encode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (float32, one row each) and the first row of each text."""
    size = np.array([len(b) for b in raw], dtype=np.int64)
    parts = np.maximum(1, np.rint(size / PASSAGE).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    own = np.repeat(np.arange(len(raw)), parts)
    nth = np.arange(len(own)) - first[own]
    lo, hi = nth * size[own] // parts[own], (nth + 1) * size[own] // parts[own]
    joined = np.frombuffer(b"".join(b + b"\0" for b in raw), np.uint8)
    kind = CLASS[joined]
    ends = np.cumsum(size + 1) - 1
    kind[ends] = _END
    pair = np.append(kind[:-1] * KINDS + kind[1:], 0)
    pair[ends] = PAIRS  # from one text to the next: not counted
    span = hi - lo + (nth == parts[own] - 1)
    cell = np.repeat(np.arange(len(own)) * (PAIRS + 1), span) + pair
    counts = np.bincount(cell, minlength=len(own) * (PAIRS + 1)).reshape(len(own), PAIRS + 1)[:, :PAIRS]
    x = np.empty((len(own), WIDTH), np.float32)
    x[:, :PAIRS] = np.sqrt(counts / np.maximum(1, hi - lo)[:, None]) * 4
    squeezed = [len(zlib.compress(raw[d][a:b], 1)) for d, a, b in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    x[:, PAIRS] = np.array(squeezed) / np.maximum(16, hi - lo)
    x[:, PAIRS + 1] = np.log1p(hi - lo) / 6
    x[:, PAIRS + 2] = hi == lo
    return x, first


def encode_run(raw: bytes, at: int, end: int, parts: int) -> np.ndarray:
    """Features of the passages ``at`` to ``end`` of a text that has ``parts``, without a look at the others."""
    nth = np.arange(at, end)
    lo, hi = nth * len(raw) // parts, (nth + 1) * len(raw) // parts
    kind = CLASS[np.frombuffer(raw, np.uint8, min(len(raw), int(hi[-1]) + 1) - int(lo[0]), int(lo[0]))]
    kind = np.append(kind, _END) if hi[-1] == len(raw) else kind
    cell = np.repeat((nth - at) * PAIRS, hi - lo) + kind[:-1] * KINDS + kind[1:]
    counts = np.bincount(cell, minlength=len(nth) * PAIRS).reshape(len(nth), PAIRS)
    x = np.empty((len(nth), WIDTH), np.float32)
    x[:, :PAIRS] = np.sqrt(counts / np.maximum(1, hi - lo)[:, None]) * 4
    squeezed = [len(zlib.compress(raw[a:b], 1)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    x[:, PAIRS] = np.array(squeezed) / np.maximum(16, hi - lo)
    x[:, PAIRS + 1] = np.log1p(hi - lo) / 6
    x[:, PAIRS + 2] = hi == lo
    return x


def _runs(raw: bytes) -> Iterator[np.ndarray]:
    """The passages of a long text in runs of ``RUN``, so that memory doesn't grow with its length."""
    parts = max(1, int(np.rint(len(raw) / PASSAGE)))
    for at in range(0, parts, RUN):
        yield encode_run(raw, at, min(parts, at + RUN), parts)


def _encoded(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if len(part) == 1 and len(part[0]) > LONG:
        return np.concatenate(list(_runs(part[0]))), np.zeros(1, np.int64)
    return encode(part)


def _folded(m: dict, raw: bytes) -> float:
    """The score of one long text: a running maximum, sum and weighted sum stand for the attention over all passages."""
    most, total, z = -np.inf, 0.0, np.zeros(len(m["c"]))
    for x in _runs(raw):
        e = np.tanh(x @ m["We"] + m["be"])
        s = ((np.tanh(e @ m["V"]) / (1 + np.exp(-(e @ m["U"])))) @ m["w"]).astype(np.float64)
        top = max(most, float(s.max()))
        keep, a = np.exp(most - top), np.exp(s - top)
        most, total, z = top, total * keep + a.sum(), z * keep + a @ e
    return float(1 / (1 + np.exp(-np.clip(z / total @ m["c"] + m["b"], -30, 30))))


def _parts(texts: Iterable[bytes], part_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``part_bytes``, since encoding takes some 40 times that for a while; a long text is a part of its own."""
    part, held = [], 0
    for t in texts:
        if len(t) > LONG:
            if part:
                yield part
            yield [t]
            part, held = [], 0
            continue
        part.append(t)
        held += len(t) + 64
        if held >= part_bytes:
            yield part
            part, held = [], 0
    if part:
        yield part


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.tanh(x @ m["We"] + m["be"])
    v, u = np.tanh(e @ m["V"]), 1 / (1 + np.exp(-(e @ m["U"])))
    s = (v * u) @ m["w"]
    s = np.exp(s - np.maximum.reduceat(s, first)[own])
    a = s / np.add.reduceat(s, first)[own]
    z = np.add.reduceat(a[:, None] * e, first, axis=0)
    return {"own": own, "e": e, "v": v, "u": u, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))}


def _gradient(m: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(m, x, first)
    own, e, v, u, a = f["own"], f["e"], f["v"], f["u"], f["a"]
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    dz = d[:, None] * m["c"]
    da = (dz[own] * e).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[own])
    dg = ds[:, None] * m["w"]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    de = (a[:, None] * dz[own] + dv @ m["V"].T + du @ m["U"].T) * (1 - e * e)
    return {"We": x.T @ de, "be": de.sum(0), "V": e.T @ dv, "U": e.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ d, "b": d.sum()}


def train(texts: list[bytes], labels: list[int], seed: int = 17) -> dict:
    """Adam on the bags' cross entropy; a constant model where one class is missing."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    made = [_encoded(part) for part in _parts(texts)]
    before = np.cumsum([0, *(len(x) for x, _ in made)])
    first = np.concatenate([f + b for (_, f), b in zip(made, before, strict=False)])
    x = np.concatenate([x for x, _ in made])
    del made
    stop = np.append(first[1:], len(x))
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    m = {"We": init(WIDTH, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "b": np.float32(0)}
    one, two, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    epochs = max(EPOCHS, min(400, 600 * BATCH // len(y)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[i], stop[i]) for i in bags])
            starts = np.concatenate(([0], np.cumsum(stop[bags] - first[bags])[:-1]))
            step += 1
            for k, g in _gradient(m, x[rows], starts, y[bags]).items():
                g = g + 1e-5 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = (m[k] - 3e-3 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def score_texts(m: dict, texts: Iterable[bytes]) -> np.ndarray:
    if "constant" in m:
        return np.full(sum(1 for _ in texts), m["constant"])
    out = [np.array([_folded(m, part[0])]) if len(part[0]) > LONG else _forward(m, *encode(part))["p"] for part in _parts(texts)]
    return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model, from a bounded sample of the labelled documents for whose ids ``learn_from`` holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"))
    if learn_from is not None:
        known = known.withColumn(id_col, F.col("i")).where(learn_from).select("i", "y")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    passages = F.greatest(F.lit(1), F.round(F.octet_length("text") / PASSAGE)).cast("long")
    sized = texts.select("i", passages.alias("n")).groupBy("i").agg(F.sum("n").alias("n")).join(known, "i")
    first = sized.where(F.col("n") <= SAMPLE_PASSAGES).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_DOCS).collect()  # numbers only
    held = np.cumsum([r["n"] for r in first])
    chosen = [(r["i"], int(r["y"])) for r, h in zip(first, held, strict=True) if h <= SAMPLE_PASSAGES]
    if not chosen:
        return train([], [])
    kind = f"i {docs.schema[id_col].dataType.simpleString()}, y int"
    # at most SAMPLE_DOCS rows are broadcast, and SAMPLE_PASSAGES passages of text come to the driver
    used = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, kind)), "i").collect()
    used.sort(key=lambda r: (r["i"], r["text"]))
    return train([r["text"].encode("utf-8", "surrogatepass") for r in used], [r["y"] for r in used])


def scorer(model: dict) -> Callable[[Column], Column]:
    """The score of a column of texts."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_texts(model, raw_texts(batch)), pa.float64())

    return run.asNondeterministic()  # for the optimizer, which would else score again for a filter on the score


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted`` (their own columns of those names give way)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*rest, scorer(model)(F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns as they came."""
    name = free_name(docs, "_score")
    kept = docs.withColumn(name, scorer(fit(docs, labels, learn_from))(F.col("text"))).where(F.col(name) >= THRESHOLD)
    return kept.drop(name)
