"""Operators 1 and 4: exact counts, probabilities that add up, and accuracy on texts held out."""

from __future__ import annotations

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.llm import lm, quality

SF = "/root/testdata/sf0.01"


def corpus(spark, n=200):
    rng = random.Random(5)
    nouns, verbs = ["cat", "dog", "Bird"], ["sees", "likes"]
    say = lambda: " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}" for _ in range(rng.randint(0, 12)))
    texts = [(i, say()) for i in range(n)] + [(900, None), (901, "rare" + "x" * 50), (902, "\t")]
    return texts, spark.createDataFrame([(i, t, 0.0) for i, t in texts], "doc_id long, text string, score double")


@pytest.mark.parametrize("head", [3, 1000])
def test_counts_and_base_score(spark, head):
    texts, df = corpus(spark)
    made = {r["doc_id"]: r for r in lm.score_texts(df, F.col("doc_id") % 4 == 0, head_words=head).collect()}
    words = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] + [b""]
    seen = Counter(w for i, t in texts if i % 4 for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in texts:
        w, r = words(t), made[i]
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 4 == 0, len(w), sum(seen[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    out = [made[i] for i, _ in texts if i % 4 == 0 and i < 900]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # held-out texts are likelier under the model


def test_no_training_texts_and_none(spark):
    _, df = corpus(spark, 5)
    made = lm.score_texts(df, F.lit(True)).collect()
    assert len(made) == 8 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in made)
    assert lm.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_class_probabilities_add_up():
    rng = np.random.default_rng(1)
    weights, rows = rng.standard_normal((50, 7)).astype("f4"), rng.integers(0, 50, (30, 4))
    p = np.exp([lm.log_softmax(weights, np.zeros(7, "f4"), rows, np.full(30, y)) for y in range(7)])
    assert np.allclose(p.sum(axis=0), 1, atol=1e-5)


M64 = (1 << 64) - 1


def plain_path(tree, word):
    """Slots of any word, from the tree's lists only."""
    if word in tree.words:
        return [int(x) for x in tree.slots[tree.words.index(word)] if x >= 0]
    return [tree.half + zlib.crc32(word[-2:]) % tree.half, tree.half + (zlib.crc32(word) >> 7) % tree.half, tree.width - 1]


def plain_row(value, buckets):
    value = value * 0x9E3779B97F4A7C15 & M64
    value ^= value >> 29
    return (value * 0xBF58476D1CE4E5B9 & M64) >> (65 - buckets.bit_length())


def plain_log10(tree, weights, counts, words, i):
    """log10 P(words[i] | the words before), one softmax after the other in plain loops."""
    start, buckets = 0x5851F42D4C957F2D, len(weights)
    mark = lambda j: zlib.crc32(words[j]) if j >= 0 else start
    kind = lambda j: plain_path(tree, words[j])[0] if j >= 0 else tree.width
    near, far = mark(i - 1), mark(i - 2) ^ 0xA0761D6478BD642F
    out, node, path = 0.0, 0, plain_path(tree, words[i])
    for depth, slot in enumerate(path):
        salt = node * 0xD6E8FEB86659FD93
        features = [near + salt & M64, far + salt & M64]
        if depth == 0:
            features = [near, far, kind(i - 1) * 1024 + kind(i - 2) + (1 << 40), kind(i - 1) * 1024 + kind(i - 3) + (2 << 40)]
        z = [float(tree.bias[node][s]) + sum(float(weights[plain_row(f, buckets)][s]) for f in features) for s in range(tree.width)]
        out += (z[slot] - math.log(sum(math.exp(x) for x in z))) / math.log(10)
        if slot >= tree.half:
            node = 1 + slot - tree.half if depth == 0 else 1 + tree.half + (node - 1) * tree.half + slot - tree.half
    if len(path) == 3 and path[2] == tree.width - 1:
        cell = (path[0] - tree.half) * tree.half + path[1] - tree.half
        out += math.log10(counts.get(words[i], 0) + 1) - tree.norm[cell]
    return out


def small_model(seed=3, width=8, n=400):
    rng = random.Random(seed)
    counts = {b"": 50} | {f"{rng.choice('abcd')}{i}{rng.choice(['ed', 's', 'ly', 'er'])}".encode(): 1 + 1000 // (i + 1) for i in range(n)}
    words = sorted(counts, key=lambda w: (-counts[w], w))[: n - 20]  # the last ones are not in the head
    half = width // 2
    sums, kinds = np.zeros(half * half, np.int64), np.zeros(half * half, np.int64)
    for w, c in counts.items():
        cell = lm.class_of(w, half) * half + lm.subclass_of(lm.mark_of(w), half)
        sums[cell] += c
        kinds[cell] += 1
    tree = lm.Tree(words, np.array([counts[w] for w in words]), sums, kinds, width)
    return tree, counts, np.random.default_rng(seed).standard_normal((1 << 9, width)).astype("f4")


def test_scores_are_those_of_a_plain_model():
    tree, counts, weights = small_model()
    rng = random.Random(4)
    texts = [" ".join([w.decode() for w in rng.choices(sorted(counts), k=30)] + ["UNSEENed"]).encode() for _ in range(4)] + [b"", b"x"]
    words, size, number, slots, levels = lm.Reader(tree, len(weights)).read(texts)
    made = lm.token_scores(tree, weights, number, slots, levels)
    at = 0
    for text in texts:
        own = lm.words_of(text)
        for i, w in enumerate(own):
            more = math.log10(counts.get(w, 0) + 1) if w not in tree.words else 0.0  # comes by a join with the counts
            assert made[at + i] + more == pytest.approx(plain_log10(tree, weights, counts, own, i), abs=1e-4)
        at += len(own)
    assert at == len(words) == size.sum()


def test_word_probabilities_add_up():
    """Over all counted words and one unseen share of each subclass, after a history."""
    tree, counts, weights = small_model()
    before = sorted(counts)[5:9]
    total = sum(10 ** plain_log10(tree, weights, counts, [*before, w], 4) for w in counts)
    cells = set()
    for i in range(20_000):  # an unseen word of each subclass
        w = f"zz{i}{'edslyerxq'[i % 9]}{i % 7}".encode()
        cell = tuple(plain_path(tree, w))
        if w not in counts and cell not in cells:
            cells.add(cell)
            total += 10 ** plain_log10(tree, weights, counts, [*before, w], 4)
    assert len(cells) == tree.half**2 and total == pytest.approx(1, abs=1e-4)


def test_update_follows_the_gradient():
    rng = np.random.default_rng(6)
    weights, bias = rng.standard_normal((32, 5)).astype("f8"), rng.standard_normal(5)
    rows, y = rng.integers(0, 32, (40, 3)), rng.integers(0, 5, 40)
    loss = lambda w: -lm.log_softmax(w, bias, rows, y).sum()
    after = weights.copy()
    lm.update(after, np.full(32, 1e9), np.zeros(32, np.int64), bias, rows[:, :1], y)  # a tiny step for one feature
    step, base = after - weights, lambda w: -lm.log_softmax(w, bias, rows[:, :1], y).sum()
    for at in zip(*np.nonzero(np.abs(step) > 1e-9), strict=True):
        moved = weights.copy()
        moved[at] += 1e-5
        slope = (base(moved) - base(weights)) / 1e-5
        assert step[at] == pytest.approx(-lm.RATE / 4 * slope / math.sqrt(1e9), rel=0.05, abs=1e-8)
    before = loss(weights)
    for _ in range(30):
        lm.update(weights, np.full(32, 1.0), np.zeros(32, np.int64), bias, rows, y)
    assert loss(weights) < before / 2


def test_model_grows_with_the_vocabulary():
    sizes = [10**3, 10**6, 10**9]
    assert [lm.width_of(v) for v in sizes] == [32, 32, 48] and lm.width_of(3 * 10**10) == 56
    assert [lm.buckets_of(v) for v in sizes] == [1 << 14, 1 << 14, 1 << 18]


def test_repeated_rows_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, "w1 w2", None), (None, "w3", None)], "doc_id long, text string, rest string")
    made = lm.score_texts(df, F.lit(False)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in made) == [(0, 2, 2), (1, 120_001, 120_001), (1, 120_001, 120_001), (2, 3, 3)]
    assert len({r["score"] for r in made if r["doc_id"] == 1}) == 1 and {r["train_tokens"] for r in made} == {240_007}


def test_held_out_lm_beats_unigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels, ~out)).join(labels, "doc_id").where(out).select("score", "predicted", "quality").toPandas()
    good, bad = scored.loc[scored["quality"] == 1, "score"].to_numpy(), scored.loc[scored["quality"] == 0, "score"].to_numpy()
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    assert auc > 0.9 and (scored["predicted"] == scored["quality"]).mean() > 0.85


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    x, first = quality.encode([b"some text here", b"", b"X" * 3000])
    y = np.array([1, 0, 1], "f4")
    m = {"We": rng.standard_normal((quality.WIDTH, 3)) * 0.1, "be": np.zeros(3), "V": rng.standard_normal((3, 2)), "U": rng.standard_normal((3, 2)), "w": rng.standard_normal(2), "c": rng.standard_normal(3), "b": 0.1}
    x = x.astype(float)

    def loss():
        p = quality._forward(m, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = quality._gradient(m, x, first, y)
    for k in ("V", "U", "We"):
        at = (1, 1)
        step = 1e-5
        m[k][at] += step
        up = loss()
        m[k][at] -= 2 * step
        down = loss()
        m[k][at] += step
        assert g[k][at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-6)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "text " * 50_000, "c")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    made = quality.score(docs, model)
    assert sorted(r["doc_id"] for r in made.collect()) == [1, 2, 3]
    assert quality.drop_rejected(docs, labels.limit(0)).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    twice = quality.score(docs.unionByName(docs), model).collect()
    assert len(twice) == 6 and len({(r["doc_id"], r["score"]) for r in twice}) == 3


def test_labels_without_documents_crowd_nothing_out(spark):
    """Of very many labels only few have documents: the sample is of those."""
    docs = spark.createDataFrame([(i, "good words here. " * 20 if i % 2 else "$$$ !!! ### " * 20, "a", 0.5) for i in range(10**6, 10**6 + 60)], "doc_id long, text string, lang string, _score double")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality").unionByName(docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] % 2 for r in kept.collect()) == [1] * 30


def _plain_score(m, raw):
    """Attention over passages in loops, from the definition."""
    parts = max(1, round(len(raw) / quality.PASSAGE))
    scores, hidden = [], []
    for n in range(parts):
        lo, hi = n * len(raw) // parts, (n + 1) * len(raw) // parts
        kinds = [int(quality.CLASS[b]) for b in raw[lo : hi + 1]] + ([quality._END] if hi == len(raw) else [])
        x = np.zeros(quality.WIDTH)
        for a, b in itertools.pairwise(kinds):
            x[a * quality.KINDS + b] += 1
        x = np.sqrt(x / max(1, hi - lo)) * 4
        x[-3:] = len(zlib.compress(raw[lo:hi], 1)) / max(16, hi - lo), math.log1p(hi - lo) / 6, hi == lo
        e = [math.tanh(sum(x[i] * m["We"][i, j] for i in np.flatnonzero(x)) + m["be"][j]) for j in range(quality.HIDDEN)]
        gate = [math.tanh(np.dot(e, m["V"][:, k])) / (1 + math.exp(-np.dot(e, m["U"][:, k]))) for k in range(quality.ATTENTION)]
        scores.append(np.dot(gate, m["w"]))
        hidden.append(e)
    weights = [math.exp(s - max(scores)) for s in scores]
    z = sum(w / sum(weights) * np.array(e) for w, e in zip(weights, hidden, strict=True))
    return 1 / (1 + math.exp(-(np.dot(z, m["c"]) + m["b"])))


def test_scores_are_those_of_plain_attention(monkeypatch):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choices("abc  ABé,.!\n01", k=n)).encode()
    texts = [b"", b"x", text(500), text(800), text(5000), text(20_000)]
    m = quality.train([text(900) for _ in range(30)] + [b"Good words, all of them. " * 40] * 30, [0] * 30 + [1] * 30)
    want = [_plain_score(m, t) for t in texts]
    assert np.allclose(quality.score_texts(m, texts), want, atol=1e-4)
    monkeypatch.setattr(quality, "LONG", 1000)  # and in runs
    monkeypatch.setattr(quality, "RUN", 7)
    assert np.allclose(quality.score_texts(m, texts), want, atol=1e-4)
    runs = np.concatenate(list(quality._runs(texts[-1])))
    assert np.array_equal(runs, quality.encode([texts[-1]])[0])


def test_a_very_long_text_takes_little_memory():
    m = quality.train([b"good words " * 50, b"@@## " * 90] * 8, [1, 0] * 8)
    raw = b"Some words of a very long text, again and again.\n" * 1_000_000
    tracemalloc.start()
    try:
        (score,) = quality.score_texts(m, iter([raw]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 <= score <= 1 and peak < 4 * len(raw)
