"""Operator 11 against the definition in plain Python."""

from __future__ import annotations

import math
import random
import re

from sparquill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """{(item row, rank): (id, score)}; docs and items are lists of (id, text)."""
    words = [terms(t) for _, t in docs]
    n_docs, total = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for row, ((doc, _), w) in enumerate(zip(docs, words, strict=True)):
            score = 0
            for t in set(terms(text)) & set(w):
                m = 100 - 90 + (90 * len(w) * n_docs) // total
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc, row))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k, parts=4):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, q string, term int").repartition(parts)
    i = spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, rank double")
    got = lexical.rank(d, i, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_same_as_definition(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["Éa", "über", "the", "THE", "a1"]
    weight = [1 / (1 + i) for i in range(len(words))]
    text = lambda n: " ".join(draw.choices(words, weight, k=n)).replace("w7 ", "W7,\x7f")
    docs = [(i, text(draw.choice([1, 5, 30, 200]))) for i in range(250)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, " ,;\n"), (2003, "w1 " * 3000)]
    items = [(i, text(draw.choice([2, 12, 40]))) for i in range(25)] + [(100, None), (101, "?!"), (102, "nowhere"), (103, "the the THE w3")]
    for k in (1, 3, 10):
        assert run(spark, docs, items, k) == brute(docs, items, k)


def test_fewer_documents_than_k_and_ties(spark):
    docs = [(9, "same text here"), (4, "same text here"), (7, "other")]
    items = [(1, "same"), (2, "text same"), (3, "other absent")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_repeated_and_null_ids(spark):
    docs = [(5, "alpha beta"), (5, "alpha beta gamma"), (None, "alpha"), (None, "beta beta"), (6, "delta")]
    got = run(spark, docs, [(1, "alpha"), (1, "beta"), (None, "gamma")], 10)
    assert sorted(got, key=repr) == brute(docs, [(1, "alpha"), (1, "beta"), (None, "gamma")], 10)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]
    assert lexical.rank(docs.limit(0), items).count() == lexical.rank(docs, items.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Long tail, of words; " * 50 + "ünbroken" * 40).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 16)
    assert lexical.term_counts(text) == whole
