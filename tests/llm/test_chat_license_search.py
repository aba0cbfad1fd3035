"""Operators 3, 8 and 9."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparquill.llm import chat, licenses, search

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "a", " ", "é", "<", "/s>"]), max_size=12).map("".join)


@given(PIECES, PIECES)
def test_round_trip(role, text):
    rendered, _ = chat.render(role, text)
    assert chat.parse(rendered) == [(role, text)]
    assert chat.unescape(chat.escape(text)) == text


@given(st.lists(st.tuples(PIECES, PIECES), max_size=6), st.integers(1, 9))
def test_conversations_read_in_pieces(turns, size):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    reader = chat.Reader()
    found = [t for at in range(0, len(whole), size) for t in reader.feed(whole[at : at + size])]
    reader.close()
    assert found == turns


def test_digests(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", None), (None, 0, "system", "x"), (2, 5, None, "a\nb"), (2, 5, "assistant", "b")]
    df = spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    made = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert made[1]["turns_sha256"] == sha("user\nhi\nassistant\n</s>\nassistant\n\n") and made[1]["loss_sha256"] == sha("</s>") and made[1]["loss_chars"] == 4
    assert made[None]["n_turns"] == 1 and made[2]["n_turns"] == 2
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_licenses_planted(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["lorem", "license", "the", "software", "Version"]) for _ in range(n))
    mit = licenses.TEMPLATES["mit"].split()
    short = mit[:30] + mit[32:]
    texts = [
        (1, filler(50) + "\n" + licenses.TEMPLATES["mit"] + "\n" + filler(20)),
        (2, filler(10) + " " + " ".join(short) + " " + filler(5)),
        (3, " ".join(mit[:20])),
        (4, licenses.TEMPLATES["mit-line"] + " x " + licenses.TEMPLATES["mit-line"]),
        (5, None), (6, ""), (7, filler(3000)),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_matches int")
    made = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [m["license"] for m in made[1]["matches"]] == ["mit"] and made[1]["matches"][0]["coverage"] == 1.0
    span = made[1]["matches"][0]
    assert texts[0][1][span["start"] : span["end"]] == licenses.TEMPLATES["mit"]
    assert [m["license"] for m in made[2]["matches"]] == ["mit"] and made[2]["matches"][0]["matched_words"] == len(short)
    assert [made[i]["n_matches"] for i in (3, 4, 5, 6, 7)] == [0, 2, 0, 0, 0]
    assert licenses.scan(df.limit(0)).count() == 0


def test_short_notices_in_comments_and_with_changed_words():
    index = licenses.Index(licenses.TEMPLATES)
    found = lambda text: [(m["license"], m["coverage"], text[m["start"] : m["end"]]) for m in licenses.scan_text(text, index)]
    for mark in ("#", "//", "*", "--", ";;", "|"):
        text = f"x\n{mark} Released under the\n{mark} MIT License.\n{mark} y"
        assert found(text) == [("mit-line", 1.0, text[text.index("Released") : text.index(".") + 1])]
    assert found("Released under an MIT License, it says") == [("mit-line", 0.8, "Released under an MIT License,")]
    assert found("Released under the new MIT style License") == [("mit-line", 1.0, "Released under the new MIT style License")]
    assert found("Released under the License") == [("mit-line", 0.8, "Released under the License")]
    assert found("released by an MIT body, no license") == [] == found("the the the under the License of the")
    for name, whole in licenses.TEMPLATES.items():
        words = whole.split()
        for i in range(len(words)) if len(words) <= 15 else ():
            for changed in ([*words[:i], "other", *words[i + 1 :]], [*words[:i], *words[i + 1 :]], [*words[:i], "one", "more", *words[i:]]):
                assert name in [m["license"] for m in licenses.scan_text(" ".join(["before", *changed, "after"]), index)]


def test_long_and_repeated_rows(spark):
    long = "lorem </s> " * 40_000
    told = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "y")], "conv_id long, turn long, role string, text string, loss_chars string")
    made = chat.read_back(chat.format_turns(told)).collect()
    assert len(made) == 1 and made[0]["loss_chars"] == len(long) and made[0]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    text = "filler words " * 30_000 + licenses.TEMPLATES["zlib-text"] + " tail"
    found = licenses.scan(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert [[m["license"] for m in r["matches"]] for r in found] == [["zlib-text"]] * 3


def best_alignment(words, template):
    """Most matched words of the best-scoring alignment of the template anywhere in the text, by a full table."""
    row = [(0.0, 0)] * (len(words) + 1)
    for t in template:
        new = [(row[0][0] - 0.5, row[0][1])]
        for j, w in enumerate(words):
            options = [(row[j][0] + 1, row[j][1] + 1) if w == t else (row[j][0] - 1, row[j][1]), (row[j + 1][0] - 0.5, row[j + 1][1]), (new[j][0] - 0.5, new[j][1])]
            new.append(max(options, key=lambda x: x[0]))
        row = new
    return max(row)[1]


def test_runs_of_missing_and_added_words_do_not_part_a_match():
    """Nine or more words in a row missing, a dozen added, both at once, and copies next to each other."""
    index = licenses.Index(licenses.TEMPLATES)
    found = lambda text, name: [(round(m["coverage"], 2), text[m["start"] : m["end"]]) for m in licenses.scan_text(text, index) if m["license"] == name]
    mit = licenses.TEMPLATES["mit-text"].split()
    extra = "one two three four five six seven eight nine ten eleven twelve".split()
    for kept in ([*mit[:60], *mit[69:]], [*mit[:60], *mit[75:]], [*mit[:80], *extra, *mit[80:]], [*mit[:40], *mit[52:90], *extra, *mit[90:]]):
        text = " ".join(["before it", *kept, "after it"])
        (match,) = found(text, "mit-text")
        assert match == (round(len([w for w in kept if w not in extra]) / len(mit), 2), " ".join(kept))
    twice = " ".join([*mit[:60], *mit[69:], "and", *mit, "and then", *mit[:100], *extra, *mit[100:]])
    assert [c for c, _ in found(twice, "mit-text")] == [round((len(mit) - 9) / len(mit), 2), 1.0, 1.0]
    assert found(" ".join(mit[:120]), "mit-text") == []


def test_text_ids_and_rows_aligned_alike(spark):
    df = spark.createDataFrame([("a", "Released under the MIT License."), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["n_matches"]) for r in licenses.scan(df).collect()) == [("", 0), ("a", 1)]
    rng = random.Random(2)
    for _ in range(200):
        template = np.array([rng.randrange(6) for _ in range(rng.randint(1, 12))])
        words = [rng.randrange(7) for _ in range(rng.randint(0, 16))]
        matched, first, last = licenses.align_within(np.array(words, np.int64), template)
        assert matched == best_alignment(words, template.tolist()) and 0 <= first <= last <= len(words)


def test_scan_against_full_alignment():
    """What a full alignment of every template with the whole text finds; words changed or missing, none to many."""
    rng = random.Random(10)
    index = licenses.Index(licenses.TEMPLATES)
    for _ in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        words = licenses.TEMPLATES[name].split()
        share = rng.choice([0, 0.05, 0.1, 0.15, 0.3])
        kept = [rng.choice([None, "other"]) if rng.random() < share else w for w in words]
        text = " ".join(["lorem the software"] * rng.randint(0, 5) + [w for w in kept if w] + ["ipsum of the"] * rng.randint(0, 5))
        plain = licenses.normalised(text)
        found = {m["license"] for m in licenses.scan_text(text, index)}
        for other, template in licenses.TEMPLATES.items():
            t = licenses.normalised(template)
            if other in (name, *found):
                assert (best_alignment(plain, t) >= licenses.COVERAGE * len(t)) == (other in found), (name, other, share)


def brute_bm25(texts, queries, k):
    words = {i: Counter((t or "").encode().lower().split()) for i, t in texts}
    n, mean = len(texts), sum(sum(w.values()) for w in words.values()) / len(texts)
    df = Counter(t for w in words.values() for t in w)
    out = []
    for q, text in queries:
        scored = []
        for i, w in words.items():
            dl, s = sum(w.values()), 0.0
            for t, c in Counter((text or "").encode().lower().split()).items():
                if w[t]:
                    s += c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * dl / mean))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_search_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randint(0, 40)))) for i in range(150)] + [(200, None), (201, "w1 w1"), (202, "w1 w1")]
    texts += [(300, " ".join(rng.choices(vocabulary, k=9000)))]  # very long: a shard of its own
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, tf int, round string").repartition(3)
    asked = [(i, t) for i, t in texts if i % 10 == 0]
    for block, shard_bytes, rows in ((4, 600, 7), (64, 1 << 20, 4000)):
        index = search.build_index(docs, shard_bytes=shard_bytes, block=block)
        found = search.search(index, spark.createDataFrame(asked, "id long, text string"), k=5, query_rows=rows)
        assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == brute_bm25(texts, asked, 5)
    queries = spark.createDataFrame(asked, "id long, text string")
    assert search.search(search.build_index(docs.limit(0)), queries).count() == 0 == search.search(index, queries.limit(0)).count()


def test_search_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 7, f"a{i % 7} b") for i in range(14)] + [(None, "b")], "doc_id long, text string")
    index = search.build_index(docs)
    asked = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a3"), (2, None), (2, " \n")], "id long, text string")
    rows = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.search(index, asked, k=14).collect()]
    whole = [(1, i + 1, i // 2) for i in range(14)]  # each repeated document twice, each repeated query for itself
    assert sorted(r for r in rows if r[0]) == sorted(whole * 2)
    assert sorted(r[1:] for r in rows if r[0] is None) == [(1, 3), (2, 3)]


def test_index_stores_block_maxima():
    shard = search._Shard(2)
    for i, text in enumerate(["a a b", "b", "a c c c c", "a"]):
        shard.add(i, text.encode())
    row = shard.row()
    ints = lambda k: [int.from_bytes(row[k][j : j + 4], "little") for j in range(0, len(row[k]), 4)]
    size, entries = ints("size"), list(zip(ints("entry_block"), ints("entry_first"), ints("entry_most"), ints("entry_least"), strict=True))
    ends = [e[1] for e in entries[1:]] + [len(ints("doc"))]
    for (block, first, most, least), end in zip(entries, ends, strict=True):
        docs = ints("doc")[first:end]
        assert {d // 2 for d in docs} == {block} and most == max(ints("tf")[first:end]) and least == min(size[d] for d in docs)


def test_search_sums_frequencies_once(spark, monkeypatch):
    """One table of document frequencies serves all query blocks, and a shard gives a row for each of its terms to it."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 6))) for i in range(24)]
    index = search.build_index(spark.createDataFrame([*rows, (90, None), (91, "É é")], "doc_id long, text string"), shard_bytes=300)
    asked = spark.createDataFrame([*rows[:12], (70, "w3 nowhere"), (71, "w3 w3"), (72, "")], "id long, text string")
    shown, write = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label, **o: shown.append((label, write(df, label, **o))) or shown[-1][1])
    split = search.search(index, asked, k=4, query_rows=2).orderBy("query_id", "rank").collect()
    tables = [df for label, df in shown if label == "frequencies"]
    assert len(tables) == 1
    whole = {w: sum(w in t.split() for _, t in rows) for w in (f"w{n}" for n in range(17))}
    found = [(r["block"], bytes(r["term"]).decode(), r["df"]) for r in tables[0].collect()]
    assert len({b for b, _, _ in found}) > 5 and len({x[:2] for x in found}) == len(found)
    assert all(whole[t] == n for _, t, n in found)
    assert split == search.search(index, asked, k=4).orderBy("query_id", "rank").collect()
    terms = [x for r in index.select("terms").collect() for x in search._term_array(bytes(r["terms"])).to_pylist()]
    assert terms == [x for r in index.select("terms").collect() for x in search._terms(bytes(r["terms"]))]


def _searched(monkeypatch, docs, asked, k, least=None):
    """The k best of every query, without Spark, and how often hits were handed over."""
    shard = search._Shard(8)
    for i, text in docs:
        shard.add(i, text.encode())
    shard = shard.row()
    number, terms, sizes, tf = {}, [], [], []
    for text in asked:
        counts = Counter(text.encode().lower().split())
        terms += [number.setdefault(t, len(number)) for t in counts]
        sizes.append(len(counts))
        tf += counts.values()
    part = {"query": np.arange(len(asked)), "size": np.array(sizes, "<i4"), "term": np.array(terms, "<i4"), "tf": np.array(tf, "<i4")}
    block = search._Queries([{**{c: (x.astype("<i8") if c == "query" else x).tobytes() for c, x in part.items()}, "words": b"\n".join(number)}])
    df = np.array([sum(t in text.encode().lower().split() for _, text in docs) for t in number])
    block.idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    block.mean = sum(len(text.split()) for _, text in docs) / len(docs)
    block.least = np.zeros(len(asked)) if least is None else least
    calls, add = [], search._Best.add
    monkeypatch.setattr(search._Best, "add", lambda self, *a: calls.append(1) or add(self, *a))
    (found,) = search._searcher(SimpleNamespace(value=block), k)(iter([pd.DataFrame([shard])]))
    return sorted(found.itertuples(index=False, name=None), key=lambda r: (r[0], -r[2], r[1])), len(calls)


def test_search_of_many_long_queries_at_once(monkeypatch):
    """Documents as queries meet a shard in stretches, not one by one, and have the scores of a brute force, ties by id; so under a threshold."""
    draw = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    odds = [1 / (n + 2) for n in range(400)]
    docs = [(i, " ".join(draw.choices(words, odds, k=draw.randint(1, 90)))) for i in range(300)]
    docs += [(300 + i, text) for i, text in docs[:20]]
    asked = [text for _, text in docs] + ["nowhere", "w0", "w399 w399 nowhere"]
    counts = [Counter(text.split()) for _, text in docs]
    mean, n = sum(sum(c.values()) for c in counts) / len(docs), len(docs)
    df = {w: sum(w in c for c in counts) for w in words}
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    best = []
    for q, text in enumerate(asked):
        scores = []
        for (i, _), c in zip(docs, counts, strict=True):
            s = sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in Counter(text.split()).items() if w in c)
            scores.append((-round(s, 6), i))
        best.append([(q, i, -s) for s, i in sorted(scores)[:6] if s < 0])
    near = lambda rows: [(q, i, pytest.approx(s, abs=2e-6)) for q, i, s in rows]
    found, calls = _searched(monkeypatch, docs, asked, 6)
    assert found == near([r for rows in best for r in rows])
    assert calls < len(asked) / 3
    monkeypatch.setattr(search, "CELLS", 9000)  # more runs and smaller ones
    monkeypatch.setattr(search, "CHUNK", 700)
    monkeypatch.setattr(search, "SELDOM", 0.2)
    assert _searched(monkeypatch, docs, asked, 6)[0] == found
    least = np.zeros(len(asked))
    for q in range(len(asked)):
        least[q] = ([s for p, _, s in found if p == q] + [0] * 4)[3]
    assert _searched(monkeypatch, docs, asked, 6, least)[0] == [r for r in found if r[2] >= least[r[0]]]
