"""Operators 6, 7 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill.llm import exact_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, name string, rep long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], SCHEMA).repartition(3)


def random_texts(seed, n, words, length):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = (rng.choice(out)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, length)))))
    return out


# ---- exact


def exact_by_hand(texts):
    norm = {k: re.sub(r"[\x20\x09-\x0D]", "", t or "") for k, (_, t) in enumerate(texts)}
    out = []
    for k, (i, _) in enumerate(texts):
        same = [j for j in norm if norm[j] == norm[k]]
        best = min(same, key=lambda j: (-len(texts[j][1] or ""), texts[j][0]))
        out.append((i, texts[best][0], len(same), best == k, hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")])
def test_exact_groups(spark, digest):
    rng = random.Random(1)
    bits = ["ab", "a b", "ab\t", "c\x0bd", " ", "é", ""]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, None), (91, " \n"), (92, "")]
    found = exact_dedup.exact_groups(table(spark, texts), block_chars=3, digest=digest)
    made = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect())
    assert made == exact_by_hand(texts)


def test_exact_repeated_rows_nulls_and_none(spark):
    df = table(spark, [(1, "a"), (1, "a"), (None, "a"), (2, "long " * 3000), (3, "long" * 3000)])
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], len(r["text"])) for r in kept.collect()) == [(1, 1), (2, 15000)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


# ---- near


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def near_by_hand(texts, width, percent):
    sets = [shingles(t, width) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((texts[i][0], len(sets[i]), texts[find(i)][0], find(i) == i) for i in range(len(texts)))


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 4), (5, 80, 1000)])
def test_near_groups(spark, width, percent, block):
    texts = random_texts(2, 60, "one Two three four".split(), 60) + [(90, None), (91, " \n "), (92, "Two"), (93, "two"), (94, "two three")]
    found = near_dedup.near_groups(table(spark, texts), width=width, percent=percent, block=block)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()) == near_by_hand(texts, width, percent)


def test_near_repeated_rows_nulls_and_none(spark):
    df = table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (2, ""), (3, "")])
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert near_dedup.near_groups(df.limit(0)).count() == 0


# ---- substrings


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (doc, _), b in zip(texts, raw, strict=True):
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(cover)))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((doc, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 4000])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_repeated_bytes(spark, hot, alphabet):
    rng = random.Random(3)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    texts = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(15)) for _ in range(rng.randint(0, 5)))) for i in range(30)]
    texts += [(40, None), (41, "a" * 70), (42, "a" * 12)]
    found = substring_dedup.remove_repeats(table(spark, texts), length=20, gram=6, hot=hot)
    made = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert made == repeats_by_hand(texts, 20)


def test_repeated_bytes_across_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    rng = random.Random(4)
    text = "".join(rng.choice("abcd") for _ in range(400))
    got = [substring_dedup.anchors(__import__("numpy").frombuffer(text.encode(), "u1"), substring_dedup.Powers(), 20, 6)]
    first, last = got[0][2], got[0][3]
    assert first[0] == 0 and last[-1] == 380 and (first[1:] == last[:-1] + 1).all()  # every window has one anchor


@pytest.mark.parametrize("size", [150, 180])
def test_hot_group_of_one_long_passage(spark, size):
    """A passage shorter than the window in many texts: all contexts differ, so groups split by offsets."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(size)
    texts = [(i, word(rng.randint(0, 90)) + passage + rng.choice(["x", "yz", "zz1"]) * rng.randint(0, 40) + word(30)) for i in range(40)]
    found = substring_dedup.remove_repeats(table(spark, texts), length=200, gram=16, hot=3)
    made = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert made == repeats_by_hand(texts, 200)


def test_long_text_over_segments(spark):
    """Texts longer than a segment of window starts (2**18): repeats across the segment's end and within one text."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    a, b = word(700), word(500)
    edge = substring_dedup.SEGMENT
    texts = [(1, word(edge - 300) + a + word(2000) + b + word(900) + b), (2, a + word(10)), (3, word(1000)), (4, None)]
    found = substring_dedup.remove_repeats(table(spark, texts))
    made = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert made == repeats_by_hand(texts, 400)


def test_shared_passages(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, q = words(51), words(37)
    texts = [(1, [*words(30), *p, *words(5)]), (2, [*p, *words(200)]), (3, [*q, *words(60)]), (4, [*words(60), *q]), (5, words(90) * 2), (6, [])]
    df = table(spark, [(i, " ".join(w)) for i, w in texts] + [(7, None)])
    assert {r[0] for r in substring_dedup.shared_passages(df, key="doc_id").collect()} == {1, 2}


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", None, 5), (2, "a b c d e f", 7, None), (3, "x" * 900, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row_key long, h long")
    assert substring_dedup.remove_repeats(df).count() == 3
    assert near_dedup.near_groups(df).count() == 3 and exact_dedup.exact_groups(df).count() == 3
    for drop in (near_dedup.drop_near_copies, exact_dedup.drop_exact_copies):
        assert sorted(map(tuple, drop(df).collect())) == [rows[0], rows[2]]


def test_near_hot_star_and_chain(spark):
    """More copies than a block around one star, a chain whose ends are unlike, and loose members of the same buckets."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        texts.append((i, " ".join(w)))
    chain = list(base)
    for i in range(60, 90):
        chain[(i - 60) * 4 : (i - 60) * 4 + 2] = [f"c{i}", f"d{i}"]
        texts.append((i, " ".join(chain)))
    found = near_dedup.near_groups(table(spark, texts), width=3, percent=85, block=7)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()) == near_by_hand(texts, 3, 85)


def test_bands_follow_the_threshold():
    for percent in (60, 80, 85, 95, 100):
        n = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** n <= near_dedup.MISS


def test_repeated_rows_and_none(spark):
    df = table(spark, [(1, "x" * 500), (1, "x" * 500), (2, "y" * 399)])
    made = substring_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in made) == [(1, 500), (1, 500), (2, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_text_ids(spark):
    """Ids that are no integers tell nothing apart; rows go by their number."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [("b", text), ("a", text), ("a", text + " more"), ("c", None), (None, "other words altogether than those of the rest")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    exact = sorted((r["doc_id"] or "", len(r["text"] or "")) for r in exact_dedup.drop_exact_copies(df).collect())
    assert len(exact) == 4
    near = near_dedup.drop_near_copies(df).collect()
    assert len(near) == 3 and {r["doc_id"] for r in near} >= {"c", None}
    assert substring_dedup.remove_repeats(df).count() == 5
