"""Operators 2 and 5."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparquill.llm import mixing, packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, n=400, sources=("a", "b", "Z", None, "é")):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), sources[min(rng.randrange(9), len(sources) - 1)], 1) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "a", 1), (n + 1, " \n", None, 1)], "doc_id long, text string, source string, size long").repartition(3)


def targets_of(sizes, weights, most=3):
    """Shares of the whole size by weight, none above ``most`` times its own size, in exact fractions."""
    total, out = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n]
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            out[i] = Fraction(most * sizes[i]) if over else total * weights[i] / weight
        if not over:
            break
        total -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 1000], [0, 10], [0], [], [1, 2, 3, 5000, 4, 5, 0, 9, 800], [7] * 40 + [90_000]])
def test_targets(spark, sizes):
    names = [f"s{i:03}" for i in range(len(sizes))]
    rows = [(s if i + 1 < len(sizes) else None, n, n) for i, (s, n) in enumerate(zip(names, sizes, strict=True))]  # the last one is null
    made = mixing.targets(spark.createDataFrame(rows, "source string, source_size long, longest long").repartition(3)).orderBy("nth").collect()
    want = targets_of(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [r["source"] for r in made] == [r[0] for r in rows] and [r["nth"] for r in made] == list(range(len(sizes)))
    for r, n, t in zip(made, sizes, want, strict=True):
        passes = int(t // n) if n else 0
        assert r["target"] == pytest.approx(float(t)) and r["passes"] == passes and r["rest"] == pytest.approx(float(t - passes * n))


def test_tree_is_exact(spark):
    quotas = [7, 0, 500, 33, 100_000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(quotas) if n], "nth long, units long")
    total, shards = sum(quotas), 700  # more than SPAN: both parts of the tree
    made = mixing.shard_quotas(rows, total, shards, 3).toPandas()
    assert made.groupby("nth")["n"].sum().to_dict() == {i: n for i, n in enumerate(quotas) if n} and (made["n"] > 0).all()
    per = made.groupby("shard")["n"].sum()
    assert len(per) == shards and set(per) <= {total // shards, total // shards + 1}
    # hypergeometric: of source 2, a shard holds its share in the mean, with that distribution's spread
    n, share = total / shards, quotas[2] / total
    own = made[made["nth"] == 2].set_index("shard")["n"].reindex(range(shards), fill_value=0)
    assert own.mean() == pytest.approx(quotas[2] / shards) and own.var() == pytest.approx(n * share * (1 - share), rel=0.3)


def test_mix(spark):
    df = docs(spark)
    made = mixing.mix(df, block_size=300).toPandas()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    assert dict(zip(made["doc_id"], made["size"], strict=True)) == size
    made["times"] = made["draws"].map(len)
    made["source"] = made["doc_id"].map(lambda i: source[i] or "")
    assert made["times"].max() <= 3
    names = sorted((s for s in set(source.values()) if s is not None), key=lambda s: s.encode()) + [None]
    totals = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    targets = targets_of(totals, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, want in zip(names, targets, strict=True):
        part = made[made["source"] == (s or "")]
        assert part["target"].iloc[0] == pytest.approx(float(want))
        assert abs((part["times"] * part["size"]).sum() - float(want)) <= 3
    again = mixing.mix(df.repartition(7), block_size=300).toPandas()
    key = lambda f: sorted((i, tuple(map(tuple, d))) for i, d in zip(f["doc_id"], f["draws"], strict=True))
    assert key(made) == key(again)


def test_mix_fills_a_target_beside_a_long_text(spark):
    sizes = {f"s{i:02}": [300_000] + [1_000] * 300 for i in range(8)} | {"t0": [20_000] * 60 + [10] * 1_500, "t1": [20_000] * 60 + [1] * 15_000}
    flat = [(s, n) for s, part in sizes.items() for n in part]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(flat)], "doc_id long, source string, n int").repartition(8)
    made = mixing.mix(df.withColumn("text", F.expr("repeat('w ', n)")), weights=(1, 3)).toPandas()
    made["source"], made["words"] = made["doc_id"].map(lambda i: flat[i][0]), made["draws"].map(len) * made["size"]
    assert (made["size"] == made["doc_id"].map(lambda i: flat[i][1])).all()
    for s, part in made.groupby("source"):
        short = {"t0": 10, "t1": 1}.get(s, 1_000)
        assert abs(part["words"].sum() - part["target"].iloc[0]) <= short / 2


def test_mixed_rows_and_none(spark):
    df = docs(spark, 60)
    assert mixing.mixed(df, block_size=100).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.withColumn("text", F.lit(" "))).where(F.size("draws") > 0).count() == 0
    twice = mixing.mix(df.unionByName(df))
    assert twice.count() == 2 * df.count()


def test_pack(spark):
    from tokenizers import Tokenizer

    texts = [(i, " ".join(random.Random(i).choice(["the", "Überß", "don't", "12 3", "漢字", "\n\n", "_x"]) for _ in range(i * 7 % 900))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "<|endoftext|> x"), (103, "word " * 5000), (103, "word " * 5000)]
    made = packing.pack(spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, length int"), TOKENIZER).toPandas()
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts}
    for r in made.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert made["length"].sum() == sum(len(ids[i]) for i, _ in texts)
    for _, part in made.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 1024
    assert made["sequence_id"].nunique() <= made["length"].sum() / 1024 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_solve_is_close_to_a_known_answer():
    sets = np.array([[0, 0, 3, 5], [0, 0, 4, 4], [0, 2, 3, 3]])
    x = packing.solve(sets, packing.np.bincount(np.repeat(sets, [30, 10, 5], axis=0).ravel(), minlength=8).astype(float))
    assert np.allclose(x, [30, 10, 5], atol=0.1)


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    h = np.append(0, rng.integers(0, 40, 64))
    used = np.zeros_like(h)
    for pattern, times in packing.plan(h, 64):
        assert sum(n * u for n, u in pattern) <= 64
        for n, u in pattern:
            used[n] += u * times
    assert (used == h).all()


def test_mixed_rows_are_the_draws(spark):
    """Every row as often as drawn, in shards, with clashing names and null ids; one text longer than many blocks."""
    rng = random.Random(12)
    rows = [(i if i % 9 else None, "w " * rng.randint(0, 30), "ab"[i % 2], i, "s", i % 3) for i in range(90)] + [(900, "w " * 5000, "a", 900, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row_key long, shard string, row int").repartition(4)
    made = mixing.mix(df, block_size=60, key="_row_key").toPandas()
    times = {int(k): len(d) for k, d in zip(made["_row_key"], made["draws"], strict=True)}
    drawn = Counter(r["_row_key"] for r in mixing.mixed(df.where("doc_id IS NOT NULL"), block_size=60).collect())
    assert max(times.values()) <= 3 and len(times) == 91 and set(drawn) <= {r[3] for r in rows if r[0] is not None}
    assert sorted(mixing.mixed(df, block_size=60).columns) == sorted(df.columns)
    size = {r[3]: len(r[1].split()) for r in rows}
    for source, miss in (("a", 500), ("b", 30)):  # source a can't come nearer: without its long text it has few words
        own = [r[3] for r in rows if r[2] == source]
        target = float(made.set_index("_row_key").loc[own[0], "target"])
        assert abs(sum(times[k] * size[k] for k in own) - target) <= miss


def test_pack_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (3, "x " * 3000, 3), (3, "x " * 3000, 4)], "doc_id long, text string, length int").repartition(3)
    made = packing.pack(df, TOKENIZER).toPandas()
    assert made["doc_id"].isna().sum() == 2 and made[made["doc_id"] == 3].groupby("start")["length"].count().eq(2).all()
    for _, s in made.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 1024


def test_token_bytes_encodes_new_words_together(monkeypatch):
    """The ids are the tokenizer's own whatever the spacing, also after words have left; new words are few texts to it."""
    monkeypatch.setattr(packing, "KEEP_FIRST", 300)
    monkeypatch.setattr(packing, "KEEP_LATER", 100)
    tokens, rng, asked = packing.TokenBytes(TOKENIZER), random.Random(4), []
    real = tokens.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **options)

    tokens.tokenizer = Counting()
    words = [f"{rng.choice('abXÉ')}{rng.randrange(10**6)}{rng.choice(['', ',', '.', chr(10) + 'The'])}" for _ in range(1000)]
    tokens.of([" ".join(words[at : at + 50]) for at in range(0, 1000, 50)])
    assert len(asked) <= 5
    signs = [" ", " ", "  ", "\n", "\t", "\r", "a", "é", "ŉ", "'s", "'", "1", ".", "×", "_", "Hello", "<|endoftext|>", "\xa0", "漢", "\x1c"]
    texts = ["".join(rng.choices(signs[: rng.choice([6, 12, 20])], k=rng.randrange(14))) for _ in range(5000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in real.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for at in range(0, 5000, 250) for x in tokens.of(texts[at : at + 250])] == want


def test_distinct_words_are_looked_up_once(monkeypatch):
    """Of many words only the distinct ones are looked up, however they are punctuated; segments and dictionaries of any size give the tokenizer's ids."""

    class Counting(dict):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

    tokens, rng = packing.TokenBytes(TOKENIZER), random.Random(5)
    tokens.known = Counting(tokens.known)
    words = ["That's", "été", "on", "12"]
    texts = [" ".join(f"{w}{s}" for w, s in zip(rng.choices(words, k=1000), rng.choices(["", ",", ".", "!?"], k=1000), strict=True)) for _ in range(50)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert tokens.of(texts) == want
    assert Counting.asked < 20  # of 62,500 words
    signs = [" ", " ", "\n", "\t", "a", "s", "t", "re", "v", "e", "l", "l", "'", "'", "'s", "1", "_", ".", "é", "÷", "漢", "\0"]
    for segment, at_once in ((1, 1), (3, 7), (10, 1000)):
        monkeypatch.setattr(packing, "SEGMENT", segment)
        monkeypatch.setattr(packing, "WORDS_AT_ONCE", at_once)
        texts = ["", "'", "'s", " '", *("".join(rng.choices(signs[: rng.choice([15, 20, 22])], k=rng.randrange(30))) for _ in range(300))]
        want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert tokens.of(texts) == want
