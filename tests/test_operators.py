"""Cases that the driver's tables lack: nulls, ties, empty tables, brute-force comparisons."""

from __future__ import annotations

import datetime as dt
import heapq
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.functions import values as U
from sparquill.operators import corpus as C
from sparquill.operators import costing as K
from sparquill.operators import evaluation as E
from sparquill.operators import events as V
from sparquill.operators import needles, profile, vectors
from sparquill.operators import relational as R
from sparquill.operators import retrieval as S
from sparquill.plans.corpus import order_ancestry


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randint(0, 20)) for i in range(60)]
    right = [(rng.choice("abc"), t, float(v)) for v, t in enumerate(rng.sample(range(25), 20))]
    made = R.as_of_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, v double"), ["k"], "t", "at")
    strict = R.as_of_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, v double"), ["k"], "t", "at", strict=True)

    def expected(within):
        out = []
        for i, k, t in left:
            found = [(a, v) for kk, a, v in right if kk == k and within(a, t)]
            out.append((i, max(found)[1] if found else None))
        return sorted(out, key=repr)

    assert rows(made, "id", "v") == expected(lambda a, t: a <= t)
    assert rows(strict, "id", "v") == expected(lambda a, t: a < t)


@pytest.mark.parametrize("scale, kind", [(1, "double"), (1e-9, "double"), (1e12, "double"), (40, "long"), (3, "int")])
def test_range_join_against_brute_force(spark, scale, kind):
    """Short, long, empty, open and reversed spans on axes of every size."""
    rng = random.Random(2)
    number = (lambda x: x * scale) if kind == "double" else (lambda x: int(x * scale))
    points = [(i, number(rng.uniform(-5, 5))) for i in range(80)] + [(80, None)]
    spans = [(i, a := number(rng.uniform(-6, 5)), a + number(rng.choice([0, 0.01, 1, 9]))) for i in range(40)]
    spans += [(40, None, number(1.0)), (41, number(2.0), None), (42, None, None), (43, number(3.0), number(-3.0)), (44, number(99.0), None), (45, None, number(-99.0)), (46, *[points[0][1]] * 2)]
    made = R.range_join(spark.createDataFrame(points, f"p int, x {kind}"), spark.createDataFrame(spans, f"s int, lo {kind}, hi {kind}"), "x", "lo", "hi")
    held = lambda x, lo, hi: x is not None and (lo is None or lo <= x) and (hi is None or x < hi)
    assert rows(made, "p", "s") == sorted(((p, s) for p, x in points for s, lo, hi in spans if held(x, lo, hi)), key=repr)


def test_range_counts_make_no_pairs(spark):
    """Ties, open, empty and reversed spans against brute force; and 30,000 points in 30,000 spans without 900 million pairs."""
    rng = random.Random(3)
    points = [(i, float(rng.randint(-9, 9)), 0) for i in range(90)] + [(90, None, 0)]
    spans = [(a := float(rng.randint(-9, 9)), a + rng.choice([-1.0, 0.0, 0.5, 1.0, 7.0])) for _ in range(60)] + [(None, 1.0), (2.0, None), (None, None)]
    made = R.range_counts(spark.createDataFrame(points, "p int, x double, z int"), spark.createDataFrame(spans, "lo double, hi double"), "x", "lo", "hi")
    want = {p: sum((lo is None or lo <= x) and (hi is None or x < hi) for lo, hi in spans) for p, x, _ in points if x is not None}
    assert {r["p"]: r["spans"] for r in made.collect()} == {p: n for p, n in want.items() if n}
    many = spark.range(30_000).selectExpr("id AS p", "CAST(id AS DOUBLE) AS x", "-1.0D AS lo", "1e9D AS hi")
    assert R.range_counts(many.select("p", "x"), many.select("lo", "hi"), "x", "lo", "hi").where("spans = 30000").count() == 30_000
    assert made.columns == ["p", "x", "z", "spans"] and R.range_counts(many.limit(0), many, "x", "lo", "hi").count() == 0


def test_quartiles_without_all_values_in_one_task(spark):
    x = np.random.default_rng(4).standard_normal(999).round(2)
    given = [(float(v), None if i % 7 else float("inf"), 5) for i, v in enumerate(x)] + [(None, None, None), (float("nan"), 1.5, 5)]
    df = spark.createDataFrame(given, "a double, b double, c int")
    made = profile.summary(df)
    assert "percentile(" not in made._jdf.queryExecution().toString()
    same = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c) for c in "abc"]).first()
    assert [[r["q25"], r["median"], r["q75"]] for r in made.collect()] == [[round(v, 6) for v in same[c]] for c in "abc"]
    assert [r["median"] for r in profile.summary(df.limit(0)).collect()] == [None] * 3


def test_more_tasks_for_more_rows(spark):
    df = spark.range(1000)
    assert R.in_parts(df, "id", each=100).rdd.getNumPartitions() == 80 and R.in_parts(df, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_interval_join_on_dates_and_timestamps(spark):
    rng = random.Random(4)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    points = [(i, rng.choice("abc"), day(rng.randrange(400))) for i in range(120)] + [(120, None, day(3)), (121, "a", None)]
    spans = [(i, rng.choice("abc"), a := rng.randrange(400), rng.choice([None, a + 1, a + 30, a + 390])) for i in range(60)]
    spans = [(i, k, day(a), None if b is None else day(b)) for i, k, a, b in spans] + [(60, None, day(0), None), (61, "b", None, day(9))]
    want = sorted(((p, s) for p, k, x in points for s, kk, a, b in spans if x and k and k == kk and (a is None or a <= x) and (b is None or x < b)), key=repr)
    p, s = spark.createDataFrame(points, "p int, k string, x date"), spark.createDataFrame(spans, "s int, k string, lo date, hi date")
    assert rows(R.interval_join(p, s, ["k"], "x", "lo", "hi"), "p", "s") == want
    later = s.withColumns({"lo": F.col("lo").cast("timestamp"), "hi": F.col("hi").cast("timestamp")})
    assert rows(R.interval_join(p, later, ["k"], "x", "lo", "hi"), "p", "s") == want
    none = R.interval_join(p.limit(0), s, ["k"], "x", "lo", "hi")
    assert none.columns == ["p", "k", "x", "s", "lo", "hi"] and none.count() == 0 == R.range_join(p, s.limit(0), "x", "lo", "hi").count()


def test_hot_key_is_dealt_out_over_cells(spark):
    """One key with most rows under open spans: no group of the join has more than a small share of the points."""
    points = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN id % 50 ELSE 7 END AS k", "id AS x")
    spans = spark.range(50).selectExpr("id AS k", "CAST(NULL AS LONG) AS lo", "CAST(NULL AS LONG) AS hi")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = R.interval_join(points, spans, ["k"], "x", "lo", "hi").groupBy(F.spark_partition_id()).count()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        dealt = sorted(r["count"] for r in made.collect())
    finally:
        for c, v in (("spark.sql.autoBroadcastJoinThreshold", "10m"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "4")):
            spark.conf.set(c, v)
    assert sum(dealt) == 20_000 and dealt[-1] < 2.5 * dealt[len(dealt) // 2]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_substring_join_against_brute_force(spark, most):
    """By the automaton and, beyond its bound, by grams: needles that hold and overlap each other, repeats, nulls, empty ones."""
    short = [(0, "a"), (1, "ab"), (2, "abc"), (3, "bcd"), (4, "zzz"), (5, "dd"), (6, "ab"), (7, ""), (8, None), (9, "\U0001f600é")]
    long = [(0, "abcd"), (1, "ddddd"), (2, "xxab"), (3, ""), (4, None), (5, "abcd"), (6, "é\U0001f600é\U0001f600é" * 3), (7, "ab" * 500)]
    made = needles.substring_join(spark.createDataFrame(short, "i int, n string"), spark.createDataFrame(long, "j int, h string"), "n", "h", most=most)
    assert made.columns == ["i", "n", "j", "h", "hits", "first"]
    want = sorted((i, j, h.count(n), h.index(n) + 1) for i, n in short for j, h in long if n and h and n in h)
    assert rows(made, "i", "j", "hits", "first") == want
    assert needles.substring_join(spark.createDataFrame([], "i int, n string"), spark.createDataFrame(long, "j int, h string"), "n", "h", most=most).count() == 0


def test_texts_are_not_shuffled_for_needles(spark):
    short, long = spark.createDataFrame([("a",)], "n string"), spark.range(10).selectExpr("id", "cast(id AS string) AS h")
    plan = needles.substring_join(short, long, "n", "h").select("n", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_weighted_matches_against_brute_force(spark):
    """All pairs over the threshold and none else, from far fewer candidates than pairs."""
    rng = random.Random(6)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    names = sorted({"".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(300)})
    names += [n + rng.choice(syllables) for n in names[:60]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(998, ""), (999, None)], "id int, name string")
    grams = T.grams12(F.col("name"))
    weights = S.gram_idf(df, grams)
    w = {r["gram"]: r["w"] for r in weights.collect()}
    sets = {i: {n[a : a + b] for b in (1, 2) for a in range(len(n) - b + 1)} for i, n in enumerate(names)}
    for least in (0.5, 0.8, 1.0):
        want = set()
        for i, a in sets.items():
            for j, b in sets.items():
                if sum(w[g] for g in a & b) >= least * sum(w[g] for g in a) * (1 - 1e-9):
                    want.add((i, j))
        made = S.weighted_matches(df, df, "id", "id", grams, grams, weights, least).collect()
        assert {(r["left_id"], r["right_id"]) for r in made} == want and len(made) == len(want)
        assert all(abs(r["hit"] - sum(w[g] for g in sets[r["left_id"]] & sets[r["right_id"]])) < 1e-9 for r in made)
    candidates = S.prefix_candidates(df, df, "id", "id", grams, grams, weights, 0.8)[0].count()
    assert candidates < 0.05 * len(names) ** 2


def test_bills_without_services_and_with_given_features(spark):
    asked = spark.createDataFrame(
        [(1, "010101001", "土方 厚度", None), (2, "bad", "x", None), (3, None, "x", None), (4, "010101001", "厚度", ["材质"]), (5, "010101001", "", ["厚度", "材质"])], "id int, code string, feature string, provided array<string>"
    )
    truth = spark.createDataFrame([("010101001", ["厚度", "材质"])], "code9 string, required array<string>")
    found = spark.createDataFrame([(i, "010101001", 0.95) for i in (1, 3, 4)], "id int, candidate string, score double")

    def run(t, c):
        return {r["id"]: (r["status"], r["verdict"], [f["type"] for f in r["findings"]], r["selected"]) for r in K.match_bills(asked, t, c).collect()}

    assert run(truth, found) == {
        1: ("done", "doubt", ["missing_feature"], None), 2: ("done", "fail", ["code_format"], None), 3: ("done", "doubt", ["missing_feature"] * 2, "010101001"),
        4: ("done", "doubt", ["missing_feature"], None), 5: ("done", "pass", [], None),
    }
    no_truth = run(None, found)
    assert no_truth[1] == ("blocked", None, ["truth_unavailable"], None) and no_truth[2] == ("done", "fail", ["code_format"], None) and no_truth[3][0] == "done"
    no_candidates = run(truth, None)
    assert no_candidates[1] == ("done", "doubt", ["missing_feature", "recall_unavailable"], None) and no_candidates[3] == ("blocked", None, [], None)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_bm25_against_all_scores(spark, k):
    """The k best of all scores, with frequent terms, ties, fewer documents than k and repeated query words."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    share = [1 / (1 + i) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, share, k=rng.choice([3, 10, 40])))) for i in range(150)] + [(200 + i, "w1 w2 w40") for i in range(12)] + [(300, ""), (301, None)]
    queries = [(i, " ".join(rng.choices(words, share, k=rng.choice([1, 4, 12])))) for i in range(20)] + [(50, "w40 w40 w1"), (51, "nothing"), (52, None)]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    tokens = F.split(F.coalesce("text", F.lit("")), " ")
    size = [len((t or "").split()) for _, t in docs]
    args = (S.postings(d, "id", tokens, S.query_terms(q, tokens)), q, "q", tokens, len(docs), sum(size) / len(size))
    every = S.bm25(*args, k=None)
    want = R.top_per(every, ["query_id"], k, F.desc("score"), "id")
    assert rows(S.bm25(*args, k=k), "query_id", "rank", "id", "score") == rows(want, "query_id", "rank", "id", "score")


def test_pruning_of_chains_and_cycles(spark):
    """A chain of 300, a cycle, branches; against a walk from every good node."""
    edges = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("b1", "c100"), ("b2", "b1"), ("b3", "c299"), ("lone", None), ("own", "own")]
    up = dict(edges)
    for good in ({"c150", "b2"}, {"y"}, {"b3", "lone"}, set(), {"own"}):
        want = set()
        for n in good:
            while n is not None and n not in want:
                want.add(n)
                n = up[n]
        df = spark.createDataFrame(edges, "node string, parent string")
        some = F.col("node").isin(*good) if good else F.lit(False)
        assert {r["node"] for r in C.pruned(df, some, F.lit(False)).collect()} == want


def test_overlaps_keep_types(spark):
    rows_of = [(1, "k", 9.0, 10.0), (2, "k", 10.0, 100.0), (3, "k", 99.0, None), (4, "k", 200.0, 201.0), (5, "q", 1.0, None), (6, "q", 1.0, None), (7, "r", 5.0, 6.0)]
    made = R.overlaps(spark.createDataFrame(rows_of, "id int, k string, a double, b double"), ["k"], "a", "b", "id")
    assert made.columns == ["id", "k", "a", "b"] and rows(made, "id") == [(3,), (4,), (6,)]


def test_clause_forms():
    text = "\n".join(
        ["# 1 总则 3", "# 1总则", "1.0.1混凝土", "# 2 术语", "## 2.1术语", "## 2.1.1 结构", "2.1.1.1 细目", "## 2 大偏心", "接上", "2.1.1.1.1 不是条款", "附录E 雪压", "## E.1 基本雪压", "表", "E.1.2.3.4 深", "## E.5 全国", "附: 条文说明", "9.9.9 后"]
    )
    made = {c["clause_no"]: (c["chapter_path"], c["text"]) for c in C.clauses_of(text)}
    assert made == {
        "1.0.1": (["1 总则"], "1.0.1混凝土"),
        "2.1.1": (["2 术语", "2.1 术语"], "2.1.1 结构"),
        "2.1.1.1": (["2 术语", "2.1 术语"], "2.1.1.1 细目\n## 2 大偏心\n接上\n2.1.1.1.1 不是条款"),
        "E.1": (["附录E 雪压"], "E.1 基本雪压\n表"),
        "E.1.2.3.4": (["附录E 雪压"], "E.1.2.3.4 深"),
        "E.5": (["附录E 雪压"], "E.5 全国"),
    }


def test_null_keys_are_equal_in_updates(spark):
    old = spark.createDataFrame([("a", None, 1), (None, None, 2)], "k string, s string, v int")
    new = spark.createDataFrame([("a", None, 9), (None, None, 8), (None, None, 7)], "k string, s string, v int")
    assert rows(R.upsert(old, new, ["k", "s"], "v"), "k", "v") == [("a", 9), (None, 7)]
    assert rows(R.insert_absent(old, new, ["k", "s"]), "k", "v") == [("a", 1), (None, 2)]
    assert R.upsert(old.limit(0), new.limit(0), ["k", "s"]).count() == 0


def test_deletes_keep_unknown_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert rows(R.without(df, F.col("v") == "x"), "id") == [(2,)]


def test_overlaps_half_open(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2026, 1, 1), d(2026, 2, 1)), ("a", d(2026, 2, 1), d(2026, 3, 1)), ("b", d(2026, 1, 1), None), ("b", d(2026, 5, 1), d(2026, 6, 1))], "k string, s date, e date")
    assert rows(R.overlaps(df, ["k"], "s", "e"), "k", "s") == [("b", d(2026, 5, 1))]


def test_limits_and_scopes():
    assert [R.clamped(x) for x in (None, 0, 5, 500, -3)] == [20, 20, 5, 100, 1]
    with pytest.raises(ValueError):
        R.owned(None, None)


def cosines(v):
    u = v.astype(np.float32).astype(float)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
    return np.round(u @ u.T, 6)


def best_rows(s, k, within=None):
    """(query, rank, id, score) of the k best by the definition."""
    n = len(s)
    within = within or (lambda j: True)
    return sorted((i, r + 1, j, -t) for i in range(n) for r, (t, j) in enumerate(sorted((-s[i, j], j) for j in range(n) if j != i and within(j))[:k]))


def vector_rows(spark, v, *more):
    return spark.createDataFrame([(i, [float(x) for x in row], *[m(i) for m in more]) for i, row in enumerate(v)], "id long, v array<float>" + ", g int" * len(more)).repartition(4)


@pytest.mark.parametrize("block, shard", [(4096, 8192), (7, 9)])
def test_nearest_against_brute_force(spark, block, shard):
    """Ties by the dozen, zero vectors, null vectors; blocks and shards of any size."""
    v = np.random.default_rng(3).standard_normal((60, 3)).round(0)
    df = vector_rows(spark, v, lambda i: i % 3)
    found = vectors.nearest(df.unionByName(spark.createDataFrame([(99, None, 1)], df.schema)), df, 3, "id", "id", "v", block_rows=block, shard_rows=shard)
    assert sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect())) == best_rows(cosines(v), 3)
    grouped = vectors.nearest(df, df, 2, "id", "id", "v", block_rows=block, shard_rows=shard, group="g")
    for g in range(3):
        made = grouped.where(F.col("g") == g).select("query_id", "rank", "id", "score").collect()
        assert sorted(map(tuple, made)) == best_rows(cosines(v), 2, lambda j, g=g: j % 3 == g)
    assert vectors.nearest(df.limit(0), df, 3, "id", "id", "v").count() == 0 == vectors.nearest(df, df.limit(0), 3, "id", "id", "v").count()


def test_nearest_has_as_many_jobs_for_many_blocks(spark):
    df = vector_rows(spark, np.random.default_rng(1).standard_normal((50, 4)))
    tracker = spark.sparkContext.statusTracker()

    def jobs(block):
        name = f"nearest-{block}"
        spark.sparkContext.setJobGroup(name, name)
        vectors.nearest(df, df, 3, "id", "id", "v", block_rows=block).collect()
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(2) <= jobs(5000) + 2


def test_cells_against_brute_force(spark):
    v = np.random.default_rng(5).standard_normal((80, 4))
    df = vector_rows(spark, v)
    every = vectors.nearest_in_cells(df, df, 4, "id", "id", "v", cells=6, probes=6)
    assert sorted(map(tuple, every.select("query_id", "rank", "id", "score").collect())) == best_rows(cosines(v), 4)


def test_neighbours_are_merged_by_tiles(spark):
    """Candidates grow with the tiles, not with the shards, and queries of cells are packed once, not once a probe."""
    before = set(stored(spark))
    df = vector_rows(spark, np.random.default_rng(6).standard_normal((60, 3)))
    assert vectors.nearest(df, df, 3, "id", "id", "v", block_rows=30, shard_rows=2).count() == 180
    assert vectors.nearest_in_cells(df, df, 3, "id", "id", "v", cells=6, probes=5).count() == 180
    made = {label: sum(spark.read.parquet(f).agg(F.sum(x)).first()[0] for f in set(stored(spark)) - before if f.rsplit("/", 1)[-1].startswith(label)) for label, x in (("tops", F.lit(1)), ("blocks", F.col("n")))}
    assert made["tops"] <= 60 * 3 * (vectors.TILES + 1) and made["blocks"] == 2 * 60


def test_shards_are_copied_by_groups_of_blocks(spark):
    blocks, shards = spark.range(40).selectExpr("CAST(id AS INT) AS block"), spark.range(3).selectExpr("CAST(id AS INT) AS shard")
    met = vectors._met(blocks, shards, 40, 3)
    assert rows(met, "block", "shard") == sorted(((b, s) for b in range(40) for s in range(3)), key=repr)
    assert met.rdd.getNumPartitions() == 12 * 3


def stored(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return [f"{root}/{f}" for f in os.listdir(root)]


@pytest.mark.parametrize("clustered", [False, True])
def test_graph_search_recall_and_effort(spark, clustered):
    """At least 0.9 of the ten nearest, comparing under a fifth of the vectors, in one and in several shards; scores are exact."""
    draw = np.random.default_rng(8)
    v = draw.standard_normal((4000, 16))
    v = v * 0.3 + draw.standard_normal((20, 16))[draw.integers(0, 20, 4000)] if clustered else v
    v[100:110] = v[50]  # repeated vectors
    df = vector_rows(spark, v)
    asked = df.where("id % 20 = 0")
    s = cosines(v)
    for shard in (16384, 2000):
        found = vectors.graph_search(vectors.graph_index(df, "id", "v", shard), asked, 10, "id", "v").collect()
        hits = sum(s[r["query_id"], r["id"]] >= np.sort(np.delete(s[r["query_id"]], r["query_id"]))[-10] for r in found)
        assert len(found) == 2000 and hits >= 0.9 * 2000
        assert all(abs(r["score"] - s[r["query_id"], r["id"]]) < 2e-6 for r in found)
        effort = sum({r["query_id"]: r["compared"] for r in found}.values()) / 200 / 4000
        assert effort < (0.2 if shard > 4000 else 0.4)


def test_graph_of_few_vectors(spark):
    df = vector_rows(spark, np.array([[1.0, 0], [1, 0], [0, 1]]))
    found = vectors.graph_search(vectors.graph_index(df, "id", "v"), df, 10, "id", "v")
    assert rows(found, "query_id", "rank", "id") == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert vectors.graph_search(vectors.graph_index(df.limit(0), "id", "v"), df, 10, "id", "v").count() == 0


def test_queries_walk_together(spark):
    """Many queries at once come to the nodes, and compare as many vectors, as one by one with heaps; a query has one row for a tile of shards, not for each."""
    draw = np.random.default_rng(3)
    v = draw.standard_normal((900, 12))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    shard = pd.DataFrame([{"shard": 0, "n": 900, "ids": np.arange(900).astype("<i8").tobytes(), "vectors": unit.astype("<f8").tobytes()}])
    g = vectors._Graph(next(next(vectors._graph(iter([shard]))).itertuples(index=False)))
    near = [{n: [x for x in links[place[n]].tolist() if x >= 0] for n in range(900)} for place, links in g.layers]

    def alone(q, width):
        s = np.einsum("ij,ij->i", g.fast, np.repeat(q[None], 900, axis=0)).tolist()
        at, compared = g.top, 1
        for layer in near[:0:-1]:
            while layer[at]:
                compared += len(layer[at])
                up = max(layer[at], key=s.__getitem__)
                if s[up] <= s[at]:
                    break
                at = up
        seen, todo, best = {at}, [(-s[at], at)], [(s[at], at)]
        while todo:
            at = heapq.heappop(todo)[1]
            if len(best) >= width and s[at] < best[0][0]:
                break
            for n in near[0][at]:
                if n not in seen:
                    seen.add(n)
                    compared += 1
                    if len(best) < width or s[n] > best[0][0]:
                        heapq.heappush(best, (s[n], n))
                        heapq.heappush(todo, (-s[n], n))
                        if len(best) > width:
                            heapq.heappop(best)
        return sorted(n for _, n in best), compared

    asked = draw.standard_normal((70, 12)).astype(np.float32)
    for width in (1, 16, 40):
        nodes, compared = g.walk(asked, width)
        assert [(sorted(n), c) for n, c in zip(nodes.tolist(), compared.tolist(), strict=True)] == [alone(q, width) for q in asked]

    before = set(stored(spark))
    v[500:600] = v[:100]  # repeated vectors
    df = vector_rows(spark, v[:600])
    found = vectors.graph_search(vectors.graph_index(df, "id", "v", 20), df.where("id < 40"), 5, "id", "v").collect()
    s = cosines(v[:600])
    hits = sum(s[r["query_id"], r["id"]] >= np.sort(np.delete(s[r["query_id"]], r["query_id"]))[-5] - 2e-6 for r in found)
    assert len(found) == 200 and hits >= 198
    assert all(r["compared"] >= 500 for r in found)
    walked = [f for f in set(stored(spark)) - before if f.rsplit("/", 1)[-1].startswith("walked")]
    assert 40 <= sum(spark.read.parquet(f).count() for f in walked) <= 40 * vectors.TILES


def test_greedy_dedup_against_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), i, [rng.choice((0.0, 1.0)), rng.choice((0.0, 1.0)), rng.choice((0.5, 1.0))], rng.choice((None, 0.2, 0.9))) for i in range(40)]
    df = spark.createDataFrame(data, "g string, id int, v array<double>, q double")
    made = {r["id"]: r["kept"] for r in C.greedy_dedup_by_quality(df, "g", "id", "v", 0.9, "q", "5").collect()}
    plain = {r["id"]: r["kept"] for r in C.greedy_dedup(df, "g", "id", "v", 0.9, "5").collect()}
    same = {r["id"]: r["kept"] for r in C.greedy_dedup_by_quality(df.withColumn("q", F.lit(0.0)), "g", "id", "v", 0.9, "q", "5").collect()}
    assert plain == same and not all(same.values())
    import hashlib

    def cos(a, b):
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / max(np.linalg.norm(a), 1e-9) / max(np.linalg.norm(b), 1e-9)), 9)

    for g in "ab":
        part = sorted((hashlib.md5(f"5:{g}:{i}".encode()).hexdigest(), i, v, q or 0.0) for gg, i, v, q in data if gg == g)
        keep = [True] * len(part)
        for i, a in enumerate(part):
            if not keep[i]:
                continue
            for j in range(i + 1, len(part)):
                if keep[j] and cos(a[2], part[j][2]) > 0.9:
                    if a[3] >= part[j][3]:
                        keep[j] = False
                    else:
                        keep[i] = False
                        break
        assert {p[1]: k for p, k in zip(part, keep, strict=True)} == {i: made[i] for _, i, _, _ in part}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x", ["b", "a"]), ("y", [])], "id string, refs array<string>")
    b = spark.createDataFrame([("y", []), ("x", ["a", "b"])], "id string, refs array<string>")
    c = spark.createDataFrame([("y", []), ("x", ["a", "c"])], "id string, refs array<string>")
    digest = lambda df: C.fingerprint(df, "id", "refs").first()["fingerprint"]
    assert digest(a) == digest(b) != digest(c)
    assert C.fingerprint(a.limit(0), "id", "refs").first()["rows"] == 0


def test_ancestors_end_in_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "node string, parent string")
    made = {(r["node"], r["ancestor"]) for r in C.ancestors(df).collect()}
    assert made == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", y) for y in "abc"}


def test_chains_of_any_length(spark, tmp_path):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "node int, parent int")
    made = {(r["node"], r["ancestor"]): r["up"] for r in C.ancestors(df).collect()}
    assert made == {(i, j): i - j for i in range(150) for j in range(i)}
    assert C.pruned(df, F.col("node") == 149, F.lit(False)).count() == 150
    assert {r["node"]: (r["root"], r["depth"]) for r in C.roots(df).collect()} == {i: (0, i) for i in range(1, 150)}
    looped = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("g", "g")], "node string, parent string")
    assert {tuple(r) for r in C.roots(looped).collect()} == {(x, None, None) for x in "abcd"} | {("e", "f", 1)}
    assert C.roots(looped.limit(0)).count() == 0
    orders = [(i, 7) for i in range(1, 301)] + [(i, i % 5) for i in range(1000, 1020)] + [(5000, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["node"]: (r["depth"], r["root"]) for r in order_ancestry(spark, str(tmp_path)).collect()}
    assert found == {i: (i - 1, 1) for i in range(2, 301)} | {i: ((i - 1000) // 5, 1000 + i % 5) for i in range(1005, 1020)}


def test_table_grids_with_ragged_spans():
    html = "<table><tr><td rowspan='3'>a</td><td>b</td></tr><tr><td rowspan=2 colspan=2>c</td></tr><tr></tr></table>"
    assert C.table_grids(html) == [[["a", "b", ""], ["a", "c", ""], ["a", "c", ""]]]
    assert C.table_grids(None) == [] and C.table_grids("<table></table>") == [[]]


def test_segmentation_keeps_the_longest_and_ignores_foreign_headings():
    found = C.clauses_of("# 1 总则\n1.0.1 短\n## 6 大偏心\n文\n1.0.1 更长的条文内容\n# 3 乱\n# 2 术语\n2.0.1 x")
    assert [(c["clause_no"], c["chapter_path"]) for c in found] == [("1.0.1", ["1 总则"]), ("2.0.1", ["2 术语"])]
    assert "更长" in found[0]["text"] and C.clauses_of(None) == []


def test_half_cents_round_up_on_decimals(spark):
    parts = spark.createDataFrame([("k", "人工", 1.0, 0.125), ("k", "别的", 1.0, 1.005), ("k", "材料", None, 3.0)], "k string, category string, consumption double, unit_price double")
    r = K.unit_rates(parts, ["k"]).first()
    assert (r["labor"], r["other"], r["rmm"], r["unit_price"], r["skipped"], r["rates_missing"]) == (0.13, 1.01, 1.14, 1.14, 1, True)


def test_loop_flags_match_a_queue(spark):
    from collections import Counter, deque

    rng = random.Random(6)
    data = [(i, rng.choice("uv"), rng.choice("abc")) for i in range(80)]
    made = {r["id"]: (r["recent"], r["flag"]) for r in V.loop_flags(spark.createDataFrame(data, "id int, t string, w string"), "t", "id", "w", 5, 3, 4).collect()}
    seen = {"u": deque(maxlen=5), "v": deque(maxlen=5)}
    for i, t, w in data:
        seen[t].append(w)
        n = Counter(seen[t])[w]
        assert made[i] == (n, "stop" if n >= 4 else "warn" if n >= 3 else None)


def test_pending_rejects_foreign_results(spark):
    expected, ids = spark.createDataFrame([(1,), (2,)], "id int"), lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(V.pending(expected, ids(1), "id")) == [(2,)]
    for bad in (ids(1, 1), ids(7)):
        with pytest.raises(ValueError):
            V.pending(expected, bad, "id")


def test_json_equality_refuses_unsafe_filters():
    for key, value, kind in (("a b", 1, ValueError), ("a", 2**63, TypeError), ("a", [1], TypeError)):
        with pytest.raises(kind):
            U.json_equals(F.lit("{}"), key, value)


def test_text_edge_cases(spark):
    assert one(spark, T.grams(F.lit("a"))) == ["a"] and one(spark, T.grams(F.lit(None).cast("string"))) == []
    assert one(spark, T.truncate_bytes(F.lit("aé" * 5), 4, "…")) == "aéa…"
    assert one(spark, T.coverage(T.grams(F.lit("")), T.grams(F.lit("ab")))) == 0.0
    assert one(spark, T.marker_penalty(F.lit("预制柱"), F.lit("柱"), ["预制", "现浇"])) == pytest.approx(0.1)
    assert one(spark, U.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_statistics_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([("a", 1.0)], "c string, v double")
    assert E.spread_by(df, "c", "v").first()["stddev"] == 0.0
    assert profile.summary(df.limit(0)).count() == 2
    empty = E.summarize(E.score_answers(*_answer_frames(spark)).limit(0))
    assert empty.count() == 0


def _answer_frames(spark):
    evals = spark.createDataFrame([], "id int, type string, question string, gold_clauses array<string>, gold_values array<string>, should_refuse boolean")
    return evals, spark.createDataFrame([], "id int, model_id string, answer string, finish_reason string, completion_tokens int")
