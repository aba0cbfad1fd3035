"""Operator 13 against plain Python integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from sparquill.llm import clustering


def brute(rows, k, rounds, seed=2, size=64):
    """(id, cluster, distance) by the definition, and the centroids."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def test_same_as_plain_integers(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 1 + i % 3, 64)]) for i in range(300)]
    rows += [(900 + i, rows[i % 7][1]) for i in range(60)]  # repeated vectors
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(5)
    want, centroids = brute(rows, 12, 4)
    got = clustering.clusters(table, k=12, rounds=4).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    total = sum(d for *_, d in want)
    by = {c: sum(d for _, x, d in want if x == c) for _, c, _ in want}
    for r in got:
        assert (r["inertia"], r["cluster_inertia"]) == (total, by[r["cluster"]])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("high", [3, 1000, 1 << 27])
def test_screening_is_exact(high):
    """Ties and near ties at every magnitude: the float32 intervals never lose the nearest centroid."""
    draw = np.random.default_rng(high)
    c = draw.integers(-high, high + 1, (40, 64))
    c[7], c[21] = c[3], c[3] + (np.arange(64) == 5)
    x = np.concatenate((draw.integers(-high, high + 1, (200, 64)), (c[draw.integers(0, 40, 200)] + c[draw.integers(0, 40, 200)]) // 2, c))
    cluster, d, contenders = clustering.assign(x, c)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert cluster.tolist() == [e.index(min(e)) for e in exact] and d.tolist() == [min(e) for e in exact]
    assert (contenders >= 1).all() and (contenders > 1).any()


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert clustering.clusters(spark.createDataFrame([], kind)).count() == 0
    assert clustering.clusters(spark.createDataFrame([(1, None)], kind)).count() == 0
    two = clustering.clusters(spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [1.0] * 64)], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in two) == [(0, 0), (1, 0), (1, 0)] and len({r["cluster"] for r in two}) == 2


def test_empty_centroid_stays_and_huge_values_are_an_error(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(50)]
    got = clustering.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=10).collect()
    assert {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 2
    with pytest.raises(Exception, match="beyond"):
        clustering.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))
