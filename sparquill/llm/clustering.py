"""Operator 13, centroid clustering: exact integer k-means whose nearest centroids are screened in float32.

1. Vectors of ``size`` finite components become integers floor(``scale`` * x), taken as doubles, and are written once.
2. The first centroids are the ``k`` vectors with the least hash of their id. Each round, every Arrow batch of vectors
   is multiplied with the centroids in float32. Rounding of the inputs and of a dot product of n terms, summed in
   whatever order, is at most gamma(n + 2) * |x| |c| with gamma(m) = m u / (1 - m u), u = 2**-24 (Cauchy-Schwarz bounds the
   sum of absolute products), so every squared distance less |x|**2 lies in a known interval. Centroids whose interval
   begins above the least end of all intervals can't be nearest. Where one interval is left it is the answer; where
   intervals overlap, those centroids are computed again in 64-bit integers, and the smaller number wins a tie.
3. A task hands on exact sums and counts, a row per centroid that it met; Spark adds them up, and ``k`` rows reach the
   driver. New centroids are floor(sum / count), exact in Python's integers. Centroids (``k`` times ``size`` numbers) are
   all that is ever broadcast, and batches are cut so that a product has at most ``CELLS`` numbers.

Edge cases: null vectors, vectors of another length and vectors with a null, NaN or infinite component are left out;
rows with equal ids are vectors of their own, ties of the hash go to the lesser integer vector; null ids are hashed last
and come out as null; fewer than ``k`` vectors make as many centroids; an empty table gives an empty result; a centroid
without vectors stays where it is; only the named columns are read, so further columns of any name do no harm. Integers
beyond 2**27 (x beyond half a million at scale 256) would overflow the contract's 64-bit distances: they end the job with
an error that says so. Centroids are tied to the driver, vectors never: a lost executor's batches are simply read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import materialize

SIZE, SCALE = 64, 256
CELLS = 1 << 21
MOST = 1 << 27
UNIT = 2.0**-24


def _whole(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(id, v): the kept vectors as little-endian 32-bit integers."""
    for batch in batches:
        lists = batch.column("v")
        if not len(lists):
            continue
        fits = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
        batch = batch.take(pa.array(fits))
        values = batch.column("v").flatten()
        x = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
        good = np.flatnonzero(np.isfinite(x).all(axis=1))
        whole = np.floor(scale * x[good])
        if np.abs(whole).max(initial=0) > MOST:
            raise ArithmeticError(f"a component of a vector is beyond {MOST // scale}: its squared distance may not fit 64 bits")
        ids = batch.column("id").take(pa.array(good))
        blobs = whole.astype("<i4").view(f"V{4 * size}").reshape(-1).tolist()
        yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], ["id", "v"])


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors of ``size`` finite components as packed integers floor(``scale`` * x), written once."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(lambda b: _whole(b, size, scale), f"id {kind}, v binary"), "vectors")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<i4", (int(at[-1]) - int(at[0])) // 4, int(at[0])).reshape(-1, size) if len(column) else np.empty((0, size), "<i4")


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, contenders) of each row of integers: the nearest centroid, exactly, the smaller number on a tie.

    ``contenders`` counts the centroids that the float32 intervals leave; only where it is over 1 are centroids compared in integers.
    """
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    n = x.shape[1]
    gamma = (n + 2) * UNIT / (1 - (n + 2) * UNIT)
    c2 = (c * c).sum(axis=1).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(c2)[None, :]
    middle = c2[None, :] - 2.0 * (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    # what float32 may be off, and what the float64 arithmetic of this line and the one before may add, with room to spare
    radius = 2.0 * gamma * norms * (1 + 2.0**-40) + 2.0**-48 * (c2[None, :] + 2.0 * norms) + 1e-30
    left = middle - radius <= (middle + radius).min(axis=1, keepdims=True)
    contenders = left.sum(axis=1)
    cluster = left.argmax(axis=1)
    open_rows = np.flatnonzero(contenders > 1)
    if len(open_rows):
        row, centroid = np.nonzero(left[open_rows])  # by row, then by number of the centroid
        d = np.empty(len(row), np.int64)
        for at in range(0, len(row), CELLS // n):
            some = slice(at, at + CELLS // n)
            diff = x[open_rows[row[some]]] - c[centroid[some]]
            d[some] = (diff * diff).sum(axis=1)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == least[row])
        cluster[open_rows] = centroid[hit[np.append(True, row[hit][1:] != row[hit][:-1])]]
    diff = x - c[cluster]
    return cluster, (diff * diff).sum(axis=1), contenders


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    step = max(1, CELLS // max(centroids.shape))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            x = _matrix(some.column("v"), centroids.shape[1])
            yield some, x, *assign(x, centroids)


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for _, x, cluster, _, _ in _parts(batches, c):
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            total[met] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            count += np.bincount(cluster, minlength=len(c))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _labels(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, cluster, d, contenders in _parts(batches, shared.value):
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(cluster.astype(np.int32)), pa.array(d), pa.array(contenders.astype(np.int32))], ["id", "cluster", "distance", "contenders"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The vectors with the ``k`` least hashes of ``seed:id``, in that order; this is k rows on the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), F.hex("v")).limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64).reshape(-1, size)


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = SIZE) -> np.ndarray:
    """The centroids, integers, after ``rounds`` rounds over all of ``integer_vectors``."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed, size)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)
        parts = vectors.select("v").mapInArrow(_sums(shared), "cluster int, n long, total array<long>")
        sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size)]
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
        shared.unpersist()
    return centroids


def predict(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, contenders) of every vector."""
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, contenders int")
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    return vectors.mapInArrow(_labels(shared), f"id {kind}, cluster int, distance long, contenders int")


def clusters(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id_col, cluster, distance, contenders, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    vectors = integer_vectors(table, id_col, vector_col, size, scale)
    centroids = fit(vectors, k, rounds, seed, size)
    labelled = materialize(predict(vectors, centroids), "labelled")
    inertia = {r["cluster"]: r["d"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = [(c, d, sum(inertia.values()), name(c)) for c, d in inertia.items()]
    facts = table.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = labelled.join(F.broadcast(facts), "cluster")  # a row per centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "contenders", "cluster_inertia", "inertia", "centroid_sha256")
