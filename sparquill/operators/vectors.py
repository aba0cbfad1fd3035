"""Vector neighbours by cosine: exact by blocked products, and approximate by layered neighbour graphs.

Vectors are held in packed rows: query vectors in blocks, points in shards, both of bounded size and drawn by a hash of the
id. Many blocks and many shards are dealt to a tile, which is one task, for products as for walks in graphs. Spark merges the
``k`` best of the tiles. The number of jobs does not depend on the number of queries.

Null vectors are left out on both sides; a vector of zeros is 0 from everything; ids are integers; a query is not its
own neighbour (by id); vectors of one call have one length. Scores have 6 places, ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.relational import small, top_per
from sparquill.sources.scratch import ONE_ROW_GROUPS, arrow_rows, written

#: Rows of a packed block of queries and of a packed shard of points, for products.
BLOCK_ROWS, SHARD_ROWS = 4096, 8192
#: Numbers of a product that is held at once.
CELLS = 1 << 21
#: Tiles on a side of the square of all pairs, and rows of a tile's side from which on there are more.
TILES, TILE_ROWS = 12, 1 << 17


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _vectors(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<f8").reshape(n, -1)


# ---- packing


def _packer(keys: list[str], most: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        now = None

        def done() -> pd.DataFrame:
            held.sort(key=lambda r: r[0])
            ids, v = np.array([i for i, _ in held], "<i8"), _unit(np.stack([v for _, v in held])).astype("<f8")
            return pd.DataFrame([{**dict(zip(keys, now, strict=True)), "n": len(held), "ids": ids.tobytes(), "vectors": v.tobytes()}])

        for batch in batches:
            for row in batch[[*keys, "id", "v"]].itertuples(index=False, name=None):
                if held and (row[:-2] != now or len(held) >= most):
                    yield done()
                    held.clear()
                now = row[:-2]
                held.append(row[-2:])
        if held:
            yield done()

    return run


def _packed(df: DataFrame, id_col: str, vector: str, key: str, rows: int, label: str, group: str | None = None, most: int | None = None) -> tuple[DataFrame, int]:
    """(key[, grp], n, ids, vectors) of about ``rows`` vectors a row, sorted by id, and how many values ``key`` has (0, 1, ...)."""
    kept = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")]
    keys, kinds = [key], f"{key} int"
    if group is not None:
        kept = kept.where(F.col(group).isNotNull())
        columns.append(F.col(group).cast("string").alias("grp"))
        keys, kinds = [key, "grp"], f"{key} int, grp string"
    slots = max(1, -(-kept.count() // rows))
    cut = kept.select(*columns).withColumn(key, F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))
    cut = cut.repartition(slots, *keys).sortWithinPartitions(*keys)
    packed = cut.mapInPandas(_packer(keys, most or 2 * rows), f"{kinds}, n int, ids binary, vectors binary")
    return written(packed, label, **ONE_ROW_GROUPS), slots


def _met(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int) -> DataFrame:
    """Every block with every shard, by an equi-join; a shard is copied once for each of ``TILES`` groups of blocks, which are as many tasks."""
    groups = min(n_blocks, TILES)
    of_group = shards.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups * n_shards, "shard", "_group")
    grouped = blocks.withColumn("_group", (F.col("block") % groups).cast("int"))
    if small(blocks) is not blocks:
        return of_group.join(F.broadcast(grouped), "_group").drop("_group")
    return of_group.join(grouped.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))), ["shard", "_group"]).drop("_group")


# ---- exact


class _Best:
    """The ``k`` best points so far of every query of a block, ties to the lesser id; scores are held in millionths.

    Products in single precision and a bound of their error leave candidates, which are scored in double precision.
    """

    NONE = -2_000_000

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.q_ids, self.v, self.fast, self.k = ids, v, v.astype(np.float32), k
        self.slack = np.float32((v.shape[1] + 8) * 2.0**-23 + 2e-6)
        self.clear()

    def clear(self) -> None:
        self.ids, self.scores = np.zeros((len(self.v), self.k), np.int64), np.full((len(self.v), self.k), self.NONE, np.int64)

    def offer(self, p_ids: np.ndarray, p: np.ndarray, p_fast: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Points in ascending order of their ids, to all queries or to those at ``rows``."""
        rows = np.arange(len(self.v)) if rows is None else rows
        if not len(rows):
            return
        q = self.fast if len(rows) == len(self.v) else self.fast[rows]
        step = max(self.k, CELLS // len(rows))
        for at in range(0, len(p_ids), step):
            some = p_ids[at : at + step]
            s = q @ p_fast[at : at + step].T
            near = s >= (self.scores[rows, -1] / 1e6).astype(np.float32)[:, None] - self.slack
            take = min(self.k, len(some))
            if np.count_nonzero(near) > 8 * self.k * len(rows):
                s[self.q_ids[rows][:, None] == some[None, :]] = -2
                near &= s >= np.partition(s, len(some) - take, axis=1)[:, len(some) - take, None] - 2 * self.slack
            if np.count_nonzero(near) > 8 * self.k * len(rows):  # equal scores by the dozen
                exact = np.rint(self.v[rows] @ p[at : at + step].T * 1e6).astype(np.int64)
                exact[self.q_ids[rows][:, None] == some[None, :]] = self.NONE
                order = exact * len(some) - np.arange(len(some))  # all different: by score, then by id
                j = np.argpartition(order, len(some) - take, axis=1)[:, len(some) - take :].ravel()
                i = np.repeat(np.arange(len(rows)), take)
                self.merge(rows[i], some[j], exact[i, j])
                continue
            i, j = np.divmod(np.flatnonzero(near), len(some))  # far quicker than nonzero of two axes
            exact = np.empty(len(i), np.int64)
            for a in range(0, len(i), 1 << 14):
                exact[a : a + (1 << 14)] = np.rint(np.einsum("ij,ij->i", self.v[rows[i[a : a + (1 << 14)]]], p[at + j[a : a + (1 << 14)]]) * 1e6)
            self.merge(rows[i], some[j], exact)

    def merge(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """More points of the queries ``at``, which ascend."""
        last, last_id = self.scores[at, -1], self.ids[at, -1]
        kept = (ids != self.q_ids[at]) & ((scores > last) | ((scores == last) & (ids < last_id)))
        at, ids, scores = at[kept], ids[kept], scores[kept]
        hit, row = np.unique(at, return_inverse=True)
        row = np.concatenate((np.repeat(np.arange(len(hit)), self.k), row))
        ids, scores = np.concatenate((self.ids[hit].ravel(), ids)), np.concatenate((self.scores[hit].ravel(), scores))
        order = np.lexsort((ids, -scores, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(hit)))[row] < self.k]
        self.ids[hit], self.scores[hit] = ids[best].reshape(-1, self.k), scores[best].reshape(-1, self.k)

    def rows(self, grp: str) -> pd.DataFrame:
        i, j = np.nonzero(self.scores > self.NONE)
        return pd.DataFrame({"query_id": self.q_ids[i], "grp": grp, "id": self.ids[i, j], "score": self.scores[i, j] / 1e6})


def _multiplied(k: int, grouped: bool, center: np.ndarray | None = None, probes: int = 0) -> Callable:
    """Of each tile its blocks, which are held, with its shards one by one; with ``center`` a query meets only shards of its ``probes`` nearest cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[_Best, np.ndarray | None]] = []
        tile = grp = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.tile != tile or (grouped and r.grp != grp):
                    for b, _ in held:
                        yield b.rows(grp)
                        b.clear()
                    grp = r.grp if grouped else ""
                if r.tile != tile:
                    tile = r.tile
                    held.clear()
                ids, v = np.frombuffer(r.ids, "<i8"), _vectors(r.vectors, r.n)
                if r.side == 0:
                    cells = None if center is None else np.argsort(-(v @ center.T), axis=1, kind="stable")[:, :probes]
                    held.append((_Best(ids, v, k), cells))
                    continue
                fast = v.astype(np.float32)
                for b, cells in held:
                    b.offer(ids, v, fast, None if cells is None else np.flatnonzero((cells == int(r.grp)).any(axis=1)))
        for b, _ in held:
            yield b.rows(grp)

    return run


_TOPS = "query_id long, grp string, id long, score double"


def _tiled(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int, block_rows: int, shard_rows: int, run: Callable, kind: str = _TOPS, label: str = "tops", more: list[str] | None = None) -> DataFrame:
    """What ``run`` makes, (query_id, grp, id, score) by default: every block with every shard, in tiles of many blocks by many shards.

    A tile is shuffled to one task, so a row is copied once for each tile on the other side: up to ``TILES`` times, however
    many rows there are, until tiles have ``TILE_ROWS`` rows. ``more`` are further columns of the shards.
    """
    sides = [max(min(n, TILES), -(-n * rows // TILE_ROWS)) for n, rows in ((n_blocks, block_rows), (n_shards, shard_rows))]
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o")
    none = [F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in more or []]
    q = blocks.select(F.lit(0).alias("side"), F.lit("").alias("grp"), "n", "ids", "vectors", *none, (F.col("block") % sides[0] * sides[1]).alias("_t"), other(sides[1]))
    grp = F.col("grp") if "grp" in shards.columns else F.lit("").alias("grp")
    p = shards.select(F.lit(1).alias("side"), grp, "n", "ids", "vectors", *(more or []), (F.col("shard") % sides[1]).alias("_t"), (other(sides[0])))
    p = p.withColumn("_o", F.col("_o") * sides[1])
    both = q.unionByName(p).withColumn("tile", (F.col("_t") + F.col("_o")).cast("int")).drop("_t", "_o")
    dealt = both.repartition(sides[0] * sides[1], "tile").sortWithinPartitions("tile", "side", "grp")
    with arrow_rows(blocks.sparkSession, 1):
        return written(dealt.mapInPandas(run, kind), label)


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str, block_rows: int = BLOCK_ROWS, group: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of every query among all points.

    With ``group``, a column of the points, the k best of every group are found in the same pass, and the result has that
    column; points without a group are left out.
    """
    blocks, n_blocks = _packed(queries, query_id, vector, "block", block_rows, "blocks")
    shards, n_shards = _packed(points, point_id, vector, "shard", shard_rows, "shards", group)
    found = _tiled(blocks, shards, n_blocks, n_shards, block_rows, shard_rows, _multiplied(k, group is not None))
    best = top_per(found, ["query_id", "grp"], k, F.desc("score"), "id")
    return best.drop("grp") if group is None else best.select("query_id", F.col("grp").cast(points.schema[group].dataType).alias(group), "id", "score", "rank")


# ---- layered graphs

#: Links a node gets on its way in, twice as many at most on the lowest layer; vectors looked at for them; nodes of a walk's list.
LINKS, LOOKED_AT, WIDTH = 16, 64, 64
GRAPH_ROWS = 16384
#: Queries that walk together.
WALKS = 512


def _diverse(v: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's neighbours ``near`` (best first, -1 for none) those that are nearer to the node than to any taken before, at most ``most``; others are -1."""
    out = np.full_like(near, -1)
    step = max(1, CELLS // max(1, near.shape[1] ** 2))
    for at in range(0, len(near), step):
        some, s = near[at : at + step], score[at : at + step]
        each = v[some]
        between = each @ each.transpose(0, 2, 1)
        taken = np.zeros(some.shape, bool)
        for c in range(some.shape[1]):
            shadowed = (taken[:, :c] & (between[:, c, :c] > s[:, c, None])).any(axis=1)
            taken[:, c] = (some[:, c] >= 0) & ~shadowed & (taken[:, :c].sum(axis=1) < most)
        out[at : at + step] = np.where(taken, some, -1)
    return out


def _layer(v: np.ndarray, most: int) -> np.ndarray:
    """Links of the vectors of a layer, rows of neighbours padded with -1.

    Vectors come in one after the other and are linked with diverse near ones among those before them, found by blocked
    products; so the first ones get the long links. Links go both ways; too many are thinned out in the same manner.
    """
    n = len(v)
    src, dst, sim = [], [], []
    for at in range(0, n, 512):
        end = min(n, at + 512)
        s = v[at:end] @ v[:end].T
        s[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = -np.inf
        take = min(LOOKED_AT, end)
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        score = np.take_along_axis(s, near, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
        near = _diverse(v, np.where(np.isfinite(score), near, -1), score, LINKS)
        i, j = np.nonzero(near >= 0)
        src.append(i + at)
        dst.append(near[i, j])
        sim.append(score[i, j])
    a, b, s = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
    a, b, s = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    degree = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(degree) - degree, degree)
    width = int(min(max(degree.max(initial=0), 1), 3 * most))
    near, score = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf)
    kept = place < width
    near[a[kept], place[kept]], score[a[kept], place[kept]] = b[kept], s[kept]
    over = np.flatnonzero(degree > most)
    if len(over):
        near[over] = _diverse(v, near[over], score[over], most)
    packed = np.argsort(near < 0, axis=1, kind="stable")
    return np.take_along_axis(near, packed, axis=1)[:, :most].astype("<i4")


def _graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each packed shard, its layers: a vector is on layer l with probability LINKS ** -l; layer 0 has all, the last has one way in."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            v = _vectors(r.vectors, r.n)
            draw = np.random.default_rng(r.shard)
            order = draw.permutation(r.n)
            ids, v = np.frombuffer(r.ids, "<i8")[order], v[order]
            level = np.floor(-np.log(1 - draw.random(r.n)) / np.log(LINKS)).astype(int)
            nodes, links = [], []
            for layer in range(level.max() + 1):
                on = np.flatnonzero(level >= layer)
                near = _layer(v[on].astype(np.float32), LINKS if layer else 2 * LINKS)
                nodes.append(on.astype("<i4").tobytes())
                links.append(np.where(near >= 0, on[near], -1).astype("<i4").tobytes())
            yield pd.DataFrame([{"shard": r.shard, "n": r.n, "ids": ids.astype("<i8").tobytes(), "vectors": v.astype("<f8").tobytes(), "nodes": nodes, "links": links}])


def graph_index(points: DataFrame, point_id: str, vector: str, shard_rows: int = GRAPH_ROWS) -> DataFrame:
    """The index table: a layered neighbour graph per shard of about ``shard_rows`` vectors, one row each."""
    shards, _ = _packed(points, point_id, vector, "shard", shard_rows, "shards")
    with arrow_rows(points.sparkSession, 1):
        made = shards.repartition(F.col("shard")).mapInPandas(_graph, "shard int, n int, ids binary, vectors binary, nodes array<binary>, links array<binary>")
        return written(made, "graph", **ONE_ROW_GROUPS)


class _Graph:
    def __init__(self, r):
        self.ids, self.v = np.frombuffer(r.ids, "<i8"), _vectors(r.vectors, r.n)
        self.fast = self.v.astype(np.float32)
        self.layers = []
        for nodes, links in zip(r.nodes, r.links, strict=True):
            on = np.frombuffer(nodes, "<i4")
            place = np.zeros(r.n, np.int64)
            place[on] = np.arange(len(on))
            self.layers.append((place, np.frombuffer(links, "<i4").reshape(len(on), -1)))
        self.top = int(on[0])

    def _scores(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), 1 << 12):
            part = slice(at, at + (1 << 12))
            np.einsum("ij,ij->i", self.fast.take(nodes[part], 0), q.take(rows[part], 0), out=out[part])
        return out

    def walk(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the ``width`` nodes near it (-1 if there are fewer) and how many vectors were compared, all queries step by step together:
        greedy steps down the layers, then a best-first walk on the lowest one, which ends at nodes under the worst of a full list.
        """
        n = len(q)
        compared = np.ones(n, np.int64)
        at = np.full(n, self.top)
        score = q @ self.fast[self.top]
        for place, links in self.layers[:0:-1]:
            on = np.arange(n)
            while len(on):
                near = links[place[at[on]]]
                i, j = np.divmod(np.flatnonzero(near >= 0), near.shape[1])
                s = np.full(near.shape, -np.inf, np.float32)
                s[i, j] = self._scores(q, on[i], near[i, j])
                compared[on] += np.bincount(i, minlength=len(on))
                best = s.argmax(axis=1)
                s = s[np.arange(len(on)), best]
                up = s > score[on]
                near, on = near[up, best[up]], on[up]
                at[on], score[on] = near, s[up]
        # a list's entries as numbers in order: score, node, and whether its links were followed
        place, links = self.layers[0]
        seen = np.zeros((n, len(self.v)), bool)
        seen[np.arange(n), at] = True
        held = np.full((n, width), _NOBODY)
        held[:, -1] = _entries(score, at)
        on = np.arange(n)
        while len(on):
            mine = held[on]
            fresh = (mine & 1) == 0
            pick = width - 1 - fresh[:, ::-1].argmax(axis=1)
            todo = fresh[np.arange(len(on)), pick]
            on, mine, pick = on[todo], mine[todo], pick[todo]
            rows = np.arange(len(on))
            node = (mine[rows, pick] & 0xFFFFFFFF) >> 1
            mine[rows, pick] |= 1
            near = links[place[node]]
            i, j = np.divmod(np.flatnonzero((near >= 0) & ~seen[on[:, None], near]), near.shape[1])
            nodes, owner = near[i, j], on[i]
            seen[owner, nodes] = True
            compared[on] += np.bincount(i, minlength=len(on))
            more = np.full(near.shape, _NOBODY)
            more[i, j] = _entries(self._scores(q, owner, nodes), nodes)
            both = np.concatenate((mine, more), axis=1)
            both.sort(axis=1)
            held[on] = both[:, -width:]
        return np.where(held == _NOBODY, -1, (held & 0xFFFFFFFF) >> 1), compared


#: No entry: less than any, and followed.
_NOBODY = -(1 << 63) + 1


def _entries(score: np.ndarray, node: np.ndarray) -> np.ndarray:
    bits = score.astype(np.float32).view(np.int32)
    return (np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int64) << 32) | (node.astype(np.int64) << 1)


class _Walks:
    """A block of queries with the ``k`` best of each so far and how many vectors it was compared with; scores are in millionths."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.q_ids, self.v, self.k = ids, v, k
        self.ids, self.scores, self.compared = np.zeros((len(v), 0), np.int64), np.zeros((len(v), 0), np.int64), np.zeros(len(v), np.int64)

    def through(self, g: _Graph, width: int) -> None:
        ids, scores = np.empty((len(self.v), width), np.int64), np.empty((len(self.v), width), np.int64)
        for at in range(0, len(self.v), WALKS):
            part = slice(at, at + WALKS)
            nodes, compared = g.walk(self.v[part].astype(np.float32), width)
            self.compared[part] += compared
            ids[part] = g.ids[nodes]
            scores[part] = np.rint(np.einsum("ijk,ik->ij", g.v[nodes], self.v[part]) * 1e6)
            scores[part][(nodes < 0) | (ids[part] == self.q_ids[part, None])] = _Best.NONE
        ids, scores = np.concatenate((self.ids, ids), axis=1), np.concatenate((self.scores, scores), axis=1)
        order = np.lexsort((ids, -scores))[:, : self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)

    def rows(self) -> pd.DataFrame:
        n = (self.scores > _Best.NONE).sum(axis=1).tolist()
        ids, scores = ([x[:m] for x, m in zip(a, n, strict=True)] for a in (self.ids, self.scores / 1e6))
        return pd.DataFrame({"query_id": self.q_ids, "compared": self.compared, "ids": ids, "scores": scores})


def _walker(k: int, width: int) -> Callable:
    """Of each tile its blocks, which are held, with its shards' graphs one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[_Walks] = []
        tile = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.tile != tile:
                    for b in held:
                        yield b.rows()
                    held.clear()
                    tile = r.tile
                if r.side == 0:
                    held.append(_Walks(np.frombuffer(r.ids, "<i8"), _vectors(r.vectors, r.n), k))
                    continue
                g = _Graph(r)
                for b in held:
                    b.through(g, max(width, k + 1))
        for b in held:
            yield b.rows()

    return run


def graph_search(index: DataFrame, queries: DataFrame, k: int, query_id: str, vector: str, width: int = WIDTH, block_rows: int = 1024) -> DataFrame:
    """(query_id, id, score, rank, compared): approximate neighbours by walks of a list of ``width`` nodes in every shard's graph.

    ``compared`` is the number of vectors that the query was compared with in all shards. Measure the recall against
    ``nearest``; a greater ``width`` raises it.
    """
    blocks, n_blocks = _packed(queries, query_id, vector, "block", block_rows, "blocks")
    last, most = index.agg(F.max("shard"), F.max("n")).first()
    kind = "query_id long, compared long, ids array<long>, scores array<double>"
    walked = _tiled(blocks, index, n_blocks, (last or 0) + 1, block_rows, most or 1, _walker(k, width), kind, "walked", ["nodes", "links"])
    compared = walked.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    each = walked.select("query_id", F.inline(F.arrays_zip("ids", "scores"))).withColumnsRenamed({"ids": "id", "scores": "score"})
    return top_per(each, ["query_id"], k, F.desc("score"), "id").join(compared, "query_id")


# ---- cells


def nearest_in_cells(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str, cells: int = 64, probes: int = 16, sample: int = 4096, seed: int = 7) -> DataFrame:
    """(query_id, id, score, rank): nearest vectors by an index of cells; approximate where ``probes`` < ``cells``.

    Centers are fitted by a few rounds of spherical k-means on the ``sample`` first vectors in hashed order (a bound); every
    point goes into the cell of its nearest center, and a query meets the points of its ``probes`` nearest cells, in tiles of
    packed rows. Measure the recall against ``nearest``; more probes raise it.
    """
    spark = points.sparkSession
    some = points.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), point_id), point_id).select(F.col(vector).alias("v")).limit(sample).toPandas()
    if not len(some):
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    m = _unit(np.stack(some["v"].tolist()))
    center = m[: min(cells, len(m))]
    for _ in range(8):
        own = (m @ center.T).argmax(axis=1)
        total = np.zeros_like(center)
        np.add.at(total, own, m)
        center = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-9, _unit(total), center)

    @F.pandas_udf("array<int>")
    def cell(vectors: pd.Series) -> pd.Series:
        s = _unit(np.stack(vectors.tolist())) @ center.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :1].astype(np.int32)))

    blocks, n_blocks = _packed(queries, query_id, vector, "block", BLOCK_ROWS, "blocks")
    own = F.explode(cell(F.col(vector)).cast("array<string>")).alias("_cell")
    shards, n_shards = _packed(points.where(F.col(vector).isNotNull()).select(point_id, vector, own), point_id, vector, "shard", SHARD_ROWS, "shards", "_cell")
    found = _tiled(blocks, shards, n_blocks, n_shards, BLOCK_ROWS, SHARD_ROWS, _multiplied(k, False, center, probes))
    return top_per(found.drop("grp"), ["query_id"], k, F.desc("score"), "id")
