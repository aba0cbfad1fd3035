"""Operator 6, near-dedup by circulant MinHash.

Two permutations make all signature coordinates. The first, sigma, scatters the shingles of a document over a ring
of 2**32 places; the second, pi, ranks the places; coordinate k is the least pi(sigma(x) + k) over the document,
that is, pi shifted circularly by k. Coordinates are cut into bands; documents that agree in a band are candidates.

1. One Arrow pass reads each text whole: set size, digest of the word sequence, band keys, one-byte signature.
2. Rows with equal word sequences become one class (partial aggregate), stood for by its least key.
3. Members of a (band, key) bucket hang on the least one, its star; buckets with the same members count once.
4. First, each document is confirmed on its full shingle set against the least of its stars, in groups of a star
   and at most ``block`` rows and ``GROUP_BYTES`` of sets. In the usual case that connects all of a large group.
5. Then only buckets whose members are not all connected go on. In such a bucket the members that are connected to
   its star need no comparison with each other: the others are dealt into bounded groups, each meeting itself, the
   other such groups and the groups of connected ones. Within a group, pairs of unconnected documents that agree on
   enough of their signatures are confirmed on the full sets, best-agreeing first.
6. Components of all confirmed links.

A cluster of true copies is thus linear work however large it is, false hits never chain into larger groups, and
no bucket, cluster or partner list is capped. Bands are derived from the threshold so that a pair just at it shares
no band with probability under ``MISS`` (1e-7); it falls below the signature threshold (5.5 standard deviations under
its mean) with probability under 1e-7. Shingles are 64-bit hashes of their words' 64-bit hashes.

Edge cases: null, empty and blank texts have an empty set, n_shingles 0, and link with nothing; fewer words than the
shingle width make one shingle; repeated rows and equal texts are one component; null ids and repeated ids are kept
as rows of their own; very long texts count whole; only the id and text columns are read, so further columns of any
name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import KEY, arrow_rows, key_id_text, keyed, materialize, raw_texts
from sparquill.llm.components import components

ROWS, MISS, BLOCK, GROUP_BYTES, OUT_BYTES = 4, 1e-7, 1000, 16 << 20, 4 << 20
#: Rows with their sets in an Arrow batch on the way to the links.
GROUP_ROWS = 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    h *= _MIX[4]
    h ^= h >> np.uint64(32)
    return h


class Shingler:
    """Distinct shingle hashes of a text, sorted; word hashes are remembered up to a bound."""

    def __init__(self, width: int, remember: int = 100_000):
        self.width, self.remember, self.known = width, remember, {}

    def words(self, text: bytes) -> list[bytes]:
        return text.lower().split()  # bytes: A-Z and ASCII white space only

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        try:
            h = np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], dtype=np.uint64)
        k = min(self.width, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _stir(out * _MIX[0] + h[i : i + n])
        return np.unique(out)


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of the ring of 2**32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, size: int, step: int = 8192) -> np.ndarray:
    """``size`` coordinates: least pi(sigma(x) + k) for k = 0, 1, ..."""
    place = (_stir(shingles * _MIX[1] + _MIX[2]) >> np.uint64(32)).astype(np.uint32)  # sigma
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    rows = max(1, step // max(1, min(len(place), step)))
    for at in range(0, len(place), step):
        part = place[at : at + step]
        for k in range(0, size, rows):
            np.minimum(best[k : k + rows], _pi(part[None, :] + shift[k : k + rows]).min(axis=1), out=best[k : k + rows])
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros(bands, np.uint64)
    for i in range(rows):
        h = _stir(h * _MIX[0] + signature[: bands * rows].reshape(bands, rows)[:, i])
    return h


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold shares none with probability ``miss`` at most."""
    agree = (percent / 100) ** rows
    return 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree))


_SIGNED = pa.schema([(KEY, pa.int64()), ("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
_SET = pa.schema([(KEY, pa.int64()), ("shingles", pa.binary())])


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                for text in raw_texts(batch.column("text")):
                    words = shingler.words(text)
                    s = shingler.shingles(words)
                    if not len(s):
                        out.append((0, b"", np.empty(0, np.int64), b""))
                        continue
                    sig = circulant_signature(s, bands * rows)
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                    out.append((len(s), digest, band_keys(sig, bands, rows).view(np.int64), sig.astype(np.uint8).tobytes()))
                n, digest, keys, sig = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=_SIGNED)

    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            keys, out, held = [], [], 0
            for key, text in zip(batch.column(KEY).to_pylist(), raw_texts(batch.column("text")), strict=True):
                keys.append(key)
                out.append(shingler.shingles(shingler.words(text)).tobytes())
                held += len(out[-1])
                if held > OUT_BYTES:  # sets are as large as texts: hand them on in small parts
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], schema=_SET)
                    keys, out, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], schema=_SET)

    return sets


def _views(column: pa.ChunkedArray) -> list[memoryview]:
    """The bytes of each value of a binary column, without copies."""
    out: list[memoryview] = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        out += [view[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _links(key: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, sigs: list, shingles: list, percent: int, floor: float) -> list[tuple[int, int]]:
    """Spanning links among the rows of one group, or between its two sides; rows of equal ``label`` are connected."""
    two = side[-1] != side[0]
    if (label == label[0]).all():
        return []
    sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(key), -1)
    first_b = int(np.searchsorted(side, side[-1])) if two else 0
    a, b, near = [], [], []
    for i in range(first_b if two else len(key)):
        j0 = first_b if two else i + 1
        j = j0 + np.flatnonzero(label[j0:] != label[i])
        j = j[np.minimum(size[j], size[i]) * 100 >= percent * np.maximum(size[j], size[i])]
        agree = (sig[j] == sig[i]).sum(axis=1)
        keep = agree >= floor * sig.shape[1]
        a.append(np.full(keep.sum(), i))
        b.append(j[keep])
        near.append(agree[keep])
    out: list[tuple[int, int]] = []
    if not sum(map(len, a)):
        return out
    x, y, s = np.concatenate(a), np.concatenate(b), np.concatenate(near)
    order = np.argsort(-s.astype(np.int64), kind="stable")
    head: dict[int, int] = {}
    root = [head.setdefault(x, i) for i, x in enumerate(label.tolist())]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = find(i), find(j)
        if p == q:
            continue
        u, v = np.frombuffer(shingles[i], np.uint64), np.frombuffer(shingles[j], np.uint64)
        both = np.concatenate((u, v))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= percent * (len(u) + len(v) - common):
            root[max(p, q)] = min(p, q)
            out.append((int(key[i]), int(key[j])))
    return out


def _linker(group: list[str], percent: int, floor: float):
    """The links of all groups of a partition that is sorted by ``group``, side and key: most groups are small, so many are taken from a batch at once."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
        key, side, label, size = (rows.column(c).to_numpy() for c in (KEY, "side", "label", "n_shingles"))
        sigs, shingles = _views(rows.column("sig")), _views(rows.column("shingles"))
        out: list[tuple[int, int]] = []
        for x, y in zip(starts, [*starts[1:], len(key)], strict=True):
            if y - x > 1:
                out += _links(key[x:y], side[x:y], label[x:y], size[x:y], sigs[x:y], shingles[x:y], percent, floor)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], schema=kinds)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for c in group:
                v = rows.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new).tolist()
            if len(starts) > 1:
                yield of(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])  # it may go on in the next batch
        if rest is not None:
            yield of(rest, [0])

    return link


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int | None = None,
    rows: int = ROWS,
    block: int = BLOCK,
    key: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``_row_key``, id, n_shingles, component_id (least id reachable), kept.

    Linked are texts whose shingle sets have 100 * intersection >= percent * union. Of each component the row with
    the least id (then least key) is kept. ``key`` names a column of unique longs, if ``docs`` has one.
    """
    bands = bands or bands_for(percent, rows)
    texts = key_id_text(docs, id_col, text_col, key)
    kinds = f"{KEY} long, id long, n_shingles long, digest binary, bands array<long>, sig binary"
    signed = materialize(texts.mapInArrow(_signer(width, bands, rows), kinds), "signed")

    full = signed.where("n_shingles > 0")
    # the least member stands for its class; only its band keys and signature go on
    classes = materialize(full.groupBy("digest").agg(F.min(KEY).alias("rep")), "classes")  # joins then read plain shuffles, which AQE can split
    reps = materialize(
        full.join(classes.hint("merge"), (full["digest"] == classes["digest"]) & (full[KEY] == classes["rep"]), "left_semi").select(KEY, "n_shingles", "bands", "sig"),
        "reps",
    )
    cells = reps.select(KEY, F.posexplode("bands").alias("band", "cell"))
    marks = [F.sum(F.xxhash64(F.lit(i), KEY).cast("decimal(20,0)")).alias(f"m{i}") for i in range(2)]
    buckets = cells.groupBy("band", "cell").agg(F.min(KEY).alias("star"), F.count("*").alias("n"), *marks).where("n > 1")
    buckets = buckets.groupBy("star", "n", "m0", "m1").agg(F.min(F.struct("band", "cell")).alias("b")).select("b.band", "b.cell", "star")
    hung = materialize(cells.join(buckets, ["band", "cell"]), "hung")

    mine = hung.groupBy(KEY).agg(F.min("star").alias("star"))
    own = mine.select(KEY).hint("merge")
    sets = texts.join(own, KEY, "left_semi").select(KEY, "text").mapInArrow(_setter(width), f"{KEY} long, shingles binary")
    members = materialize(sets.join(reps.select(KEY, "n_shingles", "sig"), KEY), "members")
    floor = percent / 100 - 5.5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    size = (8 * F.col("n_shingles") + 256).cast("long")
    parts = F.ceil(F.greatest(F.sum("held") / GROUP_BYTES, F.count("*") / block)).alias("parts")

    def linked(met: DataFrame, group: list[str]) -> DataFrame:
        """Written links of the groups of ``met``."""
        rows = met.join(members.hint("merge"), KEY).select(*group, "side", KEY, "label", "n_shingles", "sig", "shingles")
        rows = rows.repartition(*group).sortWithinPartitions(*group, "side", KEY)
        with arrow_rows(docs.sparkSession, GROUP_ROWS):
            return materialize(rows.mapInArrow(_linker(group, percent, floor), "a long, b long"), "links")

    # each document and the least of its stars: a hot star's members are dealt into groups, the star is in each
    fans = mine.where(F.col("star") < F.col(KEY)).join(reps.select(KEY, size.alias("held")), KEY)
    deals = fans.groupBy("star").agg(parts)
    met = fans.join(deals, "star").select(KEY, "star", F.pmod(F.xxhash64(KEY), "parts").alias("nth"), F.lit(1).alias("side"), F.col(KEY).alias("label"))
    hubs = deals.select(F.col("star").alias(KEY), "star", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("nth"), F.lit(0).alias("side"), F.col("star").alias("label"))
    near = linked(met.unionByName(hubs), ["star", "nth"])

    # buckets that are not connected yet: the members not connected to the star meet each other and all others
    labels = components(near)
    hung = hung.join(labels.withColumnRenamed("node", KEY), KEY, "left").withColumn("label", F.coalesce("root", KEY)).drop("root")
    hung = materialize(hung, "labelled")
    spread = hung.groupBy("band", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.when(F.col(KEY) == F.col("star"), F.col("label"))).alias("main"))
    spread = spread.where("lo < hi").select("band", "cell", "main")
    spot = hung.join(spread, ["band", "cell"]).join(reps.select(KEY, size.alias("held")), KEY)
    spot = materialize(spot.select("band", "cell", KEY, "label", "held", (F.col("label") == F.col("main")).alias("tied")), "open")
    deals = spot.groupBy("band", "cell", "tied").agg(parts)
    deals = deals.groupBy("band", "cell").agg(*[F.coalesce(F.max(F.when(F.col("tied") == t, F.col("parts"))), F.lit(0)).alias(c) for t, c in ((True, "ties"), (False, "loose"))])
    spot = spot.join(deals, ["band", "cell"]).withColumn("nth", F.pmod(F.xxhash64(KEY), F.when(F.col("tied"), F.col("ties")).otherwise(F.col("loose"))))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    free, tied = (spot.where(F.col("tied") == t).select("band", "cell", KEY, "label", "nth", to("loose")) for t in (False, True))
    spots = [
        free.select("band", "cell", KEY, "label", F.lit(0).alias("kind"), F.least("nth", "other").alias("lo"), F.greatest("nth", "other").alias("hi"), (F.col("nth") > F.col("other")).cast("int").alias("side")),
        tied.select("band", "cell", KEY, "label", F.lit(1).alias("kind"), F.col("other").alias("lo"), F.col("nth").alias("hi"), F.lit(1).alias("side")),
        spot.where("NOT tied").select("band", "cell", KEY, "label", F.lit(1).alias("kind"), F.col("nth").alias("lo"), to("ties"), F.lit(0).alias("side")).withColumnRenamed("other", "hi"),
    ]
    met = spots[0].unionByName(spots[1]).unionByName(spots[2])
    far = linked(met, ["band", "cell", "kind", "lo", "hi"])
    # joined to what is connected already
    roots = components(far.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    rep_of = full.join(classes.hint("merge"), "digest").select(KEY, "id", "n_shingles", "rep")
    rooted = rep_of.join(roots, rep_of["rep"] == roots["node"], "left").select(KEY, "id", "n_shingles", F.coalesce("root", "rep").alias("root"))
    placed = materialize(rooted.unionByName(signed.where("n_shingles = 0").select(KEY, "id", "n_shingles", F.col(KEY).alias("root"))), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(KEY).alias("k"))).alias("first"))
    first = materialize(first, "first")  # the join below then reads plain shuffles, which AQE can split
    return placed.join(first, "root").select(
        KEY, F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"), (F.col(KEY) == F.col("first.k")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with their columns as they came."""
    rows, key = keyed(docs, id_col)
    kept = near_groups(rows, id_col, text_col, key=key, **how).where("kept").select(F.col(KEY).alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
