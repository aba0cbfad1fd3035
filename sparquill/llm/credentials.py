"""Operator 12, secret scans: credentials of several parts, linked by an interval join within scopes.

1. One pass over the whole texts finds parts, as code point spans. Strong ones are reported in any case: ``assign`` (a
   secret's name with a value of 6 or more characters), ``access`` (``AKIA`` and 16 or more capitals and digits), ``hex``
   (24 or more hexadecimal digits). Weak candidates mean nothing alone: ``secret`` (a value after pass, pwd and the like,
   a shorter value after a secret's name, a random-looking string of 20 or more characters), ``identifier`` (a value after
   user, login, client id and the like), ``endpoint`` (an address after a scheme, or a value after host, server and the
   like). A weak candidate that meets a strong span is part of it and no candidate.
2. The pass also gives the scopes of texts that have candidates: paragraphs, and in paragraphs of more than ``SCOPE`` code
   points windows of ``SCOPE`` at every half of it, so that parts within half a scope of each other share one.
3. Parts meet the scopes that hold them by an interval join on cells of ``SCOPE`` code points: a part lies in one cell, a
   scope in two or three. Each scope sums up which parts it has (a partial aggregate, no pairs), and its weak candidates
   are reported if they complete each other: a weak secret beside an identifier, a weak identifier beside a secret, an
   endpoint beside both, or beside a strong secret. ``access`` counts as an identifier, ``assign`` and ``hex`` as secrets.

Texts are read once and never shuffled; spans are. A group of the join is a cell of one text, so neither a text with very
many parts nor a source with a third of the rows makes a large group.

Edge cases: null and empty texts have no spans (a row of zeros, the hash of the empty string); repeated rows are scanned
each; rows with null, repeated or text ids are told apart by a number of their own and keep their ids; very long texts are
scanned whole, their offsets counted in pieces; parts that start together go by kind as listed; a table without rows gives
none; only the named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import KEY, keyed, materialize, raw_texts

#: Kinds in the order in which spans of one start are listed; the first three are the strong ones.
KINDS = ["assign", "access", "hex", "secret", "identifier", "endpoint"]
ASSIGN, ACCESS, HEX, SECRET, IDENTIFIER, ENDPOINT = range(6)
SCOPE = 2000

_VALUE = rb"[\"']?\x20*[:=]\x20*[\"']?"
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)" + _VALUE + rb"([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_NAMED_SECRET = re.compile(rb"(?i:\b(?:pass|pwd|pin|passphrase|credentials?|private_?key|access_?key|auth)\b)" + _VALUE + rb"[^\x00-\x20\"'<>,;]{4,}")
_RANDOM = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
_IDENTIFIER = re.compile(rb"(?i:\b(?:user|user_?name|user_?id|login|account|client_?id|(?:aws_)?access_?key_?id)\b)" + _VALUE + rb"[A-Za-z0-9@._+-]{3,}")
_ENDPOINT = re.compile(rb"(?i:\b[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\"'<>?]+|\b(?:host|host_?name|server|end_?point|base_?url)\b" + _VALUE + rb"[a-z0-9._:/-]{3,})")
_BREAK = re.compile(rb"\n[\x20\t\r]*\n\s*")
#: Byte to "h" where it is a hexadecimal digit: a run of 24 is then found by a plain search.
_HEXED = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_SECRET_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_IDENTIFIER_NAMES = (b"user", b"login", b"account", b"client", b"key_id", b"keyid")

Span = tuple[int, int, int]  # start, kind, end


def _random_looking(value: bytes) -> bool:
    return any(65 <= c <= 90 for c in value) and any(97 <= c <= 122 for c in value) and any(48 <= c <= 57 for c in value)


def parts_of(raw: bytes) -> tuple[list[Span], list[Span]]:
    """(strong, weak) spans of a text, in bytes, each sorted by start and kind. Weak ones are looked for only where others could complete them."""
    low = raw.lower()
    strong, short = [], []
    if any(n in low for n in _SECRET_NAMES):
        for m in _ASSIGN.finditer(raw):
            (strong if m.end(1) - m.start(1) >= 6 else short).append((m.start(), ASSIGN if m.end(1) - m.start(1) >= 6 else SECRET, m.end()))
    if b"AKIA" in raw:
        strong += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEXED):
        strong += [(m.start(), HEX, m.end()) for m in _HEX.finditer(raw)]
    strong.sort()
    weak: list[Span] = []
    if any(n in low for n in _IDENTIFIER_NAMES):
        weak += [(m.start(), IDENTIFIER, m.end()) for m in _IDENTIFIER.finditer(raw)]
    if weak or any(k == ACCESS for _, k, _ in strong):
        weak += short
        weak += [(m.start(), SECRET, m.end()) for m in _NAMED_SECRET.finditer(raw)]
        weak += [(m.start(), SECRET, m.end()) for m in _RANDOM.finditer(raw) if _random_looking(m[0])]
    if any(k in (ASSIGN, HEX) for _, k, _ in strong) or any(k == SECRET for _, k, _ in weak):
        weak += [(m.start(), ENDPOINT, m.end()) for m in _ENDPOINT.finditer(raw)]
    if len(strong) + len(weak) < 2:
        return strong, []
    return strong, _clear(sorted(set(weak)), strong)


def _clear(weak: list[Span], strong: list[Span]) -> list[Span]:
    """Weak spans that meet no strong one; of weak spans of one kind that overlap, the first."""
    out, at, reached = [], 0, -1
    ends = dict.fromkeys((SECRET, IDENTIFIER, ENDPOINT), -1)
    for start, kind, end in weak:
        while at < len(strong) and strong[at][0] <= start:
            reached = max(reached, strong[at][2])
            at += 1
        inside = reached > start or (at < len(strong) and strong[at][0] < end)
        if not inside and start >= ends[kind]:
            out.append((start, kind, end))
            ends[kind] = end
    return out


def _points(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset (ascending), counted in pieces of a megabyte."""
    if raw.isascii():
        return {o: o for o in offsets}
    out, at, n = {}, 0, 0
    for o in offsets:
        while at < o:
            end = min(o, at + (1 << 20))
            n += int(np.count_nonzero((np.frombuffer(raw, np.uint8, end - at, at) & 0xC0) != 0x80))
            at = end
        out[o] = n
    return out


def _scopes(raw: bytes) -> list[tuple[int, int]]:
    """Paragraphs, in bytes."""
    out, at = [], 0
    for m in _BREAK.finditer(raw):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(raw))]


def _windows(lo: int, hi: int, scope: int) -> Iterator[tuple[int, int]]:
    """The scopes of a paragraph, in code points."""
    yield lo, min(hi, lo + scope)
    at = lo + scope // 2
    while at + scope // 2 < hi:
        yield at, min(hi, at + scope)
        at += scope // 2


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_PLACE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SPAN_KIND = "array<struct<start: long, kind: int, end: long>>"


def _scanner(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strongs, weaks, scopes = [], [], []
            for raw in raw_texts(batch.column("text")):
                strong, weak = parts_of(raw)
                places = _scopes(raw) if weak else []
                point = _points(raw, sorted({x for s, _, e in strong + weak for x in (s, e)} | {x for p in places for x in p}))
                strongs.append([{"start": point[s], "kind": k, "end": point[e]} for s, k, e in strong])
                weaks.append([{"start": point[s], "kind": k, "end": point[e]} for s, k, e in weak])
                scopes.append([{"lo": a, "hi": b} for p in places for a, b in _windows(point[p[0]], point[p[1]], scope)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column("id"), pa.array(strongs, _SPAN), pa.array(weaks, _SPAN), pa.array(scopes, _PLACE)], [KEY, "id", "strong", "weak", "scopes"]
            )

    return run


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(_row_key, id, strong, weak, scopes): the spans of every text and the scopes of those with candidates, written once."""
    rows, key = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    rows = rows.select(F.col(key).alias(KEY), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_scanner(scope), f"{KEY} long, id {kind}, strong {_SPAN_KIND}, weak {_SPAN_KIND}, scopes array<struct<lo: long, hi: long>>")
    return materialize(made, "parts")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row_key, lo, hi, identifiers, secrets, endpoints): the scopes of ``parts`` whose parts complete each other, with all spans of each role."""
    some = found.where(F.size("weak") > 0)
    part = some.select(KEY, F.explode(F.concat("strong", "weak")).alias("p")).select(KEY, F.expr(f"p.start div {scope}").alias("cell"), "p")
    place = some.select(KEY, F.explode("scopes").alias("s")).select(KEY, "s", F.explode(F.expr(f"sequence(s.lo div {scope}, greatest(s.lo, s.hi - 1) div {scope})")).alias("cell"))
    held = place.join(part, [KEY, "cell"]).where("s.lo <= p.start AND p.end <= s.hi")
    role = lambda *kinds: F.sort_array(F.collect_list(F.when(F.col("p.kind").isin(*kinds), F.col("p"))))
    whole = held.groupBy(KEY, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")).agg(
        role(ACCESS, IDENTIFIER).alias("identifiers"), role(ASSIGN, HEX, SECRET).alias("secrets"), role(ENDPOINT).alias("endpoints")
    )  # a scope has at most SCOPE code points, and spans of a kind don't overlap
    strong = F.exists("secrets", lambda p: p["kind"] != SECRET)
    both = (F.size("identifiers") > 0) & (F.size("secrets") > 0)
    return whole.where(both | ((F.size("endpoints") > 0) & strong))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", names[p["kind"]], p["start"], p["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row: strong spans and linked weak ones, ``kind:start:end`` each."""
    found = parts(docs, id_col, text_col, scope)
    more = linked(found, scope).select(KEY, F.explode(F.concat("identifiers", "secrets", "endpoints")).alias("p")).where(F.col("p.kind") >= SECRET)
    more = more.groupBy(KEY).agg(F.array_sort(F.collect_set("p")).alias("linked"))
    rows = found.select(KEY, "id", "strong").join(more, KEY, "left")
    count = lambda kind: F.size(F.filter("strong", lambda p: p["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("strong", F.coalesce("linked", F.array().cast(_SPAN_KIND))))
    return rows.select(
        F.col("id").alias(id_col),
        count(ASSIGN).alias("n_assign"),
        count(ACCESS).alias("n_access"),
        count(HEX).alias("n_hex"),
        F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
    )
