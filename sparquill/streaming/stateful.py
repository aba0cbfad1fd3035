"""Streams with keyed state of their own: counts with eviction, and debounced sessions that a timer closes.

Both use ``transformWithStateInPandas``, whose state is kept in RocksDB (``keyed_state`` sets the store). A key's state is
bounded: by the kinds that are tracked, or by the sessions that lateness can keep open. A batch's rows of one key are put in
order first; they are as many as the trigger lets in.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparquill.streaming.streams import event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(value):
    """A value as Python has it: no numpy scalars, null for what pandas has for it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def _rows(batches: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[tuple]:
    part = pd.concat(list(batches)).sort_values(order, kind="stable")
    for row in part[columns].itertuples(index=False, name=None):
        yield tuple(map(_plain, row))


# ---- counts with eviction


class _Counts(StatefulProcessor):
    def __init__(self, thread: str, order: str, what: str, window: int, loop: tuple[int, int], often: tuple[int, int], most: int, ttl: int | None):
        self.names = (thread, order, what)
        self.window, self.loop, self.often, self.most, self.ttl = window, loop, often, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "what string", self.ttl)
        self.kinds = handle.getMapState("kinds", "what string", "n long, touched long", self.ttl)
        self.clock = handle.getValueState("clock", "at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        thread, order, what = self.names
        seen = deque((r[0] for r in self.last.get()), maxlen=self.window)
        stored = {k[0]: (v[0], v[1]) for k, v in self.kinds.iterator()}
        held = OrderedDict((k, stored[k]) for k in sorted(stored, key=lambda k: stored[k][1]))  # least recently used first
        clock = self.clock.get()[0] if self.clock.exists() else 0
        flag = lambda n, least: "stop" if n >= least[1] else "warn" if n >= least[0] else None
        out = []
        for at, value in _rows(rows, [order], [order, what]):
            if value is None:
                out.append((key[0], at, value, 0, 0, None, None, None))
                continue
            clock += 1
            seen.append(value)
            n = held.pop(value, (0, 0))[0] + 1
            held[value] = (n, clock)
            gone = held.popitem(last=False)[0] if len(held) > self.most else None
            recent = seen.count(value)
            out.append((key[0], at, value, recent, n, flag(recent, self.loop), flag(n, self.often), gone))
        for k in stored.keys() - held.keys():
            self.kinds.removeKey((k,))
        for k, v in held.items():
            if stored.get(k) != v:
                self.kinds.updateValue((k,), v)
        self.last.put([(v,) for v in seen])
        self.clock.update((clock,))
        yield pd.DataFrame(out, columns=[thread, order, what, "recent", "count", "loop", "often", "evicted"])


def bounded_alerts(
    df: DataFrame, thread: str, order: str, what: str, window: int = 20, loop: tuple[int, int] = (3, 5), often: tuple[int, int] = (30, 50), most: int = 500, ttl: str | None = None
) -> DataFrame:
    """(thread, order, what, recent, count, loop, often, evicted) of each event, ``what`` as a string.

    ``recent`` counts its like among the thread's last ``window`` events, ``count`` all of them since the kind is tracked;
    ``loop`` and ``often`` say ``warn`` or ``stop`` by their two limits. A thread tracks at most ``most`` kinds: the one that
    was used least recently goes (``evicted`` names it) and counts from one again when it comes back. With ``ttl`` what has
    not been written for so long is forgotten, too. A null kind is passed on and not tracked.
    """
    keyed_state(df.sparkSession)
    kinds = dict(df.dtypes)
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    schema = f"{thread} {kinds[thread]}, {order} {kinds[order]}, {what} string, recent int, count long, loop string, often string, evicted string"
    rows = df.select(thread, order, F.col(what).cast("string").alias(what)).groupBy(thread)
    return rows.transformWithStateInPandas(_Counts(thread, order, what, window, loop, often, most, millis), schema, "Append", "ProcessingTime" if ttl else "None")


# ---- debounce


class _Debounce(StatefulProcessor):
    def __init__(self, payload: list[str], flags: list[str], state: str, gap: int):
        self.payload, self.flags, self.state, self.gap = payload, flags, state, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.state)

    def _merged(self, a: tuple, b: tuple) -> tuple:
        new = max(a, b, key=lambda s: (s[1], s[3]))  # the payload of the last event, of equal times the greater tie
        k = 4 + len(self.payload)
        return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *new[3:k], *(bool(x) or bool(y) for x, y in zip(a[k:], b[k:], strict=True)))

    def _keep(self, held: list[tuple]) -> None:
        """The open sessions, and one timer for the first of them that can end."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.open.put(held)
            self.handle.registerTimer(-(-(min(s[1] for s in held) + self.gap) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(s) for s in self.open.get()]
        for at, tie, *rest in _rows(rows, ["at_micros", "tie_value"], ["at_micros", "tie_value", *self.payload, *self.flags]):
            now = (at, at, 1, tie, *rest)
            near = [s for s in held if at - s[1] < self.gap and s[0] - at < self.gap]
            held = [s for s in held if s not in near]
            for s in near:
                now = self._merged(s, now)
            held.append(now)
        self._keep(held)
        yield self._table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(s) for s in self.open.get()]
        done = sorted(s for s in held if s[1] + self.gap <= mark)
        self._keep([s for s in held if s[1] + self.gap > mark])
        yield self._table(key, done)

    def _table(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *s[:3], *s[4:]) for s in done], columns=[*(f"key_{i}" for i in range(len(key))), "start", "end", "n", *self.payload, *self.flags], dtype=object)
        return out


def debounced(df: DataFrame, keys: list[str], at: str, tie: str, payload: list[str], flags: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, payload, flags): of each burst of events of a key less than ``gap`` apart one row, once it is over.

    The payload is that of the last event (of equal times the greater ``tie``), flags are true if any event's was. An
    event-time timer ends a burst when the watermark is ``gap`` past its last event; until then later events, also out of
    order, extend it or join two of them. State is a row for each burst that is still open.
    """
    keyed_state(df.sparkSession)
    kinds = dict(df.dtypes)
    micros = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    rest = "".join(f", {c} {kinds[c]}" for c in payload) + "".join(f", {c} boolean" for c in flags)
    key_kinds = ", ".join(f"key_{i} {kinds[k]}" for i, k in enumerate(keys))
    timed = event_time(df, at, late)
    rows = timed.select(*keys, at, F.unix_micros(at).alias("at_micros"), F.col(tie).alias("tie_value"), *payload, *[F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f) for f in flags])
    state = f"start long, end long, n long, tie {kinds[tie]}{rest}"
    made = rows.groupBy(*keys).transformWithStateInPandas(_Debounce(payload, flags, state, micros), f"{key_kinds}, start long, end long, n long{rest}", "Append", "EventTime")
    return made.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n", *payload, *flags)
