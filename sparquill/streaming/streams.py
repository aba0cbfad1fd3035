"""Structured Streaming: event-time windows, de-duplication, sessions, running totals, loop detection, journals.

Times without zone are cast to timestamps first, since watermarks need them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, at: str, late: str | None = None) -> DataFrame:
    """``at`` as a timestamp, with a watermark if ``late`` is given and the input streams."""
    out = df.withColumn(at, F.col(at).cast("timestamp"))
    return out.withWatermark(at, late) if late and df.isStreaming else out


def windowed(df: DataFrame, at: str, length: str, slide: str | None = None, keys: list[str] | None = None, late: str = "10 minutes", **measures: Column) -> DataFrame:
    """Tumbling or sliding windows per key: (start, end, keys, measures)."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = event_time(df, at, late).groupBy(w.alias("_w"), *(keys or [])).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *(keys or []), *measures)


def session_windows(df: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes", **measures: Column) -> DataFrame:
    """Bursts per key that end after a gap (debounce: the last payload and any flag as measures)."""
    out = event_time(df, at, late).groupBy(F.session_window(at, gap).alias("_w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *measures)


def without_repeats(df: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is kept as long as a repeat can still come."""
    timed = event_time(df, at, late)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def usage_totals(df: DataFrame, call: str, caller: str, tokens: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Tokens per kind of caller (the prefix before a colon), each call once."""
    kind = F.when(F.contains(F.col(caller), F.lit(":")), F.substring_index(caller, ":", 1)).otherwise(F.lit("lead"))
    return without_repeats(df, at, [call], late).groupBy(kind.alias("caller")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls"))


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Events of two streams with equal keys at most ``within`` apart; both watermarked, so state ends."""
    a, b = event_time(left, left_at, late), event_time(right, right_at, late).withColumnRenamed(key, f"_{key}")
    near = F.expr(f"{right_at} >= {left_at} - interval {within} AND {right_at} <= {left_at} + interval {within}")
    return a.join(b, (F.col(key) == F.col(f"_{key}")) & near).drop(f"_{key}")


def loop_alerts(df: DataFrame, thread: str, order: str, what: str, window: int = 20, warn: int = 3, stop: int = 5, ttl: str | None = None) -> DataFrame:
    """(thread, order, what, recent, flag) of each event, as ``operators.events.loop_flags`` gives it in batch.

    State per thread is its last ``window`` values. With ``ttl`` a thread that is silent for so long is forgotten; such
    a query checks the clock and so never ends by itself.
    """
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    kinds = dict(df.dtypes)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = deque(state.get[0] if state.exists else [], maxlen=window)
        part = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, value in zip(part[order], part[what], strict=True):
            seen.append(value)
            n = seen.count(value)
            out.append((key[0], at, value, n, "stop" if n >= stop else "warn" if n >= warn else None))
        state.update((list(seen),))
        if millis:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=[thread, order, what, "recent", "flag"])

    return df.select(thread, order, what).groupBy(thread).applyInPandasWithState(
        run, f"{thread} {kinds[thread]}, {order} {kinds[order]}, {what} {kinds[what]}, recent int, flag string", f"last array<{kinds[what]}>", "append", "ProcessingTimeTimeout" if ttl else "NoTimeout"
    )


def journal(df: DataFrame, path: str, checkpoint: str, batch_col: str = "batch_id"):
    """Append micro-batches to Parquet so that a batch that is retried replaces itself: one folder per batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_col}={n}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is there now into a table in memory (tests and small reports)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
