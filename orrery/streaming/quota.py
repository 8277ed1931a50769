"""Stateful streams: a sliding quota and a circuit breaker, keyed, with bounded state and timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def allow(times: list[float], allowed: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which requests at ascending times are allowed: fewer than limit allowed ones less than window before (ST3).

    allowed holds the earlier allowed times; the new ones come back, limit at most. One exactly window old has expired.
    """
    out, kept = [], list(allowed)
    for t in times:
        kept = [x for x in kept if t - x < window]
        ok = len(kept) < limit
        out.append(ok)
        if ok:
            kept.append(t)
    return out, kept


def quota_stream(requests: DataFrame, limit: int, window_seconds: float, delay: str = "1 minute") -> DataFrame:
    """key, id, seconds, allowed for a stream of (key, id, ts); state is at most limit times a key, and goes when it is idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["seconds", "id"])
        ok, kept = allow(rows.seconds.tolist(), kept, limit, window_seconds)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((rows.seconds.max() + window_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=ok)[["key", "id", "seconds", "allowed"]]

    timed = requests.withWatermark("ts", delay).withColumn("seconds", F.unix_micros("ts") / 1e6).select("key", "id", "seconds", "ts")
    return timed.groupBy("key").applyInPandasWithState(step, "key string, id long, seconds double, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def quota_table(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """The same for a table; a key's requests are read in order, batch by batch, with limit times kept."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for b in batches:
            ok = []
            for k, t in zip(b.key, b.seconds, strict=True):
                if k != key:
                    key, kept = k, []
                one, kept = allow([t], kept, limit, window_seconds)
                ok += one
            yield b.assign(allowed=ok)[["key", "id", "seconds", "allowed"]]

    rows = requests.select("key", "id", (F.unix_micros("ts") / 1e6).alias("seconds"))
    return rows.repartition("key").sortWithinPartitions("key", "seconds", "id").mapInPandas(walk, "key string, id long, seconds double, allowed boolean")


def breaker_states(outcomes: DataFrame, failures: int = 5, rest_seconds: float = 30.0) -> DataFrame:
    """State of a circuit breaker after each outcome (key, id, seconds, ok) (ST2).

    closed until so many failures in a row; then open; half open for the first outcome at least rest_seconds
    after it opened, which closes it or opens it again. Outcomes while it is open don't count. A key's rows
    are read in order, with four values kept.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, count, opened = None, "closed", 0, 0.0
        for b in batches:
            out = []
            for k, t, ok in zip(b.key, b.seconds, b.ok, strict=True):
                if k != key:
                    key, state, count, opened = k, "closed", 0, 0.0
                if state == "open" and t - opened >= rest_seconds:
                    state, count, opened = ("closed", 0, 0.0) if ok else ("open", failures, t)
                elif state == "closed":
                    count = 0 if ok else count + 1
                    if count >= failures:
                        state, opened = "open", t
                out.append(state)
            yield b.assign(state=out)[["key", "id", "state"]]

    return outcomes.select("key", "id", "seconds", "ok").repartition("key").sortWithinPartitions("key", "seconds", "id").mapInPandas(walk, "key string, id long, state string")


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows and their mean value by event-time window and key, late ones dropped after delay (an extension)."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("key", F.col("window.start").alias("start"), "n", "mean")


def first_deliveries(df: DataFrame, key: str, fingerprint: str, order: str) -> DataFrame:
    """Of deliveries that repeat a key and fingerprint, the first (ST10).

    On a stream, which must bring a watermark, the first to arrive; a repeat later than the watermark's delay passes again.
    """
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark([key, fingerprint])
    w = Window.partitionBy(key, fingerprint).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
