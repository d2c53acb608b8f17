"""Rate limits, idempotent appends and overlays, as Structured Streaming and as batch replays of the same fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Cool-down, and (most events, seconds) of each window.
COOL_DOWN = 15
WINDOWS = ((5, 600), (20, 86_400))
OUT = "user_id long, event_id long, accepted boolean, retry_after long"


def decide(accepted: list[int], at: int, cool_down: int = COOL_DOWN, windows=WINDOWS) -> tuple[bool, int]:
    """Whether an event at `at` (milliseconds) passes, given accepted ones in order; and seconds until it would."""
    waits = [accepted[-1] + cool_down * 1000 - at] if accepted else []
    for most, seconds in windows:
        inside = [t for t in accepted if t > at - seconds * 1000]
        if len(inside) >= most:
            waits.append(inside[-most] + seconds * 1000 - at)
    wait = max(waits, default=0)
    return wait <= 0, max(0, -(-wait // 1000))


def _fold(accepted: list[int], rows: pd.DataFrame, user: int) -> tuple[list[int], list[tuple]]:
    out = []
    keep = max(s for _, s in WINDOWS) * 1000
    for event, at in sorted(zip(rows["event_id"], rows["ms"], strict=True), key=lambda r: (r[1], r[0])):
        ok, wait = decide(accepted, at)
        if ok:
            accepted.append(at)
        accepted = [t for t in accepted if t > at - keep]
        out.append((user, event, ok, wait))
    return accepted, out


def replay(events: DataFrame) -> DataFrame:
    """The exact limiter over a batch: only accepted events count, so a window function can't say it.  State per user is at most 20 times."""
    timed = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))

    def run(key, pdf):
        return pd.DataFrame(_fold([], pdf, key[0])[1], columns=["user_id", "event_id", "accepted", "retry_after"])

    return timed.groupBy("user_id").applyInPandas(run, OUT)


def limiter(stream: DataFrame) -> DataFrame:
    """The same fold over a stream, with keyed state that expires, by event time, a day after a user's last event."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"))

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        accepted, out = _fold(accepted, rows, key[0])
        state.update((accepted,))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted", "retry_after"])

    return timed.groupBy("user_id").applyInPandasWithState(run, OUT, "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def accepted_once(df: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """Batch twin: the first row of a key, and whether a later one with the key had another payload."""
    return df.groupBy(key).agg(F.min_by(payload, at).alias(payload), F.count("*").alias("sent"), (F.count_distinct(payload) > 1).alias("conflict"))


def overlay_sink(published: DataFrame, key: str, write):
    """A foreachBatch function: each batch's live rows over the published ones; a failing batch leaves the last good version."""
    from quern.operators.joins import overlay

    def run(batch: DataFrame, number: int) -> None:
        write(overlay(batch.dropDuplicates([key]), published, key), number)

    return run


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str, delay: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
