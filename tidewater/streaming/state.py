"""Sessions, rate limits and request metrics as streams: state by user, bounded by timeouts and watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Of a stream (user_id, ts, event_id): whether each event is accepted. Only accepted events move a user's clock,
    which is all the state there is; it goes when event time is a day past it. Events that come late within
    a batch are taken in order of their time."""
    gap = int(gap_seconds * 1_000_000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        accepted = []
        for t in rows["t"]:
            ok = last is None or t - last >= gap
            last = t if ok else last
            accepted.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "accepted": accepted})

    rows = events.withWatermark("ts", "1 hour").withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, event_id long, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def sessions(events: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """Of a stream (user_id, ts): user_id, start_ms, end_ms, events of each session whose ttl has passed by event time.

    An event ttl_seconds or more after the last one starts a new session, as the timeout does. Event times, and with them the
    watermark, are taken to the nearest millisecond, halves up, before they are compared. A stream's watermark begins at 1970; what is earlier is late.
    """
    ttl = ttl_seconds * 1000

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append((key[0], *state.get))
            state.remove()
        else:
            open_ = state.get if state.exists else None
            for t in pd.concat(list(parts))["t"].sort_values():
                if open_ and t - open_[1] >= ttl:
                    done.append((key[0], *open_))
                    open_ = None
                open_ = (open_[0], max(open_[1], t), open_[2] + 1) if open_ else (t, t, 1)
            state.update(open_)
            state.setTimeoutTimestamp(max(open_[1] + ttl, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["user_id", "start_ms", "end_ms", "events"]).astype("int64")

    nearest = F.timestamp_micros(F.round(F.unix_micros("ts"), -3))
    rows = events.withColumn("ts", nearest).withWatermark("ts", "10 minutes").withColumn("t", F.unix_millis("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, start_ms long, end_ms long, events long", "a long, b long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def request_metrics(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and their mean value by window and type; a window is told once the watermark passes it."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return rows.agg(F.count("*").alias("requests"), F.avg("value").alias("mean_value")).select(
        F.col("window.start").alias("start"), "event_type", "requests", "mean_value"
    )


def collected(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that a stream over finished files tells, as a table: Parquet beside its checkpoint."""
    out = f"{checkpoint}/{name}/out"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
