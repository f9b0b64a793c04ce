"""The live forms of the log analytics, on Structured Streaming.

Every function takes a streaming (or batch) frame of ``browser_id, create_time
(timestamp), ...`` and returns one; sources and sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing_counts(log: DataFrame, width: str = "5 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Rows a user in every trailing window; state goes once the watermark has passed."""
    windows = log.withWatermark("create_time", late).groupBy("browser_id", F.window("create_time", width, slide).alias("w"))
    return windows.agg(F.count("*").alias("n")).select("browser_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(log: DataFrame, keys: tuple[str, ...] = ("browser_id", "id1", "id2"), late: str = "1 hour") -> DataFrame:
    """Each pair once a user, within the watermark."""
    return log.withWatermark("create_time", late).dropDuplicatesWithinWatermark(list(keys))


def sessions(log: DataFrame, gap: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Activity without a longer break. A gap of exactly ``gap`` does not end it, hence one microsecond more."""
    merged = log.withWatermark("create_time", late).groupBy("browser_id", F.session_window("create_time", f"{gap} 1 microsecond").alias("w"))
    return merged.agg(F.count("*").alias("n"), F.min("create_time").alias("started"), F.max("create_time").alias("ended")).select("browser_id", "started", "ended", "n")


def recent_means(log: DataFrame, sizes: tuple[int, int] = (10, 50), idle: str = "1 hour") -> DataFrame:
    """Means of each user's last rows after every batch; a user's state is the last ``max(sizes)`` values and goes when idle."""
    most, idle_ms = max(sizes), int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        values = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["create_time", "id"])
        values = (values + rows["user_time"].astype(float).tolist())[-most:]
        state.update((values,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"browser_id": [key[0]], **{f"mean_{n}": [sum(values[-n:]) / len(values[-n:])] for n in sizes}})

    schema = "browser_id long, " + ", ".join(f"mean_{n} double" for n in sizes)
    return log.select("browser_id", "create_time", "id", "user_time").groupBy("browser_id").applyInPandasWithState(update, schema, "values array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def screens(shown: DataFrame, idle: str = "1 day") -> DataFrame:
    """Each user's current and previous pair after every batch, from ``browser_id, create_time, id, id1, id2``; forgotten when idle."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else (None, None, None, None)
        rows = pd.concat(list(frames)).sort_values(["create_time", "id"])
        for one, two in zip(rows["id1"], rows["id2"]):
            now = (one, two, now[0], now[1])
        state.update(now)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[key[0], *now]], columns=["browser_id", "id1", "id2", "previous1", "previous2"])

    schema = "id1 string, id2 string, previous1 string, previous2 string"
    return shown.select("browser_id", "create_time", "id", "id1", "id2").groupBy("browser_id").applyInPandasWithState(update, f"browser_id long, {schema}", schema, "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest_neighbours(lists: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The next neighbours computed last for each user, from ``browser_id, create_time, neighbours``: what a cache holds.

    State older than the watermark by ``late`` goes, so an entry is evicted by age.
    """
    rows = lists.withWatermark("create_time", late).groupBy("browser_id", F.window("create_time", late).alias("w"))
    return rows.agg(F.max(F.struct("create_time", "neighbours")).alias("m")).select("browser_id", F.col("m.create_time").alias("create_time"), F.col("m.neighbours").alias("neighbours"))
