"""Per-user state with timers: what was seen, neighbours at hand, and the screens of the past.

All three are stateful processors keyed by the user, in event time. A row that comes later than
the watermark is dropped by Spark; what is older than its age is forgotten by a timer of its
own, and never used even before that timer fires. State lives in the store of the query's
checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed maps and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(width: str) -> int:
    return int(pd.Timedelta(width).total_seconds() * 1000)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one user and batch, by time and id."""
    rows = pd.concat(list(frames)).sort_values(["create_time", "id"], ignore_index=True)
    return rows.assign(ms=rows["create_time"].astype("datetime64[ms]").astype("int64"))


class _Aged(StatefulProcessor):
    """A map from a key to a value with the time it was put; entries go by their age."""

    def __init__(self, key: str, value: str, age: str):
        self.key, self.value, self.age = key, value, _ms(age)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", self.key, self.value)

    def get(self, key: tuple, now: int) -> tuple | None:
        """The value put at most ``age`` before ``now``."""
        found = self.entries.getValue(key) if self.entries.exists() and self.entries.containsKey(key) else None
        return found if found is not None and now - found[0] <= self.age else None

    def put(self, key: tuple, now: int, *value) -> None:
        self.entries.updateValue(key, (now, *value))
        self.handle.registerTimer(now + self.age + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for old in [k for k, v in self.entries.iterator() if v[0] + self.age < due]:
            self.entries.removeKey(old)
        yield from ()

    def close(self) -> None:
        pass


class Seen(_Aged):
    """Tells of each pair whether the user sees it for the first time; a toggle forgets what was seen."""

    def __init__(self, age: str):
        super().__init__("id1 string, id2 string", "ms long", age)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = _in_order(rows)
        fresh = []
        for kind, one, two, now in zip(told["kind"], told["id1"], told["id2"], told["ms"]):
            if kind == "toggle":
                self.entries.clear()
                fresh.append(None)
                continue
            pair = (one, two)
            fresh.append(self.get(pair, now) is None)
            self.put(pair, now)
        out = told.assign(fresh=fresh)
        yield out[out["kind"] != "toggle"][["browser_id", "create_time", "id", "id1", "id2", "fresh"]].astype({"fresh": bool})


class Neighbours(_Aged):
    """Keeps each item's neighbours as they are put, and answers asks from those that are young enough."""

    def __init__(self, age: str):
        super().__init__("item string", "ms long, neighbours array<string>", age)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        answers = []
        for row in _in_order(rows).itertuples():
            if row.kind == "put":
                self.put((row.item,), row.ms, list(row.neighbours))
            else:
                found = self.get((row.item,), row.ms)
                answers.append((row.browser_id, row.create_time, row.id, row.item, found is not None, list(found[1]) if found is not None else []))
        yield pd.DataFrame(answers, columns=["browser_id", "create_time", "id", "item", "hit", "neighbours"])


class Screens(StatefulProcessor):
    """The last ``depth`` screens of a user; ``back`` returns to the one before."""

    def __init__(self, depth: int, idle: str):
        self.depth, self.idle = depth, _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getListState("stack", "id1 string, id2 string")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = _in_order(rows)
        stack = [tuple(s) for s in self.stack.get()] if self.stack.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in told.itertuples():
            if last is not None and row.ms - last > self.idle:
                stack = []
            last = row.ms if last is None else max(last, row.ms)
            if row.kind == "back":
                stack = stack[:-1]
            else:
                stack = [*stack, (row.id1, row.id2)][-self.depth :]
            now = stack[-1] if stack else (None, None)
            out.append((row.browser_id, row.create_time, row.id, *now, len(stack)))
        self.stack.put(stack) if stack else self.stack.clear()
        self.last.update((last,))
        self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame(out, columns=["browser_id", "create_time", "id", "id1", "id2", "depth"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.idle < expiredTimerInfo.getExpiryTimeInMs():
            self.stack.clear()
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    return rows.withWatermark("create_time", late).groupBy("browser_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def seen_pairs(shown: DataFrame, age: str = "1 day", late: str = "1 minute") -> DataFrame:
    """``browser_id, create_time, id, id1, id2, fresh`` of each pair shown, from ``browser_id, create_time, id, kind, id1, id2``.

    ``kind`` is ``pair`` or ``toggle``. A pair is fresh if its user has not seen
    it since the last toggle and within ``age``.
    """
    schema = "browser_id long, create_time timestamp, id long, id1 string, id2 string, fresh boolean"
    return _run(shown.select("browser_id", "create_time", "id", "kind", "id1", "id2"), Seen(age), schema, late)


def cached_neighbours(events: DataFrame, age: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """``browser_id, create_time, id, item, hit, neighbours`` of each ask, from ``browser_id, create_time, id, kind, item, neighbours``.

    ``kind`` is ``put`` or ``ask``. An ask hits what its user put last for the
    item, at most ``age`` ago.
    """
    schema = "browser_id long, create_time timestamp, id long, item string, hit boolean, neighbours array<string>"
    return _run(events.select("browser_id", "create_time", "id", "kind", "item", "neighbours"), Neighbours(age), schema, late)


def screen_stack(shown: DataFrame, depth: int = 5, idle: str = "1 day", late: str = "1 minute") -> DataFrame:
    """``browser_id, create_time, id, id1, id2, depth`` after each row of ``browser_id, create_time, id, kind, id1, id2``.

    ``kind`` is ``show`` or ``back``; a user keeps ``depth`` screens and none
    after ``idle`` without a row. Without a screen the ids are null.
    """
    schema = "browser_id long, create_time timestamp, id long, id1 string, id2 string, depth int"
    return _run(shown.select("browser_id", "create_time", "id", "kind", "id1", "id2"), Screens(depth, idle), schema, late)
