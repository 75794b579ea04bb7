"""Keyed streams whose rows are handled in the order of their event times.

Rows of a key arrive in any order, over files and batches. They are held as list state; an event-time timer at
the first one's time fires when the watermark has passed it, and all rows up to the watermark are then
handled at once, in order: no row that comes later can belong before them, since those are dropped as
late. What a key must remember is value state with a time of its own from which it no longer
matters; another timer removes it then. A key that is silent long enough leaves nothing behind.

A table that is replayed has an end, which a watermark alone never passes: closing() makes a stream
of rows and of an empty folder, into which the end is written, one row of a time after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType, StringType

from ..sources.checkpoint import folder

#: The time of the row that ends a stream.
END = "9999-01-01 00:00:00"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds rows (first field: microseconds) and gives those that the watermark has passed to step(key, rows, memory).

    step returns rows out and the new memory, whose last field is the time, in microseconds, from which it no longer matters.
    """

    def __init__(self, columns: list[str], held: str, memory: str, out: list[str], step: Callable):
        self.columns, self.held_as, self.memory_as, self.out, self.step = columns, held, memory, out, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_as)
        self.memory = handle.getValueState("memory", self.memory_as)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        first = None
        for part in rows:
            new = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in part[self.columns].astype(object).where(part[self.columns].notna(), None).itertuples(index=False)]
            if new:
                self.held.appendList(new)
                first = min([r[0] for r in new] + ([first] if first is not None else []))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.held.get()]
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] > now]
        if ready:
            out, memory = self.step(key, ready, memory)
            if out:
                yield pd.DataFrame(out, columns=self.out)
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if rest:
            self._wake(min(r[0] for r in rest))
        if memory is not None:
            if not rest and memory[-1] <= now:
                self.memory.clear()
            else:
                if ready:
                    self.memory.update(memory)
                if not rest:
                    self._wake(memory[-1])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, columns: list[str], held: str, memory: str, out: str, step: Callable, late: str) -> DataFrame:
    """step() over a stream with columns ts, key and `columns`; held and out are the schemas of rows held and put out."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.withWatermark("ts", late).filter(f"ts < timestamp'{END}'").withColumn("at", F.unix_micros("ts"))
    names = [part.split()[0] for part in out.split(", ")]
    processor = InOrder(["at", *columns], held, memory, names, step)
    return rows.select(key, "ts", "at", *columns).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def closing(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of rows that can be ended, and what ends it: the watermark then passes all rows, whatever may be late."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, "stream-end")
    spark.createDataFrame([], rows.schema).write.parquet(path)
    ends = spark.readStream.schema(rows.schema).parquet(path)

    def value(field):
        """Not null where it can be helped: Spark drops rows without a key before it looks at their time."""
        filler = END if field.name == "ts" else 0 if isinstance(field.dataType, NumericType) else "" if isinstance(field.dataType, StringType) else None
        return F.lit(filler).cast(field.dataType).alias(field.name)

    def end() -> None:
        spark.range(1).select([value(f) for f in rows.schema]).write.mode("append").parquet(path)

    return rows.unionByName(ends), end


# ---------------------------------------------------------------- what keys do


def limiter(events: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, allowed): a window of each user starts at the first event after the last one ended; its first `limit` events pass."""
    width = seconds * 1_000_000

    def step(key, rows, memory):
        ends, used, _ = memory or (0, 0, 0)
        times = np.array([r[0] for r in rows], np.int64)
        out, i = [], 0
        while i < len(rows):
            if times[i] >= ends:
                ends, used = int(times[i]) + width, 0
            j = int(np.searchsorted(times, ends))  # the first one behind the window
            out += [(key[0], r[1], used + n < limit) for n, r in enumerate(rows[i:j])]
            used, i = used + j - i, j
        return out, (ends, used, ends)

    return in_order(events, "user_id", ["event_id"], "at long, event_id long", "ends long, used long, until long", "user_id long, event_id long, allowed boolean", step, late)


def abuse(events: DataFrame, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, recent, blocked): how many of a user's events fell into the last seconds, this one and those of the same time included."""
    width = seconds * 1_000_000

    def step(key, rows, memory):
        known = list(memory[0]) if memory else []
        times = np.array(known + [r[0] for r in rows], np.int64)
        own = times[len(known) :]
        recent = np.searchsorted(times, own, "right") - np.searchsorted(times, own - width, "right")
        out = [(key[0], r[1], n, n > most) for r, n in zip(rows, recent.tolist(), strict=True)]
        last = int(times[-1])
        return out, (times[times > last - width].tolist(), last + width)

    return in_order(events, "user_id", ["event_id"], "at long, event_id long", "times array<long>, until long", "user_id long, event_id long, recent long, blocked boolean", step, late)


def cache(operations: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, id, value) of each `get` among operations (key, id, operation, value, ts): the value put last, or null if it is none, deleted or older than so many seconds.

    Operations: put, get and delete, in the order of their times, then ids.
    """
    width = seconds * 1_000_000

    def step(key, rows, memory):
        value, expires = memory or (None, 0)
        out = []
        for at, number, operation, new in rows:
            if operation == "put":
                value, expires = new, at + width
            elif operation == "delete":
                value, expires = None, 0
            elif operation == "get":
                out.append((key[0], number, value if at < expires else None))
        return out, (value, expires)

    return in_order(operations, "key", ["id", "operation", "value"], "at long, id long, operation string, value double", "value double, expires long", "key long, id long, value double", step, late)


def alerts(windows: DataFrame, above: float, hold: int, late: str = "0 seconds") -> DataFrame:
    """(key, id, state): of each window (key, id: its number, value, ts: its end) whether the alert is inactive, pending, firing or resolved.

    It is pending from the first window above the threshold on, fires once it has been for `hold` seconds
    without a break, and is resolved in the first window not above it after it fired. A missing window breaks a
    run only if its value is null.
    """
    width = hold * 1_000_000

    def step(key, rows, memory):
        since, firing, _ = memory or (None, False, 0)
        out = []
        for at, number, value in rows:
            if value is not None and value > above:
                since = at if since is None else since
                firing = firing or at - since >= width
                state = "firing" if firing else "pending"
            else:
                state, since, firing = "resolved" if firing else "inactive", None, False
            out.append((key[0], number, state))
        return out, (since, firing, rows[-1][0] + (1 << 50) if since is not None else 0)

    return in_order(windows, "key", ["id", "value"], "at long, id long, value double", "since long, firing boolean, until long", "key string, id long, state string", step, late)
