"""Moving objects and event windows in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HALF = 1 << 62
OUT = "guid string, x long, y long, z long, last_ms long"
STATE = "x long, y long, z long, vx int, vy int, vz int, last_ms long, registered boolean"


def effective(v: tuple[int, int, int]) -> tuple[int, int, int]:
    size = [abs(c) for c in v]
    return v if max(size) >= 10 and sum(size) >= 20 else (0, 0, 0)


def advance(state: tuple, now: int) -> tuple:
    """The state of an object at `now` ms: moved by its velocity, or in place if it would leave the universe."""
    x, y, z, vx, vy, vz, last, registered = state
    elapsed = now - last
    if not registered or elapsed <= 0 or (vx, vy, vz) == (0, 0, 0):
        return state
    goal = [p + v * elapsed for p, v in zip((x, y, z), (vx, vy, vz))]
    if all(-HALF <= c < HALF for c in goal):
        x, y, z = goal
    return x, y, z, vx, vy, vz, now, registered


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events = sorted((tuple(r) for b in batches for r in b[["ts_ms", "kind", "x", "y", "z"]].itertuples(index=False)), key=lambda e: (e[0], e[1]))
    now = tuple(state.get) if state.exists else (0, 0, 0, 0, 0, 0, 0, False)
    for ts, kind, x, y, z in events:
        if kind == "tick":
            now = advance(now, int(ts))
        elif kind == "insert":
            now = (int(x), int(y), int(z), 0, 0, 0, int(ts), False)
        elif kind in ("register", "unregister"):
            now = (*now[:6], int(ts), kind == "register")
        elif kind in ("set_velocity", "accelerate"):
            base = now[3:6] if kind == "accelerate" else (0, 0, 0)
            now = (*now[:3], *effective(tuple(int(b) + int(v) for b, v in zip(base, (x, y, z)))), *now[6:])
    state.update(now)
    yield pd.DataFrame([(key[0], *now[:3], now[6])], columns=["guid", "x", "y", "z", "last_ms"])


def track(events: DataFrame) -> DataFrame:
    """Positions after each micro-batch. events: guid, ts_ms, kind, x, y, z; kind is insert, register, unregister,
    set_velocity, accelerate or tick. Only a tick moves an object, by its velocity then times the ms since it last moved or
    was registered."""
    return events.groupBy("guid").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum of `value` by event type in tumbling (or sliding) windows; rows later than `late` are dropped in a stream."""
    marked = events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events less than the gap apart."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
