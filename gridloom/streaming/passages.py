"""Streams: passages and moving summaries of events as they arrive.

The batch operators and these share their rules: :func:`step` is the state machine of
:func:`gridloom.operators.ordered.crossings` for one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "key long, entry long, exit long, direction string, status string"


def step(state: tuple[int, int], frame: int, s: float, low: float, high: float) -> tuple[tuple[int, int], tuple | None]:
    """One frame of one key. ``state``: the bulk side last seen (0: none yet) and its frame. Also an event, if one ends here."""
    side = -1 if s < low else 1 if s > high else 0
    last, at = state
    event = None
    if side and last and side != last:
        straight = frame == at + 1
        event = (at if straight else at + 1, frame, "up" if side == 1 else "down", "unresolved_single_interval" if straight else "complete")
    return ((side, frame) if side else state), event


def advance(state: tuple, rows: list[tuple[int, float]], low: float, high: float, hold: int = 0) -> tuple[tuple, list[tuple]]:
    """Further frames of one key, in any order. ``state``: side, its frame, last frame told, frames held back and their values.

    Frames less than ``hold`` below the latest one are held back, so that others may still come between them. A frame at or below the
    last one told comes too late, which is an error.
    """
    side, at, told, frames, values = state
    waiting = sorted([*zip(frames, values, strict=True), *rows])
    if waiting and waiting[0][0] <= told:
        raise ValueError(f"frame {waiting[0][0]} comes after frame {told} was told")
    ready = [x for x in waiting if x[0] <= waiting[-1][0] - hold] if waiting else []
    now, out = (side, at), []
    for frame, s in ready:
        now, event = step(now, frame, s, low, high)
        told = frame
        if event:
            out.append(event)
    rest = waiting[len(ready) :]
    return (*now, told, [f for f, _ in rest], [s for _, s in rest]), out


def passages(frames: DataFrame, low: float, high: float, hold: int = 0) -> DataFrame:
    """Passages of a stream of (key, frame, s). Frames of a key may come in any order as long as none is ``hold`` frames late or more.

    The last ``hold`` frames of each key stay in its state: what ends in them is told when later frames come.
    """
    import pandas as pd

    def run(key, batches, state):
        now = tuple(state.get) if state.exists else (0, 0, -1, [], [])
        rows = pd.concat(list(batches))
        now, events = advance(now, [(int(f), float(s)) for f, s in zip(rows.frame, rows.s, strict=True)], low, high, hold)
        state.update(now)
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["key", "entry", "exit", "direction", "status"])

    return frames.groupBy("key").applyInPandasWithState(run, EVENT, "side int, frame long, told long, frames array<long>, values array<double>", "append", "NoTimeout")


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and mean of value in tumbling windows of event time for each kind, with a watermark for late events."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
