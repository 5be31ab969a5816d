"""Joins and timers over two tables that grow: notes that sound at frames, notes nobody was seen at, notes left open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _on(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return on


def streamed_range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, longest: str, late: str = "10 seconds") -> DataFrame:
    """Points with the intervals of their keys that contain them, both ends included, as rows come on either side.

    Times are timestamps. An interval meets points up to ``longest`` after its start, so both sides' rows leave the state
    once the watermarks, ``late`` behind the newest rows, have passed that. Rows later than that are dropped, and rows at
    the start of 1970 or before it are late from the first. A table that doesn't grow keeps all its rows. Other columns must differ in name; null keys and times meet nothing.
    """
    p = points.withWatermark(at, late)
    i = intervals.withColumnsRenamed({k: f"_{k}" for k in keys}).withWatermark(low, late)
    inside = (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)) & (F.col(at) <= F.col(low) + F.expr(f"INTERVAL {longest}"))
    return p.join(i, _on(keys) & inside).drop(*(f"_{k}" for k in keys))


def streamed_unseen(notes: DataFrame, points: DataFrame, keys: list[str], at: str, seen_at: str, reach: str, late: str = "10 seconds") -> DataFrame:
    """Notes without a point of their keys at most ``reach`` before or after them, once no such point can come any more.

    A note comes out when both watermarks have passed it by more than ``reach``; one that a late row is dropped for, too.
    Rows at the start of 1970 or before it are late from the first.
    """
    n = notes.withWatermark(at, late)
    p = points.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(seen_at).alias("_seen")).withWatermark("_seen", late)
    near = (F.col("_seen") >= F.col(at) - F.expr(f"INTERVAL {reach}")) & (F.col("_seen") <= F.col(at) + F.expr(f"INTERVAL {reach}"))
    return n.join(p, _on(keys) & near, "left_outer").where("_seen IS NULL").drop("_seen", *(f"_{k}" for k in keys))


def streamed_notes(events: DataFrame, at: str = "at", longest: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """Notes of key events (song_id, pitch, ``at``, is_on) as they end: song_id, pitch, on_at, off_at, expired.

    A key's state is the ons that wait for an off, first in first out; an off without one counts nothing. An on that
    waits ``longest`` seconds is given up by a timer of event time and comes out with that end and ``expired``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: list[int] = list(state.get[0]) if state.exists else []
        keep = int(longest * 1_000_000)
        out: list[tuple[int, int, bool]] = []

        def given_up(now: int) -> None:
            while waiting and waiting[0] + keep < now:
                on = waiting.pop(0)
                out.append((on, on + keep, True))

        if state.hasTimedOut:
            given_up(state.getCurrentWatermarkMs() * 1000 + 1)
        else:
            rows = pd.concat(list(batches)).sort_values([at, "is_on"], kind="stable")
            for t, is_on in zip(rows[at].astype("datetime64[us]").astype("int64"), rows["is_on"], strict=True):
                given_up(int(t))
                if is_on:
                    waiting.append(int(t))
                elif waiting:
                    out.append((waiting.pop(0), int(t), False))
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max((waiting[0] + keep) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame({"song_id": key[0], "pitch": key[1], "on_at": pd.to_datetime([o[0] for o in out], unit="us"), "off_at": pd.to_datetime([o[1] for o in out], unit="us"), "expired": [o[2] for o in out]})

    grouped = events.withWatermark(at, late).groupBy("song_id", "pitch")
    return grouped.applyInPandasWithState(step, "song_id string, pitch int, on_at timestamp, off_at timestamp, expired boolean", "waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
