"""Windowed means, sessions and runs for tables that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def streamed_means(events: DataFrame, keys: list[str], at: str, value: str, window: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Mean and number of values per window, each ``slide`` later than the one before (no overlap if None); rows more
    than ``late`` behind the newest are dropped, so state stays bounded. A table that doesn't grow keeps all its rows."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window, slide or window), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "mean", "n")


def streamed_sessions(events: DataFrame, keys: list[str], at: str, value: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key, which end when nothing comes for ``gap``: session_start, session_end (last row and gap), keys,
    mean, n. Late rows as in ``streamed_means``."""
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("_session"), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return w.select(F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), *keys, "mean", "n")


def streamed_runs(events: DataFrame, key: str, at: str, value: str, below: float, length: int = 3) -> DataFrame:
    """Starts of runs of ``length`` values in a row below a limit, per key: key, run_start. State is a count and a time."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, start = state.get if state.exists else (0, None)
        out = []
        for p in batches:
            for t, v in p.sort_values(at)[[at, value]].itertuples(index=False):
                if v < below:
                    n, start = n + 1, t if n == 0 else pd.Timestamp(start)
                    if n == length:
                        out.append(start)
                else:
                    n, start = 0, None
        state.update((n, start))
        yield pd.DataFrame({key: [name[0]] * len(out), "run_start": out})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, run_start timestamp", "n int, start timestamp", "append", GroupStateTimeout.NoTimeout)
