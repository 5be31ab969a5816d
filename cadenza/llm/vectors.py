"""Vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(key: Column, vector: Column) -> Column:
    """The row has a key and a vector with a direction: not null, nor empty, no null or non-finite component, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(key.isNotNull() & vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def element(df: DataFrame, vector: str) -> str:
    """'<f4' for arrays of floats, else '<f8': how vectors travel."""
    return "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def matrix(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def packed(column: pa.Array, kind: str) -> list[bytes]:
    """Each list of the column as bytes."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.cumsum(np.asarray(column.value_lengths()))
    return [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), np.asarray(column.value_lengths()).tolist(), strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths. Sums run along rows, so a row's result doesn't depend on its batch; the largest
    component is divided out first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs_of(batches, keys: int):
    """(key, slice) of the batches of a sorted partition: rows in a row that share their first ``keys`` columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            cut[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield tuple(batch.column(c)[lo].as_py() for c in range(keys)), batch.slice(lo, hi - lo)


def groups_of(batches, keys: int, most: int = 1 << 60):
    """Batches of a partition sorted by its first ``keys`` columns, regrouped as one table per key, or as several in a
    row of ``most`` rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    last = None
    for now, part in runs_of(batches, keys):
        if held and now != last:
            yield last, pa.Table.from_batches(held)
            held, rows = [], 0
        last = now
        while part.num_rows:
            n = min(part.num_rows, most - rows)
            held.append(part.slice(0, n))
            part, rows = part.slice(n), rows + n
            if rows == most:
                yield last, pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield last, pa.Table.from_batches(held)
