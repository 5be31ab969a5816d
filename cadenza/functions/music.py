"""Scalar functions of keys, names, confidence and calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Left edges of an octave's white keys in white-key units; a black key stands 0.7 past its lower neighbour.
WHITE = (0, 0.7, 1, 1.7, 2, 3, 3.7, 4, 4.7, 5, 5.7, 6)
#: Note names by pitch class.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
BLACK = (1, 3, 6, 8, 10)


def _octave(pitch: Column) -> Column:
    return F.floor(pitch / F.lit(12))


def white_index(pitch: Column) -> Column:
    """Continuous white-key coordinate: white keys are whole numbers."""
    steps = F.array(*(F.lit(float(int(w))) for w in WHITE))
    at = F.element_at(steps, F.pmod(pitch, F.lit(12)).cast("int") + 1) + _octave(pitch) * 7.0
    return F.when(is_black(pitch), at + 0.7).otherwise(at)


def is_black(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(*BLACK)


def nearest_pitch(index: Column) -> Column:
    """Pitch 0..127 whose white index is nearest; the lower one if two are."""
    low = F.greatest(F.lit(0), F.floor(F.floor(index) * 12 / 7).cast("int") - 12)
    high = F.least(F.lit(127), F.floor(F.ceil(index) * 12 / 7).cast("int") + 12)
    near = F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.struct(F.abs(white_index(p) - index).alias("d"), p.alias("p")))
    return F.array_min(near)["p"]


def note_name(pitch: Column) -> Column:
    """60 is C4."""
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(pitch, F.lit(12)).cast("int") + 1), (_octave(pitch) - 1).cast("string"))


def confidence(distance: Column, scale: float) -> Column:
    """1 at no distance, falling exponentially."""
    return F.exp(-F.greatest(F.lit(0.0), distance) / F.lit(max(1e-6, scale)))


def homography(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 projective map."""
    row = lambda r: F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2]))
    w = row(h[2])
    return row(h[0]) / w, row(h[1]) / w


def solve_homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[list[float]]:
    """The projective map that takes four or more points to others, by singular values, on the driver."""
    import numpy as np

    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.asarray(rows, float))[2][-1].reshape(3, 3)
    return (h / h[2, 2]).tolist()


def fit_row(u: list[float], x: list[float], y: list[float]) -> list[float] | None:
    """[a, b, c, d, e] of x = (a u + b)/(e u + 1), y = (c u + d)/(e u + 1) by least squares; null if under-determined."""
    import numpy as np

    if len(u) < 3:
        return None
    rows = [r for ui, xi, yi in zip(u, x, y, strict=True) for r in ([ui, 1, 0, 0, -ui * xi], [0, 0, ui, 1, -ui * yi])]
    want = [v for xi, yi in zip(x, y, strict=True) for v in (xi, yi)]
    out, _, rank, _ = np.linalg.lstsq(np.asarray(rows, float), np.asarray(want, float), rcond=None)
    return out.tolist() if rank == 5 else None


def _away_from_zero(w: Column, least: float = 1e-9) -> Column:
    """A divisor at least so far from zero, on its own side."""
    return F.when(F.abs(w) >= least, w).otherwise(F.when(w >= 0, least).otherwise(-least))


def row_project(row: list[float], u: Column) -> tuple[Column, Column]:
    a, b, c, d, e = map(float, row)
    w = _away_from_zero(F.lit(e) * u + 1.0)
    return (F.lit(a) * u + b) / w, (F.lit(c) * u + d) / w


def row_invert(row: list[float], x: Column) -> Column:
    """u of a screen x on the row."""
    a, b, _, _, e = map(float, row)
    return (F.lit(b) - x) / _away_from_zero(F.lit(e) * x - a)


def to_screen(u: Column, row: list[float] | None, h: list[list[float]], near: bool = False, v: float = 0.9) -> tuple[Column, Column]:
    """Where a position along the keyboard is on the screen: on the row of keys, or, without a row or with a near one
    too, at depth ``v`` (where fingers rest) of the projective map ``h`` from the screen."""
    import numpy as np

    if row is not None and not near:
        return row_project(row, u)
    return homography(np.linalg.inv(np.asarray(h, float)).tolist(), u, F.lit(float(v)))


def normal_x(pitch: Column, low: int, high: int) -> Column:
    """Position of a key between the lowest and the highest, 0.5 if those are one."""
    lo, hi = white_index(F.lit(low)), white_index(F.lit(high))
    return F.when(hi == lo, 0.5).otherwise((white_index(pitch) - lo) / (hi - lo))


def normal_to_pitch(u: Column, low: int, high: int) -> Column:
    lo, hi = white_index(F.lit(low)), white_index(F.lit(high))
    return F.greatest(F.lit(low), F.least(F.lit(high), nearest_pitch(lo + u * (hi - lo))))


def playable_finger(finger: Column) -> Column:
    """1..5, else null (wrist and palm points)."""
    return F.when(finger.between(1, 5), finger)


def seed_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Whole octaves around the lowest and highest pitch, within 0..127; 21 and 108 if there is none."""
    down = F.greatest(F.lit(0), (F.floor(low / F.lit(12)) * 12).cast("int"))
    up = F.least(F.lit(127), (F.ceil(high / F.lit(12)) * 12).cast("int"))
    return F.coalesce(down, F.lit(21)), F.coalesce(up, F.lit(108))


def snapped_edge(pitch: Column) -> Column:
    """The nearest C or A within six semitones, the lower one if two are."""
    near = F.sequence(F.greatest(F.lit(0), pitch - 6), F.greatest(F.greatest(F.lit(0), pitch - 6), F.least(F.lit(126), pitch + 6)))
    near = F.filter(near, lambda p: (p % 12 == 0) | (p % 12 == 9))
    return F.array_min(F.transform(near, lambda p: F.struct(F.abs(p - pitch).alias("d"), p.alias("p"))))["p"]
