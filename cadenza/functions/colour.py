"""Scalar functions of colours (r, g, b from 0 to 255)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / F.when(top > 0, top)).otherwise(0.0)


@F.pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def _direction(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    angles = [math.atan2(b, a) for a, b in zip(x, y, strict=True)]
    return pd.DataFrame({"x": [math.cos(a) for a in angles], "y": [math.sin(a) for a in angles]}, dtype="float64")


def hue_vector(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """The hue as a point of the unit circle, (1, 0) for greys; null if a colour is.

    By the C library, as databases take it: Java's last bits differ, and clusters of hues start from opposite points, to
    which others may be equally near but for those bits.
    """
    x, y = r - (g + b) / 2.0, (g - b) * F.sqrt(F.lit(3.0)) / 2.0
    d = F.when(x.isNotNull() & y.isNotNull(), _direction(x.cast("double"), y.cast("double")))
    return d["x"], d["y"]


def hue_of(rgb: tuple[float, float, float]) -> tuple[float, float]:
    """The same of one colour."""
    r, g, b = map(float, rgb)
    a = math.atan2((g - b) * math.sqrt(3.0) / 2.0, r - (g + b) / 2.0)
    return math.cos(a), math.sin(a)


def distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def nearest_reference(colour: list[Column], references: dict[str, tuple[float, float, float]], flip: bool = False) -> tuple[Column, Column]:
    """(hand, confidence) of a colour by its nearest reference; labels start with LH or RH, in their order.

    Confidence is how much nearer the hand's reference is than the other hand's: 1.0 if there is no other or both are
    at no distance. A null colour gives the first reference's hand and 0.0, no references give L and 0.0.
    """
    side = lambda label: ("R" if label.startswith("LH") else "L") if flip else label[0]
    named = [(i, side(label), rgb) for i, (label, rgb) in enumerate(references.items())]
    if not named:
        return F.lit("L"), F.lit(0.0)
    d = lambda rgb: distance(colour, [F.lit(float(v)) for v in rgb])
    best = F.array_min(F.array(*(F.struct(d(rgb).alias("d"), F.lit(i).alias("i"), F.lit(hand).alias("hand")) for i, hand, rgb in named)))
    least = {h: F.least(*ds) if len(ds) > 1 else ds[0] for h in "LR" if (ds := [d(rgb) for _, hand, rgb in named if hand == h])}
    other = F.when(best["hand"] == "L", least.get("R", F.lit(None).cast("double"))).otherwise(least.get("L", F.lit(None).cast("double")))
    total = other + best["d"]
    conf = F.when(other.isNull() | (total == 0), 1.0).otherwise(F.try_divide(other, total))
    null = colour[0].isNull() | colour[1].isNull() | colour[2].isNull()
    return F.when(null, named[0][1]).otherwise(best["hand"]), F.when(null, 0.0).otherwise(conf)


def is_lit(colour: list[Column], base: list[Column], threshold: float = 40.0) -> Column:
    return distance(colour, base) > threshold


def is_separated(distance_: Column, least: float = 60.0) -> Column:
    """Whether two clusters of colours are far enough apart to be two hands."""
    return distance_ >= least


def is_separated_in_hue(chord: Column, least: float = 0.5) -> Column:
    """The same for clusters of hues on the unit circle."""
    return chord >= least
