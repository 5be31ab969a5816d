"""Histograms, offsets, thresholds and clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import SharedTables


def window_means(rows: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """Mean and number of values per window that has any: keys, window_start, mean, n."""
    start = F.floor(F.col(at) / F.lit(float(width))) * F.lit(float(width))
    return rows.groupBy(*keys, start.alias("window_start")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def onset_density(times: DataFrame, keys: list[str], at: str, duration: float | None = None, width: float = 0.05) -> DataFrame:
    """Histogram with empty bins as 0: keys, bin, n. Times before 0 don't count.

    Without ``duration`` bins reach to the key's own largest time (a key without times from 0 on has one); with it, times
    past its last bin don't count.
    """
    own = times.where(F.col(at) >= 0).withColumn("bin", (F.col(at) / F.lit(float(width))).cast("int"))
    if duration is None:
        bins = F.when(F.col(at) >= 0, (F.col(at) / F.lit(float(width))).cast("int"))
        every = times.groupBy(*keys).agg(F.coalesce(F.max(bins), F.lit(0)).alias("_last"))
    else:
        bins = max(1, math.ceil(duration / width))
        own, every = own.where(F.col("bin") < bins), times.select(*keys).distinct().withColumn("_last", F.lit(bins - 1))
    own = own.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    return every.join(own, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def estimated_offset(presses: DataFrame, onsets: DataFrame, keys: list[str], at: str, most: float = 5.0, width: float = 0.05) -> DataFrame:
    """Shift (keys, offset_sec, score) at which the two sides' histograms agree best; the first one if several do.

    Only bins with events are shifted and joined; every shift starts from 0, so sides that never meet give -``most``.
    Keys that miss a side give 0.0 with a null score.
    """
    steps = int(round(most / width))
    hist = lambda d, name: d.where(F.col(at) >= 0).groupBy(*keys, (F.col(at) / F.lit(float(width))).cast("int").alias("bin")).agg(F.count("*").alias(name))
    a, b = hist(presses, "p"), hist(onsets, "o").withColumnRenamed("bin", "ob")
    shifts = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys).withColumn("shift", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("product", F.lit(0).cast("long"))
    # bins that are at most so many apart are in the same or in neighbouring stretches of that length
    stretch = F.floor(F.col("ob") / F.lit(max(1, steps)))
    near = b.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    met = near.join(a.withColumn("stretch", F.floor(F.col("bin") / F.lit(max(1, steps)))), [*keys, "stretch"]).withColumn("shift", F.col("bin") - F.col("ob")).where(F.abs("shift") <= steps)
    met = met.select(*keys, "shift", (F.col("p") * F.col("o")).alias("product"))
    total = shifts.select(*keys, "shift", "product").union(met).groupBy(*keys, "shift").agg(F.sum("product").alias("score"))
    best = total.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "shift")).alias("b"))
    best = best.select(*keys, (F.col("b.shift") * F.lit(float(width))).alias("offset_sec"), (-F.col("b.s")).alias("score"))
    every = presses.select(*keys).union(onsets.select(*keys)).distinct()
    return every.join(best, keys, "left").withColumn("offset_sec", F.coalesce("offset_sec", F.lit(0.0)))


def press_moments(points: DataFrame, keys: list[str], at: str = "time_sec", y: str = "y", order: str = "frame_idx") -> DataFrame:
    """Times at which a finger stops moving down: the vertical speed, by three-point differences, turns from positive."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    d = points.select(*keys, at, y, order).withColumns({"_y0": F.lag(y).over(w), "_y1": F.lead(y).over(w), "_t0": F.lag(at).over(w), "_t1": F.lead(at).over(w)})
    a, b = F.col(at) - F.col("_t0"), F.col("_t1") - F.col(at)
    # the difference quotients on either side, weighted by the other side's spacing
    left, right = F.try_divide(F.col(y) - F.col("_y0"), a), F.try_divide(F.col("_y1") - F.col(y), b)
    speed = F.when(F.col("_t0").isNull(), right).when(F.col("_t1").isNull(), left).otherwise(F.try_divide(b * left + a * right, a + b))
    d = d.withColumn("_v", speed).withColumn("_v0", F.lag("_v").over(w))
    return d.where((F.col("_v0") > 0) & (F.col("_v") <= 0) & F.col("_t1").isNotNull()).select(*keys, at)


def percentile_anchors(rows: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Exact percentiles with linear interpolation, cut to integers: keys, low_anchor, high_anchor, n."""
    p = F.percentile(F.col(value).cast("double"), F.array(F.lit(low), F.lit(high)))
    out = rows.groupBy(*keys).agg(p.alias("_p"), F.count(value).alias("n"))
    return out.select(*keys, F.element_at("_p", 1).cast("int").alias("low_anchor"), F.element_at("_p", 2).cast("int").alias("high_anchor"), "n")


def otsu_threshold(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The cut between two classes of values that separates them best: keys, threshold (midpoint), variance.

    Values are summed once per distinct value, so the running sums pass over distinct values only.
    """
    d = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    w = Window.partitionBy(*keys).orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    d = d.withColumns({"n0": F.sum("c").over(run), "s0": F.sum("s").over(run), "n": F.sum("c").over(every), "st": F.sum("s").over(every), "_next": F.lead("v").over(w)}).where("_next IS NOT NULL")
    m0, m1 = F.col("s0") / F.col("n0"), (F.col("st") - F.col("s0")) / (F.col("n") - F.col("n0"))
    var = (F.col("n0") / F.col("n")) * ((F.col("n") - F.col("n0")) / F.col("n")) * (m0 - m1) * (m0 - m1)
    best = d.groupBy(*keys).agg(F.min(F.struct((-var).alias("nv"), F.col("v"), F.col("_next"))).alias("b"))
    return best.select(*keys, ((F.col("b.v") + F.col("b._next")) / 2.0).alias("threshold"), (-F.col("b.nv")).alias("variance"))


def two_means(rows: DataFrame, keys: list[str], values: list[str], ident: str, rounds: int = 20) -> DataFrame:
    """Two clusters per key: keys, ident, cluster, separation (distance of the centres).

    Starts from the first row and the one farthest from it (the first such one, by squares: roots of unequal squares can
    be equal); ties go to cluster 0; an empty cluster
    keeps its centre. What passes from round to round is a row of centres per key, written to the shared folder: a round
    deals the rows to their nearer centre and takes both means by aggregates, and the rounds end when no centre moves
    any more, or after ``rounds``. Rows that lack a value are in no cluster.
    """
    tables = SharedTables(rows.sparkSession, "means")
    n = len(values)
    rows = rows.select(*keys, ident, F.array(*(F.col(v).cast("double") for v in values)).alias("_v"), *(F.col(v).alias(f"_own{i}") for i, v in enumerate(values))).dropna(subset=[f"_own{i}" for i in range(n)]).select(*keys, ident, "_v")
    rows = tables.write(rows, "rows")
    square = lambda c: sum((F.col("_v")[i] - F.col(c)[i]) * (F.col("_v")[i] - F.col(c)[i]) for i in range(n))
    away = lambda c: F.sqrt(square(c))
    same_key = lambda d: _same(keys, d)
    start = rows.groupBy(*keys).agg(F.min(F.struct(ident, "_v"))["_v"].alias("_c0"))
    met = rows.join(same_key(start), _on(keys)).drop(*(f"_of_{k}" for k in keys))
    state = met.groupBy(*keys).agg(F.first("_c0").alias("_c0"), F.min(F.struct((-square("_c0")).alias("d"), ident, "_v"))["_v"].alias("_c1"))
    state = tables.write(state.withColumn("_moved", F.lit(True)), "0")
    near = lambda: F.when(away("_c1") < away("_c0"), 1).otherwise(0)
    for step in range(1, rounds + 1):
        live = state.where("_moved")  # keys whose centres stand are done
        dealt = rows.join(same_key(live), _on(keys)).drop(*(f"_of_{k}" for k in keys)).withColumn("_k", near())
        mean = lambda k: F.array(*(F.coalesce(F.avg(F.when(F.col("_k") == k, F.col("_v")[i])), F.first(f"_c{k}")[i]) for i in range(n)))
        new = dealt.groupBy(*keys).agg(mean(0).alias("_n0"), mean(1).alias("_n1"), F.first("_c0").alias("_c0"), F.first("_c1").alias("_c1"))
        new = new.select(*keys, F.col("_n0").alias("_c0"), F.col("_n1").alias("_c1"), ((F.col("_n0") != F.col("_c0")) | (F.col("_n1") != F.col("_c1"))).alias("_moved"))
        moved = Observation()
        new = tables.write(state.where("NOT _moved").unionByName(new).observe(moved, F.count_if("_moved").alias("n")), str(step))
        tables.drop(str(step - 1))
        state = new
        if not moved.get["n"]:
            break
    gap = F.sqrt(sum((F.col("_c0")[i] - F.col("_c1")[i]) * (F.col("_c0")[i] - F.col("_c1")[i]) for i in range(n)))
    out = rows.join(same_key(state), _on(keys))
    return out.select(*keys, ident, near().alias("cluster"), gap.alias("separation"))


def _same(keys: list[str], d: DataFrame) -> DataFrame:
    return d.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def _on(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return on


def cluster_hands(clustered: DataFrame, keys: list[str], pitch: str, flip: bool = False) -> DataFrame:
    """Rows with ``hand``: the cluster of lower mean pitch is left, cluster 0 on a tie; an empty cluster counts as highest."""
    mean = lambda k: F.avg(F.when(F.col("cluster") == k, F.col(pitch))).over(Window.partitionBy(*keys))
    low = F.when(F.coalesce(mean(0), F.lit(float("inf"))) <= F.coalesce(mean(1), F.lit(float("inf"))), 0).otherwise(1)
    left, right = ("R", "L") if flip else ("L", "R")
    return clustered.withColumn("hand", F.when(F.col("cluster") == low, left).otherwise(right))


def assigned_hands(notes: DataFrame, keys: list[str], ident: str, pitch: str = "pitch", flip: bool = False, grey: float = 0.05, apart: float = 0.5, middle: float = 60.0) -> DataFrame:
    """Notes (keys, ident, pitch, r, g, b) with hand, confidence and degenerate, from two clusters of their hues.

    Colours that are grey on average, or hues that don't part, tell nothing: then all notes of a key get one hand by
    their median pitch, confidence 0, whatever ``flip`` says.
    """
    from ..functions.colour import hue_vector, is_separated_in_hue, saturation

    c = [F.col(x) for x in "rgb"]
    x, y = hue_vector(*c)
    whole = notes.groupBy(*keys).agg(F.avg(saturation(*c)).alias("_sat"), F.median(pitch).alias("_mid"))
    n = notes.withColumns({"_hx": x, "_hy": y})
    both = two_means(n, keys, ["_hx", "_hy"], ident)
    n = cluster_hands(n.join(both, [*keys, ident]), keys, pitch, flip).join(whole, keys)
    plain = (F.col("_sat") < grey) | ~is_separated_in_hue(F.col("separation"), apart)
    one = F.when(F.col("_mid") < middle, "L").otherwise("R")
    out = n.withColumns({"degenerate": plain, "hand": F.when(plain, one).otherwise(F.col("hand")), "confidence": F.when(plain, 0.0).otherwise(F.col("separation") / (F.col("separation") + apart))})
    return out.drop("_hx", "_hy", "_sat", "_mid", "cluster", "separation")
