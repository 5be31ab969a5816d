"""Primitives over timed rows: range joins, as-of joins, clusters, islands, runs and next values.

Every operator takes ``keys``, the columns that separate timelines (a song, a user), and never needs a whole timeline
in one task's memory unless it says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import numbered_clusters


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """Inside, joins leave rows in place that are dealt by some of their keys. Spark would else deal both sides again by
    all keys; tables that share timelines, each of which fits a task, would be shuffled at every join. A task then does
    the work of many, so it gets fewer rows. What is planned inside must be computed inside."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def bucket(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(float(width))).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: float, how: str = "inner", nulls: bool = True) -> DataFrame:
    """Points and the intervals of their timeline that contain them, both ends included.

    A range condition alone would make a nested loop; a bucket of ``width`` as a further key makes it an equi-join. An
    interval is listed once per bucket it touches, so ``width`` should be about a usual interval's length. Columns of
    the two sides other than ``keys`` must differ in name. ``how`` may be inner, left, left_semi or left_anti.
    Null keys are equal; without ``nulls`` they meet nothing, and rows that are dealt by their keys need no shuffle.
    """
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low), width), bucket(F.col(high), width))))
    spread = spread.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = _equal(keys, "_", nulls) & (F.col("_at_bucket") == F.col("_bucket"))
    same &= (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    out = points.withColumn("_at_bucket", bucket(F.col(at), width)).join(spread, same, how)
    return out.drop("_at_bucket", "_bucket", *(f"_{k}" for k in keys))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, reach: float, how: str = "inner", nulls: bool = True) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` at most ``reach`` before or after them; ``nulls`` as in ``range_join``."""
    spread = left.withColumns({"_low": F.col(left_at) - reach, "_high": F.col(left_at) + reach})
    spread = spread.withColumn("_lb", F.explode(F.sequence(bucket(F.col("_low"), reach), bucket(F.col("_high"), reach))))
    other = right.withColumn("_rb", bucket(F.col(right_at), reach)).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = _equal(keys, "_", nulls) & (F.col("_lb") == F.col("_rb"))
    same &= (F.col(right_at) >= F.col("_low")) & (F.col(right_at) <= F.col("_high"))
    return spread.join(other, same, how).drop("_low", "_high", "_lb", "_rb", *(f"_{k}" for k in keys))


def _equal(keys: list[str], prefix: str, nulls: bool = True) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) if nulls else F.col(k) == F.col(f"{prefix}{k}")
    return on


def neighbours_two_sided(queries: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_at: str, frame_id: str, width: float = 60.0, nulls: bool = True) -> DataFrame:
    """Each query with its nearest frame at or before it and the nearest after it: before_id, before_at, after_id, after_at.

    Both sides are sorted together inside stretches of ``width``; a query reads the last frame before it and, in the
    reverse order, the last one after it. What a stretch doesn't hold comes from the first and last frames of the
    stretches around, a row a stretch. So a long timeline is many tasks, and each pass over it is linear. Frames
    without a time don't count, queries without one find none; ``nulls`` as in ``range_join``.
    """
    q = queries.withColumns({"_t": F.col(at).cast("double"), "_f": F.lit(None).cast(frames.schema[frame_id].dataType), "_is_q": F.lit(1)})
    f = frames.where(F.col(frame_at).isNotNull()).select(*keys, F.col(frame_at).cast("double").alias("_t"), F.col(frame_id).alias("_f"), F.lit(0).alias("_is_q"))
    both = q.unionByName(f, allowMissingColumns=True).withColumn("_at_stretch", bucket(F.col("_t"), width))
    both = both.withColumn("_own", F.when(F.col("_is_q") == 0, F.struct("_t", "_f")))
    stretch = Window.partitionBy(*keys, "_at_stretch")
    forth, back = (stretch.orderBy(*(F.asc(c) for c in ("_t", "_is_q", "_f"))), stretch.orderBy(*(F.desc(c) for c in ("_t", "_is_q", "_f"))))
    so_far = lambda w: F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_b", so_far(forth)).withColumn("_a", so_far(back)).where("_is_q = 1")
    ends = both.groupBy(*keys, "_at_stretch").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last"))
    line = Window.partitionBy(*keys)
    carried = lambda c, o: F.last(c, ignorenulls=True).over(line.orderBy(o).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_at_stretch").alias("_of_stretch"), carried("_last", F.asc("_at_stretch")).alias("_cb"), carried("_first", F.desc("_at_stretch")).alias("_ca"))
    out = near.join(ends, _equal(keys, "_of_", nulls) & (F.col("_at_stretch") == F.col("_of_stretch")), "left")
    before, after = F.coalesce("_b", "_cb"), F.coalesce("_a", "_ca")
    seen = lambda side, c: F.when(F.col("_t").isNotNull(), side[c])
    out = out.withColumns({"before_id": seen(before, "_f"), "before_at": seen(before, "_t"), "after_id": seen(after, "_f"), "after_at": seen(after, "_t")})
    return out.drop("_t", "_f", "_is_q", "_own", "_at_stretch", "_of_stretch", "_b", "_a", "_cb", "_ca", *(f"_of_{k}" for k in keys))


def positions(rows: DataFrame, keys: list[str], at: str, order: list[str], out: str, counted: Column | None = None, width: float = 60.0, nulls: bool = True) -> DataFrame:
    """Rows with ``out``: how many counted rows (all, if not told) of their timeline stand before them.

    Rows are counted inside stretches of ``width`` and the stretches' totals are summed apart, so a long timeline is
    many tasks. ``at`` must not be null. Without ``nulls``, rows of null keys are left out (see ``range_join``).
    """
    own = (F.lit(True) if counted is None else counted).cast("long")
    cut = rows.withColumns({"_at_stretch": bucket(F.col(at), width), "_own": own})
    inside = Window.partitionBy(*keys, "_at_stretch").orderBy(at, *order)
    cut = cut.withColumn(out, F.sum("_own").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own"))
    sums = cut.groupBy(*keys, "_at_stretch").agg(F.sum("_own").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_at_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_at_stretch").alias("_of_stretch"), upto.alias("_upto"))
    got = cut.join(sums, _equal(keys, "_of_", nulls) & (F.col("_at_stretch") == F.col("_of_stretch"))).withColumn(out, F.col(out) + F.col("_upto"))
    return got.drop("_at_stretch", "_of_stretch", "_own", "_upto", *(f"_of_{k}" for k in keys))


def interpolated_points(queries: DataFrame, frames: DataFrame, points: DataFrame, gap: float = 0.20, carry: float = 0.15, keys: list[str] | None = None, at: str = "at", query_id: str = "query_id") -> DataFrame:
    """Points (hand, finger, x, y) of the two-sided as-of join at each query's time.

    ``frames`` has frame_idx and time_sec, ``points`` song, frame_idx, hand, finger, x, y; frames without points don't
    count. If both sides exist within ``gap`` of each other, points that both have are interpolated and others pass
    through; otherwise the closer side within ``carry`` is taken, before on a tie; else none.
    """
    keys = keys or ["song_id"]
    with_hands = points.select(*keys, "frame_idx").distinct()
    live = frames.join(with_hands, [*keys, "frame_idx"], "left_semi")
    near = neighbours_two_sided(queries.select(*keys, query_id, at), live, keys, at, "time_sec", "frame_idx", nulls=False)
    both = F.coalesce((F.col("after_at") - F.col("before_at")) <= gap, F.lit(False))
    d_before, d_after = F.col(at) - F.col("before_at"), F.col("after_at") - F.col(at)
    use_before = d_before.isNotNull() & (d_before <= carry) & (d_after.isNull() | (d_before <= d_after))
    use_after = d_after.isNotNull() & (d_after <= carry)
    near = near.withColumn("mode", F.when(both, "lerp").when(F.coalesce(use_before, F.lit(False)), "before").when(F.coalesce(use_after, F.lit(False)), "after"))
    near = near.where(F.col("mode").isNotNull())
    span = F.col("after_at") - F.col("before_at")
    near = near.withColumn("w", F.when(F.col("mode") == "before", 0.0).when(F.col("mode") == "after", 1.0).otherwise(F.coalesce(F.try_divide(F.col(at) - F.col("before_at"), span), F.lit(0.0))))
    # a query and a frame it looks at, one or two rows a query, so that points are joined once
    looks = F.array_compact(F.array(
        F.when(F.col("mode").isin("lerp", "before"), F.struct(F.col("before_id").alias("frame_idx"), F.lit(0).alias("side"))),
        F.when(F.col("mode").isin("lerp", "after"), F.struct(F.col("after_id").alias("frame_idx"), F.lit(1).alias("side")))))
    near = near.select(*keys, query_id, "w", F.explode(looks).alias("l")).select(*keys, query_id, "w", "l.frame_idx", "l.side")
    all_points = near.join(points, [*keys, "frame_idx"]).select(*keys, query_id, "w", "side", "hand", "finger", "x", "y")
    v = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    got = all_points.groupBy(*keys, query_id, "hand", "finger").agg(F.max("w").alias("w"), v("x", 0).alias("x0"), v("x", 1).alias("x1"), v("y", 0).alias("y0"), v("y", 1).alias("y1"))
    mixed = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col("w") * (F.col(b) - F.col(a)))
    return got.select(*keys, query_id, "hand", "finger", mixed("x0", "x1").alias("x"), mixed("y0", "y1").alias("y"))


def anchored_clusters(rows: DataFrame, keys: list[str], at: str, order: list[str], tolerance: float, out: str = "cluster") -> DataFrame:
    """Number clusters from 0 per timeline; a row joins while it is at most ``tolerance`` after its cluster's FIRST row.

    Each cluster's first row depends on the one before, so a timeline's rows pass in order through a task that holds one
    time; the work is linear however dense they are. Rows without a time are in no cluster.
    """
    return numbered_clusters(rows, keys, at, order, tolerance, out)


def islands(rows: DataFrame, keys: list[str], at: str, order: list[str], on: Column) -> DataFrame:
    """Stretches (keys, start_sec, end_sec) while ``on`` holds: from the row that turns it on to the one that turns it
    off, or to the timeline's last row; stretches of no length are left out."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    marked = rows.withColumns({"_on": F.coalesce(on, F.lit(False)), "_end": F.max(at).over(Window.partitionBy(*keys))})
    turns = marked.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).where(F.col("_on") != F.col("_was"))
    turns = turns.withColumn("_next", F.lead(at).over(w))
    out = turns.where("_on").select(*keys, F.col(at).alias("start_sec"), F.coalesce("_next", "_end").alias("end_sec"))
    return out.where("end_sec > start_sec")


def first_run(rows: DataFrame, keys: list[str], at: str, order: list[str], present: Column, length: int, out: str = "run_start") -> DataFrame:
    """Rows that begin ``length`` consecutive rows without ``present``, as column ``out`` (their time, else null).

    Missing rows at the end make no run.
    """
    w = Window.partitionBy(*keys).orderBy(at, *order)
    away = rows.withColumn("_away", ~F.coalesce(present, F.lit(False)))
    run = F.col("_away")
    for i in range(1, length):
        run &= F.coalesce(F.lead("_away", i).over(w), F.lit(False))
    return away.withColumn(out, F.when(run, F.col(at))).drop("_away")


def next_strictly_greater(rows: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """``rows`` with the smallest later value of ``at`` in its key; rows that share a value get the same; null keys get null."""
    known = rows.select(*keys, at).distinct()
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    after = known.withColumn(out, F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))
    return rows.join(after, [*keys, at], "left")


def first_seen(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each ``by``, in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
