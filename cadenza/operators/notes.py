"""Filters, trims and rates over notes, frames and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.music import playable_finger, snapped_edge
from .timeline import range_join

KEY = ["song_id"]


def audible(notes: DataFrame, velocity: int = 15, duration: float = 0.05) -> DataFrame:
    """Notes of enough velocity and duration."""
    return notes.where((F.col("velocity") >= velocity) & (F.col("duration_sec") >= duration))


def trimmed(notes: DataFrame, until: float, confidence: float) -> DataFrame:
    """Notes up to a time, of enough confidence, with wrist and palm matches as null fingers."""
    kept = notes.where((F.col("start_sec") <= until) & (F.col("confidence") >= confidence))
    return kept.withColumn("finger", playable_finger(F.col("finger")))


def trimmed_duration(duration: Column, lit: Column, least: float = 0.05) -> Column:
    """A duration cut to how long its key was lit; unknown and too short cuts leave it as it is."""
    cut = F.least(duration, lit)
    return F.when(lit.isNull() | (cut < least), duration).otherwise(cut)


def first_manual(sources: DataFrame, channel: str = "channel", order: str = "pos", saved: str = "saved") -> DataFrame:
    """Sources with ``plan``: the first one of a channel without stored settings is manual, all others reuse."""
    w = Window.partitionBy(channel)
    first = ~F.bool_or(saved).over(w) & (F.row_number().over(w.orderBy(order)) == 1)
    return sources.withColumn("plan", F.when(first, "manual").otherwise("reuse"))


def outcomes(results: DataFrame, ok: str = "ok") -> DataFrame:
    """How many runs went well and how many failed; a null outcome is a failure."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return results.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def dual_hand_rate(frames: DataFrame, points: DataFrame) -> DataFrame:
    """Share of frames, also empty ones, that show both hands: song_id, rate."""
    p = points.groupBy(*KEY, "frame_idx").agg((F.countDistinct("hand") == 2).alias("both"))
    f = frames.join(p, [*KEY, "frame_idx"], "left")
    return f.groupBy(*KEY).agg(F.coalesce(F.avg(F.coalesce("both", F.lit(False)).cast("int")), F.lit(0.0)).alias("rate"))


def hand_spread(points: DataFrame, close: float = 3) -> DataFrame:
    """How far apart the hands of frames with both are: song_id, n, mean, median, close (share nearer than that)."""
    side = lambda h: F.avg(F.when(F.col("hand") == h, F.col("wi")))
    s = points.groupBy(*KEY, "frame_idx").agg(side("L").alias("l"), side("R").alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    s = s.select(*KEY, F.abs(F.col("l") - F.col("r")).alias("d"))
    return s.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg((F.col("d") < close).cast("int")).alias("close"))


def recovery_targets(frames: DataFrame, points: DataFrame, notes: DataFrame, cover: float = 5, slack: float = 0.03, most: int | None = None) -> DataFrame:
    """Frames with fewer than two hands where notes sound that no tracked palm covers: song_id, frame_idx, x_min, x_max
    (their white keys) and had_label, the one hand that was seen. With ``most`` the first so many frames of a song."""
    seen = points.groupBy(*KEY, "frame_idx").agg(F.countDistinct("hand").alias("hands"), F.min("hand").alias("label"))
    h = frames.select(*KEY, "frame_idx", "time_sec").join(seen, [*KEY, "frame_idx"], "left")
    h = h.withColumn("hands", F.coalesce("hands", F.lit(0))).where("hands < 2")
    n = notes.select(*KEY, "note_idx", F.col("wi").alias("nwi"), (F.col("start_sec") - slack).alias("lo"), (F.col("start_sec") + F.col("duration_sec") + slack).alias("hi"))
    due = range_join(h, n, KEY, "time_sec", "lo", "hi", 1.0)
    own = points.where("finger = 6").select(*(F.col(c).alias(f"_{c}") for c in (*KEY, "frame_idx", "wi")))
    on = (F.col("song_id") == F.col("_song_id")) & (F.col("frame_idx") == F.col("_frame_idx")) & (F.abs(F.col("_wi") - F.col("nwi")) <= cover)
    out = due.join(own, on, "left_anti").groupBy(*KEY, "frame_idx")
    out = out.agg(F.min("nwi").alias("x_min"), F.max("nwi").alias("x_max"), F.when(F.max("hands") == 1, F.max("label")).alias("had_label"))
    if most is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("frame_idx"))).where(F.col("_n") <= most).drop("_n")


def recovery_crops(targets: DataFrame, to_x, width: int, top: int, bottom: int, key_width: float, margin_keys: float = 4.0) -> DataFrame:
    """Where to look again: targets (song_id, frame_idx, x_min, x_max in white keys) with the crop's cx1, cx2, cy1, cy2.

    ``to_x`` turns white keys into screen positions; the crop is the band from ``top`` to ``bottom`` around them, wider by
    four keys and by 60 pixels at least. Crops of less than 20 pixels either way are left out.
    """
    margin = max(60.0, margin_keys * key_width)
    a, b = to_x(F.col("x_min")), to_x(F.col("x_max"))
    out = targets.withColumns({
        "cx1": F.greatest(F.lit(0), (F.least(a, b) - margin).cast("int")), "cx2": F.least(F.lit(width), (F.greatest(a, b) + margin).cast("int")), "cy1": F.lit(top), "cy2": F.lit(bottom)})
    return out.where("cx2 - cx1 >= 20 AND cy2 - cy1 >= 20")


def recovery_counts(targets: DataFrame, looked: DataFrame, merged: DataFrame, tracked: DataFrame) -> DataFrame:
    """What a second look came to, a row a song that had targets: problem_frames (``targets``), reran (``looked``),
    hands_recovered (``merged``) and frames_now_dual: frames looked at that show both hands with the new ones."""
    k = [*KEY, "frame_idx"]
    n = lambda d, name: d.groupBy(*KEY).agg(F.count("*").alias(name))
    hands = tracked.select(*k, "hand").unionByName(merged.select(*k, "hand")).groupBy(*k).agg(F.count("*").alias("_n")).where("_n >= 2")
    again = looked.select(*k).distinct()
    out = n(targets.select(*k).distinct(), "problem_frames").join(n(again, "reran"), KEY, "left").join(n(merged.join(again, k, "left_semi"), "hands_recovered"), KEY, "left")
    return out.join(n(again.join(hands, k, "left_semi"), "frames_now_dual"), KEY, "left").fillna(0)


def without_neighbours(recovered: DataFrame, tracked: DataFrame, reach: float) -> DataFrame:
    """Recovered hands (song_id, frame_idx, x) that no tracked hand of their frame is within ``reach`` of."""
    own = tracked.select(*(F.col(c).alias(f"_{c}") for c in (*KEY, "frame_idx", "x")))
    on = (F.col("song_id") == F.col("_song_id")) & (F.col("frame_idx") == F.col("_frame_idx")) & (F.abs(F.col("x") - F.col("_x")) < reach)
    return recovered.join(own, on, "left_anti")


def merged_recoveries(recovered: DataFrame, tracked: DataFrame, reach: float = 60.0) -> DataFrame:
    """Hands that a second look found (song_id, frame_idx, pos, hand, x) and the first (song_id, frame_idx, hand, x) lacks.

    In order of ``pos`` a hand within ``reach`` of a tracked one, or of one taken before, is the same hand. The first one
    taken where exactly one hand is tracked is that one's other hand, whatever its label says; later ones keep theirs.
    """
    far = without_neighbours(recovered.where("x IS NOT NULL"), tracked, reach)
    found = far.groupBy(*KEY, "frame_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "hand", "x"))).alias("_all"))
    same = lambda taken, r: F.exists(taken, lambda t: F.abs(t["x"] - r["x"]) < reach)
    taken = F.aggregate("_all", F.slice("_all", 1, 0), lambda t, r: F.when(same(t, r), t).otherwise(F.concat(t, F.array(r))))
    own = tracked.groupBy(*KEY, "frame_idx").agg(F.count("*").alias("_n"), F.min("hand").alias("_label"))
    out = found.join(own, [*KEY, "frame_idx"], "left").select(*KEY, "frame_idx", "_n", "_label", F.posexplode(taken).alias("_i", "r"))
    other = F.when(F.col("_label") == "L", "R").otherwise("L")
    hand = F.when((F.col("_i") == 0) & (F.col("_n") == 1), other).otherwise(F.col("r.hand"))
    return out.select(*KEY, "frame_idx", "r.pos", hand.alias("hand"), "r.x")


def added_hands(coarse: DataFrame, tracked: DataFrame, reach: float = 80.0) -> DataFrame:
    """At most one hand a frame (song_id, frame_idx, hand, x) of coarse ones (lx, rx): the left, else the right one, that
    no tracked hand is within ``reach`` of."""
    both = F.array(F.struct(F.lit("L").alias("hand"), F.col("lx").alias("x")), F.struct(F.lit("R").alias("hand"), F.col("rx").alias("x")))
    c = coarse.select(*KEY, "frame_idx", F.explode(both).alias("c")).select(*KEY, "frame_idx", "c.hand", "c.x").where("x IS NOT NULL")
    one = without_neighbours(c, tracked, reach).groupBy(*KEY, "frame_idx").agg(F.min(F.struct("hand", "x")).alias("c"))
    return one.select(*KEY, "frame_idx", "c.hand", "c.x")


def octave_shift(anchors: DataFrame, low: int, high: int, least: int = 10) -> DataFrame:
    """The octaves by which a calibration of the keys ``low`` to ``high`` is off, judged by anchors (low_anchor,
    high_anchor, n) of at least so many notes: adds snapped_low, snapped_high, shift (12 or 24 up or down, else 0)."""
    a = anchors.withColumns({"snapped_low": snapped_edge(F.col("low_anchor")), "snapped_high": snapped_edge(F.col("high_anchor"))})
    down, up = F.col("snapped_low") - low, F.col("snapped_high") - high
    return a.withColumn("shift", F.when((F.col("n") >= least) & (down == up) & F.abs(down).isin(12, 24), down).otherwise(0))


def even_samples(samples: DataFrame, keys: list[str], at: str, wanted: int = 8) -> DataFrame:
    """At most so many samples of each key, spread evenly over its times from the first to the last."""
    w = Window.partitionBy(*keys)
    s = samples.withColumns({"_i": F.row_number().over(w.orderBy(at)) - 1, "_n": F.count("*").over(w)})
    step = (F.col("_n") - 1) / (wanted - 1)
    near = F.rint(F.rint(F.col("_i") / step) * step)
    return s.where((F.col("_n") <= wanted) | (F.col("_i") == near)).drop("_i", "_n")


def key_baselines(samples: DataFrame, pitches: DataFrame | None = None, unknown: float = 128.0) -> DataFrame:
    """Median colour of each key (pitch, r, g, b); listed pitches without samples are of the ``unknown`` grey."""
    base = samples.groupBy("pitch").agg(*(F.median(c).alias(c) for c in "rgb"))
    if pitches is None:
        return base
    every = pitches.select("pitch").distinct().join(base, "pitch", "left")
    return every.select("pitch", *(F.coalesce(c, F.lit(unknown)).alias(c) for c in "rgb"))


def lit_end(samples: DataFrame, baselines: DataFrame, threshold: float = 40.0, dark: int = 3) -> DataFrame:
    """When notes' keys go dark: song_id, note_idx, lit_end, the start of the first ``dark`` samples in a row that aren't
    lit after the first lit one at or after the onset; null if there is none.

    ``samples`` has song_id, note_idx, pitch, start_sec, time_sec, r, g, b; ``baselines`` the keys' unlit colours.
    """
    from .timeline import first_run

    base = baselines.select("pitch", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    s = samples.join(base, "pitch").withColumn("lit", colour.is_lit([F.col(c) for c in "rgb"], [F.col(f"_{c}") for c in "rgb"], threshold))
    w = Window.partitionBy(*KEY, "note_idx").orderBy("time_sec").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("seen", F.bool_or(F.col("lit") & (F.col("time_sec") >= F.col("start_sec"))).over(w))
    s = first_run(s, [*KEY, "note_idx"], "time_sec", [], F.col("lit"), dark)
    return s.groupBy(*KEY, "note_idx").agg(F.min(F.when(F.col("seen"), F.col("run_start"))).alias("lit_end"))
