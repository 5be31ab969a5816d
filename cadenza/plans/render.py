"""The analysis of rendered videos, whose keys light up in their hands' colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import nearest_reference
from ..operators import notes as N
from ..operators import pictures, signal

KEY = ["song_id"]
#: A key that was never sampled counts as this grey.
UNKNOWN_KEY = 200.0


def analyse_render(notes: DataFrame, samples: DataFrame, baselines: DataFrame, references: dict[str, tuple[float, float, float]] | None = None, flip: bool = False, threshold: float = 40.0) -> DataFrame:
    """Hand and confidence by colour, and durations cut where keys go dark, for every note.

    ``notes``: song_id, note_idx, onset_tick, pitch, start_sec, duration_sec. ``samples``: song_id, note_idx, time_sec, r,
    g, b at the note's key, which may begin just before its onset: the first sample of all is its colour. ``baselines``: pitch, r, g, b of unlit keys. With ``references``, picked colours, a note gets
    the nearest one's hand, else two clusters of a song's hues tell. Notes without a colour get the first reference's
    hand, or else by pitch, at confidence 0. ``trimmed_sec`` is null where the duration stays.
    """
    n = notes.select(*KEY, "note_idx", "onset_tick", "pitch", "start_sec", "duration_sec")
    s = samples.select(*KEY, "note_idx", "time_sec", "r", "g", "b").join(n.select(*KEY, "note_idx", "pitch", "start_sec"), [*KEY, "note_idx"])
    coloured = n.join(pictures.onset_colours(s, KEY), [*KEY, "note_idx"], "left")
    if references is not None:
        hand, sure = nearest_reference([F.col(c) for c in "rgb"], references, flip)
        hands = coloured.select(*KEY, "note_idx", hand.alias("hand"), sure.alias("confidence"))
    else:
        got = signal.assigned_hands(coloured.where("r IS NOT NULL"), KEY, "note_idx", flip=flip)
        hands = n.join(got.select(*KEY, "note_idx", "hand", "confidence"), [*KEY, "note_idx"], "left")
        hands = hands.select(*KEY, "note_idx", F.coalesce("hand", F.when(F.col("pitch") < 60, "L").otherwise("R")).alias("hand"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    base = n.select("pitch").distinct().join(baselines.select("pitch", "r", "g", "b"), "pitch", "left")
    base = base.select("pitch", *(F.coalesce(c, F.lit(UNKNOWN_KEY)).alias(c) for c in "rgb"))
    dark = N.lit_end(s, base, threshold)
    out = n.join(hands, [*KEY, "note_idx"]).join(dark, [*KEY, "note_idx"], "left")
    cut = N.trimmed_duration(F.col("duration_sec"), F.col("lit_end") - F.col("start_sec"))
    return out.select(*KEY, "note_idx", "onset_tick", "pitch", "hand", F.round("confidence", 4).alias("confidence"), "start_sec", cut.alias("duration_sec"), F.when(cut != F.col("duration_sec"), F.round(cut, 4)).alias("trimmed_sec"))


def trims(rendered: DataFrame, path: str = "song_id") -> DataFrame:
    """The shortened notes as ``sources.midi.with_trims`` takes them: path, onset_tick, pitch, duration_sec. Of notes
    that start together on a key the last one counts."""
    last = F.row_number().over(Window.partitionBy(path, "onset_tick", "pitch").orderBy(F.desc("note_idx")))
    t = rendered.where("trimmed_sec IS NOT NULL").withColumn("_last", last).where("_last = 1")
    return t.select(F.col(path).alias("path"), "onset_tick", "pitch", "duration_sec")
