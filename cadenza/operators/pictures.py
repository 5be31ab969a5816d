"""Colours out of pictures: patch means at keys, and the samples of notes that sound.

A picture is a row: keys, frame_idx, time_sec, width, height and pixels, width x height x 3 bytes (red, green, blue) line by
line. Pictures are never copied for the notes that want them: notes are gathered by stretches of time, a row a stretch, and
each picture meets its own stretch's row once and answers all notes of it that are near enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import bucket

NO_COLOUR = (0.0, 0.0, 0.0)


def patch_means(pixels: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int = 3) -> np.ndarray:
    """Mean colours of squares around places, cut at the picture's borders; squares outside are black.

    ``pixels`` is height x width x 3. Places are rounded half to even. Sums of squares come from running sums along both
    sides, so a picture costs one pass whatever the number of places.
    """
    h, w = pixels.shape[:2]
    sums = np.zeros((h + 1, w + 1, 3), np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    xi, yi = np.rint(x).astype(np.int64), np.rint(y).astype(np.int64)
    x0, x1 = np.clip(xi - radius, 0, w), np.clip(xi + radius + 1, 0, w)
    y0, y1 = np.clip(yi - radius, 0, h), np.clip(yi + radius + 1, 0, h)
    n = (x1 - x0) * (y1 - y0)
    total = sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], 0.0)


def _stacked_means(stack: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """``patch_means`` of places (x, y) in the pictures ``of`` a stack (number x height x width x 3)."""
    n, h, w = stack.shape[:3]
    sums = np.zeros((n, h + 1, w + 1, 3), np.int64)
    np.cumsum(stack, axis=1, dtype=np.int64, out=sums[:, 1:, 1:])
    np.cumsum(sums[:, 1:, 1:], axis=2, out=sums[:, 1:, 1:])
    xi, yi = np.rint(x).astype(np.int64), np.rint(y).astype(np.int64)
    x0, x1 = np.clip(xi - radius, 0, w), np.clip(xi + radius + 1, 0, w)
    y0, y1 = np.clip(yi - radius, 0, h), np.clip(yi + radius + 1, 0, h)
    size = (x1 - x0) * (y1 - y0)
    total = sums[of, y1, x1] - sums[of, y0, x1] - sums[of, y1, x0] + sums[of, y0, x0]
    return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 0.0)


#: Bytes of pictures of one size whose sums are taken together, and places that are looked at together.
STACK, PLACES = 1 << 20, 1 << 18


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pictures with about ``PLACES`` places at a time."""
    offsets, first = np.asarray(batch.column(batch.schema.get_field_index("places")).offsets), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PLACES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _answered(radius: int, keep: list[str], give: list[str], span: tuple[str, float, float] | None = None):
    """Colours of the places (array of structs with x, y) beside each picture: ``keep`` of the picture, ``give`` of the
    place, r, g, b. With ``span`` (a place's time, before, after) only of places from whose time the picture's time_sec is
    at most so far."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            offsets = np.asarray(col["places"].offsets)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            places = col["places"].flatten()
            field = lambda n: places.field(places.type.get_field_index(n))  # noqa: B023, E731
            if span:
                at, start = np.asarray(col["time_sec"])[of], np.asarray(field(span[0]))
                near = np.nonzero((at >= start - span[1]) & (at <= start + span[2]))[0]
                of, places = of[near], places.take(pa.array(near))
            x, y = np.asarray(field("x")), np.asarray(field("y"))
            width, height = np.asarray(col["width"]), np.asarray(col["height"])
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            means, first = np.empty((len(of), 3)), 0
            while first < batch.num_rows:
                w, h = int(width[first]), int(height[first])
                size, last, held = w * h * 3, first, []
                while last < batch.num_rows and (width[last], height[last]) == (w, h) and (not held or (len(held) + 1) * size <= STACK):
                    data = col["pixels"][last].as_py()
                    if len(data) != size:
                        raise ValueError(f"a picture of {w} x {h} has {len(data)} bytes, not {size}")
                    held.append(data)
                    last += 1
                part = slice(ends[first], ends[last])
                if part.stop > part.start:
                    stack = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), h, w, 3)
                    means[part] = _stacked_means(stack, of[part] - first, x[part], y[part], radius)
                first = last
            taken = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(col[k].take(taken) for k in keep), *(field(n) for n in give), *(pa.array(means[:, c]) for c in range(3))], names=[*keep, *give, "r", "g", "b"])

    return go


def key_colours(rasters: DataFrame, asked: DataFrame, keys: list[str], radius: int = 3) -> DataFrame:
    """Colours (keys, frame_idx, pitch, r, g, b) of the keys that are ``asked`` (keys, frame_idx, pitch, x, y) of pictures.

    A key that is asked twice of a picture is answered once. Places without x or y, and pictures without pixels, have no
    answer. The places of a picture, at most one a key, are one array beside it.
    """
    at = [*keys, "frame_idx"]
    wanted = asked.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*at, "pitch").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    wanted = wanted.groupBy(*at).agg(F.collect_list(F.struct(F.col("pitch").cast("int").alias("pitch"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("places"))
    met = rasters.where("pixels IS NOT NULL").select(*at, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").join(wanted, at)
    kinds = ", ".join(f"{k} {rasters.schema[k].dataType.simpleString()}" for k in at)
    return met.mapInArrow(_answered(radius, at, ["pitch"]), f"{kinds}, pitch int, r double, g double, b double")


def strided(frames: DataFrame, source_fps: float, fps: float = 30.0) -> DataFrame:
    """Every so many frames, so that about ``fps`` a second are left."""
    step = max(1, round((source_fps if source_fps > 1 else fps) / fps))
    return frames.where(F.col("frame_idx") % step == 0)


def note_samples(rasters: DataFrame, notes: DataFrame, places: DataFrame, keys: list[str], before: float = 0.05, after: float = 4.0, radius: int = 3) -> DataFrame:
    """Colour samples (keys, note_idx, start_sec, time_sec, r, g, b) of notes' keys in the pictures from ``before`` their
    onsets to ``after`` them, both ends included.

    ``notes`` has keys, note_idx, pitch, start_sec; ``places`` keys, pitch, x, y. Notes whose key has no place, and those
    without a picture in time, have no samples. Null times meet nothing.
    """
    width = before + after
    x, y, pitch = F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("pitch").cast("int").alias("pitch")
    where = places.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, pitch).agg(F.first(F.struct(x, y)).alias("_p"))
    asked = notes.where("start_sec IS NOT NULL").select(*keys, "note_idx", pitch, "start_sec").join(where, [*keys, "pitch"])
    stretches = F.sequence(bucket(F.col("start_sec") - before, width), bucket(F.col("start_sec") + after, width))
    asked = asked.select(*keys, F.explode(stretches).alias("_stretch"), F.struct("note_idx", F.col("start_sec").cast("double").alias("start_sec"), "_p.x", "_p.y").alias("_n"))
    asked = asked.groupBy(*keys, "_stretch").agg(F.collect_list("_n").alias("places"))
    shown = rasters.where("pixels IS NOT NULL AND time_sec IS NOT NULL").select(*keys, F.col("time_sec").cast("double").alias("time_sec"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    met = shown.withColumn("_stretch", bucket(F.col("time_sec"), width)).join(asked, [*keys, "_stretch"])
    kinds = ", ".join(f"{k} {rasters.schema[k].dataType.simpleString()}" for k in keys)
    ident = notes.schema["note_idx"].dataType.simpleString()
    seen = met.mapInArrow(_answered(radius, [*keys, "time_sec"], ["note_idx", "start_sec"], ("start_sec", before, after)), f"{kinds}, time_sec double, note_idx {ident}, start_sec double, r double, g double, b double")
    return seen.select(*keys, "note_idx", "start_sec", "time_sec", "r", "g", "b")


def onset_colours(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each note's first sample of all, which may lie just before its onset: keys, note_idx, r, g, b."""
    first = samples.groupBy(*keys, "note_idx").agg(F.min(F.struct("time_sec", "r", "g", "b")).alias("f"))
    return first.select(*keys, "note_idx", "f.r", "f.g", "f.b")


# --- lines of pixels as spans


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dark_masks(lines: DataFrame, keys: list[str], dark: int = 90) -> DataFrame:
    """Lines (keys, y, grey: array of whole numbers) as their dark spans: keys, y, spans array<struct<start, end>>, ends
    exclusive. Where darkness changes is found inside the row, so no pixel becomes a row."""

    def spans(grey: Column) -> Column:
        is_dark = lambda i: F.coalesce(F.get(grey, i) < dark, F.lit(False))
        turns = F.filter(F.sequence(F.lit(0), F.size(grey)), lambda i: is_dark(i) != is_dark(i - 1))
        return _once(turns, lambda t: F.transform(F.filter(t, lambda _, i: i % 2 == 0), lambda a, i: F.struct(a.alias("start"), F.get(t, 2 * i + 1).alias("end"))))

    return lines.where("grey IS NOT NULL").select(*keys, "y", _once(F.col("grey"), spans).alias("spans"))


def span_overlap(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Lengths (by, both, either) of the intersection and the union of two sets of spans a row, by a sweep over their ends.

    Each set's own spans must not overlap. Rows where both sets are empty have no row.
    """
    edges = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.array(F.struct(s["start"].alias("x"), F.lit(1).alias("d")), F.struct(s["end"].alias("x"), F.lit(-1).alias("d")))))
    e = pairs.select(*by, F.explode(F.concat(edges(F.col(left)), edges(F.col(right)))).alias("e"))
    e = e.groupBy(*by, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("x")
    e = e.withColumns({"n": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("x").over(w)})
    length = lambda least: F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("to") - F.col("x"))), F.lit(0))
    return e.groupBy(*by).agg(length(2).alias("both"), length(1).alias("either"))


def stability(masks: DataFrame, keys: list[str], down: int = 15) -> DataFrame:
    """How far each line's dark mask is that of the line ``down`` below it: keys, y, iou (intersection over union); 0
    where there is no such line or nothing is dark.

    Spans take many times the room in memory that they take shuffled, by which Spark would choose to broadcast them; so
    lines are merged, here and below.
    """
    below = masks.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("y") - down).alias("_y"), F.col("spans").alias("_below"))
    on = F.col("y") == F.col("_y")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    pairs = masks.join(below.hint("merge"), on).select(*keys, "y", "spans", "_below")
    shared = span_overlap(pairs, [*keys, "y"], "spans", "_below").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("y").alias("_y"), (F.col("both") / F.col("either")).alias("_iou"))
    return masks.join(shared.hint("merge"), on, "left").select(*keys, "y", F.coalesce("_iou", F.lit(0.0)).alias("iou"))


def key_rows(lines: DataFrame, keys: list[str], width: int, height: int, dark: int = 90, down: int = 15, least: int = 15, uneven: float = 0.55) -> DataFrame:
    """The line of each picture that most likely crosses the black keys: keys, y, n (spans), cv, iou.

    Lines between 35 % and 95 % of the height with at least ``least`` dark spans of a key's width (a 300th to a 12th of the
    picture's) that are even enough; of these the most stable one, then the one with most spans, then the most even, then
    the highest. ``lines`` has keys, y, grey. Pictures without such a line have no row.
    """
    masks = dark_masks(lines, keys, dark)
    low, high = max(2, width // 300), width // 12
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def evenness(w: Column) -> Column:
        spread = lambda mean: F.sqrt(total(F.transform(w, lambda v: (v - mean) * (v - mean))) / F.size(w)) / mean
        return F.struct(F.size(w).alias("n"), _once(F.try_divide(total(w), F.size(w)), spread).alias("cv"))

    widths = F.transform(F.filter("spans", lambda s: (s["end"] - s["start"]).between(low, high)), lambda s: (s["end"] - s["start"]).cast("double"))
    m = masks.where(F.col("y").between(int(height * 0.35), int(height * 0.95) - 1)).select(*keys, "y", _once(widths, evenness).alias("e")).select(*keys, "y", "e.n", "e.cv")
    m = m.where((F.col("n") >= least) & (F.col("cv") <= uneven)).join(stability(masks, keys, down).hint("merge"), [*keys, "y"])
    best = m.groupBy(*keys).agg(F.min(F.struct((-F.col("iou")).alias("i"), (-F.col("n")).alias("m"), "cv", "y", "n", "iou")).alias("b"))
    return best.select(*keys, "b.y", "b.n", "b.cv", "b.iou")


def key_centres(lines: DataFrame, rows: DataFrame, keys: list[str], width: int, dark: int = 90) -> DataFrame:
    """Centres of the black keys on each picture's row (``key_rows``): keys, idx from 0, x, y."""
    low, high = max(2, width // 300), width // 12
    on = lines.join(rows.select(*keys, "y").hint("merge"), [*keys, "y"])
    spans = F.filter("spans", lambda s: (s["end"] - s["start"]).between(low, high))
    c = dark_masks(on, keys, dark).select(*keys, "y", F.posexplode(spans).alias("idx", "s"))
    return c.select(*keys, "idx", ((F.col("s.start") + F.col("s.end")) / 2.0).alias("x"), F.col("y").cast("double").alias("y"))
