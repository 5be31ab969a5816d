"""Registered queries of what reads and writes files, rasters, landmarks, spans, streams, sketches and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calibration, text
from ..functions import tables as sql_tables
from ..operators import landmarks, pictures, signal, sketches
from ..operators import notes as N
from ..sources import midi, midi_source
from ..sources.store import KeyedStore
from ..sources.shared import SharedTables, written_once
from . import analogue as A
from ..streaming import joins
from . import catalogue2, files, render  # noqa: F401  (its queries come first)
from .catalogue import _REFS, ORACLE, QUERIES, K, _d, query, read  # noqa: F401


# --- MIDI folders, written and read back


def _song_events(spark, d):
    """The notes and pedal of all songs, written as MIDI files to the shared folder, and the events of these files."""
    midi_source.register(spark)
    tables = SharedTables(spark, "midi")
    n = A.notes(spark, d).withColumn("path", F.concat("song_id", F.lit(".mid")))
    notes = n.select("path", "onset_tick", (F.col("onset_tick") + F.round(F.col("duration_sec") * 960).cast("long")).alias("off_tick"), "pitch", "velocity", "channel")
    pedal = n.select("path", F.col("onset_tick").alias("tick"), "channel", F.lit(64).alias("controller"), ((F.col("event_id") * 31) % 128).cast("int").alias("value"))
    folder = f"{tables.root}/songs"
    with written_once(spark):
        midi.files_of(midi.events_of_notes(notes, pedal)).write.format("midi").mode("append").save(folder)
    return spark.read.format("midi").load(folder), F.regexp_extract("path", r"([^/]*)\.mid$", 1).alias("song_id"), tables


_TICKS = """, n AS (SELECT song_id, onset_tick, onset_tick + round(duration_sec * 960)::BIGINT AS off_tick, pitch, velocity, event_id * 31 % 128 AS pedal FROM notes)"""


@query(A.with_tables("notes") + _TICKS + """,
    o AS (SELECT *, row_number() OVER (PARTITION BY song_id, pitch ORDER BY onset_tick, velocity) AS k FROM n),
    f AS (SELECT song_id, pitch, off_tick, row_number() OVER (PARTITION BY song_id, pitch ORDER BY off_tick) AS k FROM n),
    p AS (SELECT o.song_id, o.onset_tick, o.pitch, o.velocity, f.off_tick FROM o JOIN f USING (song_id, pitch, k))
    SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY onset_tick, pitch, off_tick) - 1 AS note_idx, onset_tick, pitch, onset_tick / 960e0 AS start_sec, (off_tick - onset_tick) / 960e0 AS duration_sec FROM p""")
def midi_notes_written(spark, d):
    """Notes as they come back from MIDI files that were written from them: ons and offs meet in order."""
    events, song, tables = _song_events(spark, d)
    kept = tables.write(events.where("kind IN ('file', 'on', 'off', 'tempo')"))
    return midi.read_notes(kept).select(song, (F.col("note_idx")).cast("long").alias("note_idx"), "onset_tick", "pitch", "start_sec", "duration_sec")


@query(A.with_tables("notes") + _TICKS + """,
    e AS (SELECT song_id, max(greatest(onset_tick, off_tick)) AS last FROM n GROUP BY song_id),
    m AS (SELECT *, pedal >= 64 AS down, coalesce(lag(pedal >= 64) OVER w, false) AS was FROM n WINDOW w AS (PARTITION BY song_id ORDER BY onset_tick, pedal)),
    t AS (SELECT *, lead(onset_tick) OVER (PARTITION BY song_id ORDER BY onset_tick, pedal) AS nxt FROM m WHERE down <> was)
    SELECT song_id, onset_tick / 960e0 AS start_sec, coalesce(nxt, last) / 960e0 AS end_sec FROM t JOIN e USING (song_id) WHERE down AND coalesce(nxt, last) > onset_tick""")
def midi_pedal_written(spark, d):
    """Stretches of pedal as they come back from MIDI files."""
    events, song, tables = _song_events(spark, d)
    return midi.pedal_segments(tables.write(events)).select(song, "start_sec", "end_sec")


# --- colours out of pictures


#: Pixel c of place (x, y) of a frame is (7 event_id + 13 x + 29 y + 53 c) mod 256.
_WIDE, _HIGH = 16, 6


def _rasters(spark, d):
    n = _WIDE * _HIGH * 3
    value = lambda i: (F.col("_shade") + F.floor(i / 3) % _WIDE * 13 + F.floor(i / (3 * _WIDE)) * 29 + i % 3 * 53) % 256
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), "")
    # frames differ by their events' shades alone, so each of the 256 pictures is painted once
    painted = spark.range(256).withColumnRenamed("id", "_shade").select("_shade", F.unhex(text).alias("pixels"))
    f = A.frames(spark, d).withColumn("_shade", F.col("event_id") * 7 % 256).join(F.broadcast(painted), "_shade")
    return f.select(*K, "frame_idx", "time_sec", F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"), "pixels")


def _samples(spark, d):
    n = A.notes(spark, d)
    places = n.select(*K, "pitch").distinct().select(*K, "pitch", ((F.col("pitch") % 23) - 2.5).alias("x"), ((F.col("pitch") % 9) - 1.0).alias("y"))
    return pictures.note_samples(_rasters(spark, d), n.select(*K, "note_idx", "pitch", "start_sec"), places, K)


_PATCH = f"""met AS (SELECT n.song_id, n.note_idx, n.pitch, n.start_sec, f.time_sec, f.event_id FROM notes n JOIN frames f ON f.song_id = n.song_id AND f.time_sec BETWEEN n.start_sec - 5e-2 AND n.start_sec + 4e0),
    box AS (SELECT p AS pitch, greatest(0, round_even(p % 23 - 2.5e0, 0)::BIGINT - 3) AS x0, least({_WIDE}, round_even(p % 23 - 2.5e0, 0)::BIGINT + 4) AS x1,
        greatest(0, p % 9 - 1 - 3) AS y0, least({_HIGH}, p % 9 - 1 + 4) AS y1 FROM (SELECT DISTINCT pitch AS p FROM notes)),
    shade AS (SELECT e, pitch, avg((7 * e + 13 * x + 29 * y) % 256) AS r, avg((7 * e + 13 * x + 29 * y + 53) % 256) AS g, avg((7 * e + 13 * x + 29 * y + 106) % 256) AS b
        FROM (SELECT unnest(range(256)) AS e), box, (SELECT unnest(range({_WIDE})) AS x), (SELECT unnest(range({_HIGH})) AS y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY e, pitch),
    sampled AS (SELECT song_id, note_idx, start_sec, time_sec, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM met LEFT JOIN shade ON shade.e = met.event_id % 256 AND shade.pitch = met.pitch)"""


@query(A.with_tables("notes", "frames") + "," + _PATCH + """
    SELECT song_id, note_idx, count(*) AS n, min(time_sec) - any_value(start_sec) AS first_at, max(time_sec) - any_value(start_sec) AS last_at, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM sampled GROUP BY song_id, note_idx""")
def picture_samples(spark, d):
    """What each note's key shows in the pictures from just before its onset to four seconds later."""
    s = _samples(spark, d)
    return s.groupBy(*K, "note_idx").agg(F.count("*").alias("n"), (F.min("time_sec") - F.first("start_sec")).alias("first_at"), (F.max("time_sec") - F.first("start_sec")).alias("last_at"), F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b"))


@query(A.with_tables("notes", "frames") + "," + _PATCH + """, o AS (SELECT *, row_number() OVER (PARTITION BY song_id, note_idx ORDER BY time_sec, r, g, b) AS k FROM sampled) SELECT song_id, note_idx, r, g, b FROM o WHERE k = 1""")
def picture_onsets(spark, d):
    """Each note's first sample of all."""
    return pictures.onset_colours(_samples(spark, d), K)


# --- landmarks


def _nested(spark, d):
    """Frames with hands as a tracker lists them: 21 landmarks each, of every seventh hand the first nine only."""
    f = A.frames(spark, d)
    mark = lambda s: lambda i: F.struct((((F.col("event_id") * s + i * 31) % 1000) / F.lit(1000.0)).alias("x"), (((F.col("event_id") * (s + 2) + i * 17) % 1000) / F.lit(1000.0)).alias("y"))
    marks = lambda s: F.transform(F.sequence(F.lit(0), F.when(F.col("event_id") % 7 == s % 7, 8).otherwise(20)), mark(s))
    hand = lambda label, s: F.struct(F.lit(label).alias("label"), marks(s).alias("landmarks"))
    hands = F.when(F.col("event_id") % 4 == 0, F.array().cast(landmarks.HANDS)).when(F.col("event_id") % 4 == 1, F.array(hand("Left", 3))).otherwise(F.array(hand("Right", 5), hand("Left", 11)))
    crop = {"cx": F.lit(40.0), "cy": F.lit(20.0), "cw": (600 + F.col("event_id") % 3).cast("double"), "ch": F.lit(300.0)}
    return f.select(*K, "frame_idx", "time_sec", hands.alias("hands"), *(c.alias(n) for n, c in crop.items()))


_MARKS = """, h AS (SELECT f.*, v.pos, v.label, v.s, 600 + event_id % 3 AS cw FROM frames f, (VALUES (1, 0, 'Left', 3), (2, 0, 'Right', 5), (2, 1, 'Left', 11), (3, 0, 'Right', 5), (3, 1, 'Left', 11)) v(k, pos, label, s) WHERE event_id % 4 = v.k),
    m AS (SELECT h.*, i, 40 + (event_id * s + i * 31) % 1000 / 1e3 * cw AS x, 20 + (event_id * (s + 2) + i * 17) % 1000 / 1e3 * 300 AS y FROM h, (SELECT unnest(range(21)) AS i) WHERE i <= CASE WHEN event_id % 7 = s % 7 THEN 8 ELSE 20 END),
    p AS (SELECT song_id, frame_idx, time_sec, pos, CASE WHEN label = 'Left' THEN 'L' ELSE 'R' END AS hand, CASE i WHEN 0 THEN 0 ELSE i // 4 END AS finger, x, y FROM m WHERE i IN (0, 4, 8, 12, 16, 20)
        UNION ALL SELECT song_id, frame_idx, time_sec, pos, CASE WHEN label = 'Left' THEN 'L' ELSE 'R' END, 6, avg(x), avg(y) FROM m WHERE i IN (5, 9, 13, 17) GROUP BY song_id, frame_idx, time_sec, pos, label HAVING count(*) = 4)"""


@query(A.with_tables("notes", "frames") + _MARKS + " SELECT * FROM p")
def landmark_points(spark, d):
    """Nested landmarks as points in the picture."""
    return landmarks.points(_nested(spark, d), K)


@query(A.with_tables("notes", "frames") + _MARKS + """ SELECT song_id, frame_idx, pos, hand, coalesce(max(x) FILTER (finger = 6), max(x) FILTER (finger = 0), avg(x) FILTER (finger BETWEEN 1 AND 5)) AS x,
    coalesce(max(y) FILTER (finger = 6), max(y) FILTER (finger = 0), avg(y) FILTER (finger BETWEEN 1 AND 5)) AS y FROM p WHERE finger <> 0 OR frame_idx % 2 = 0 GROUP BY song_id, frame_idx, pos, hand""")
def landmark_hands(spark, d):
    """Where hands are: palm, else wrist, else the tips' mean (every other frame here has lost its wrists)."""
    return landmarks.hand_places(landmarks.points(_nested(spark, d), K).where("finger <> 0 OR frame_idx % 2 = 0"), K)


# --- lines of pixels


#: A picture a song; what is dark in it depends on how many events the song has.
_LINE, _LINES = 240, 60


def _lines(spark, d):
    n = A.events(spark, d).groupBy(F.concat(F.lit("s"), F.expr("user_id DIV 4").cast("string")).alias("song_id")).agg(F.count("*").cast("int").alias("n"))
    y = n.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(_LINES - 1))))
    step, wide = 9 + (F.col("y") + F.col("n")) % 4, 3 + F.col("n") % 4
    grey = F.transform(F.sequence(F.lit(0), F.lit(_LINE - 1)), lambda x: F.when((x + F.col("y") * (F.col("n") % 3)) % step < wide + F.floor(x / 60) % 2, 30 + F.col("n") % 50).otherwise(90 + x % 100))
    return y.select(*K, "y", grey.alias("grey"))


_ROWS = f"""WITH s AS (SELECT 's' || (user_id // 4)::VARCHAR AS song_id, count(*) AS n FROM events GROUP BY user_id // 4),
    px AS (SELECT song_id, y, x, (x + y * (n % 3)) % (9 + (y + n) % 4) < 3 + n % 4 + x // 60 % 2 AS dark FROM s, (SELECT unnest(range({_LINES})) AS y), (SELECT unnest(range({_LINE})) AS x)),
    d AS (SELECT *, x - row_number() OVER (PARTITION BY song_id, y ORDER BY x) AS run FROM px WHERE dark),
    sp AS (SELECT song_id, y, min(x) AS a, max(x) + 1 AS b FROM d GROUP BY song_id, y, run),
    ok AS (SELECT * FROM sp WHERE b - a BETWEEN 2 AND {_LINE // 12} AND y >= {int(_LINES * 0.35)} AND y < {int(_LINES * 0.95)}),
    c AS (SELECT song_id, y, count(*) AS n, stddev_pop(b - a) / avg(b - a) AS cv FROM ok GROUP BY song_id, y HAVING count(*) >= 15 AND stddev_pop(b - a) / avg(b - a) <= 0.55e0),
    i AS (SELECT a.song_id, a.y, sum((a.dark AND b.dark)::INT) / sum((a.dark OR b.dark)::INT) AS iou FROM px a JOIN px b ON a.song_id = b.song_id AND a.x = b.x AND b.y = a.y + 15 GROUP BY a.song_id, a.y),
    r AS (SELECT c.*, coalesce(i.iou, 0) AS iou FROM c LEFT JOIN i USING (song_id, y)),
    best AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(iou, 12) DESC, n DESC, round(cv, 12), y) AS k FROM r)"""


@query(_ROWS + " SELECT song_id, y, n, cv, iou FROM best WHERE k = 1")
def black_key_rows(spark, d):
    """The line of each picture that crosses the black keys, by spans alone."""
    return pictures.key_rows(_lines(spark, d), K, _LINE, _LINES)


@query(_ROWS + " SELECT ok.song_id, row_number() OVER (PARTITION BY ok.song_id ORDER BY a) - 1 AS idx, (a + b) / 2e0 AS x, ok.y::DOUBLE AS y FROM ok JOIN best ON best.song_id = ok.song_id AND best.y = ok.y AND k = 1")
def black_key_centres(spark, d):
    """Centres of the black keys on these lines."""
    lines = _lines(spark, d)
    return pictures.key_centres(lines, pictures.key_rows(lines, K, _LINE, _LINES), K, _LINE)


# --- two means, by rounds


_HUES = """, s AS (SELECT s.song_id, s.note_idx, n.pitch, r, g, b, atan2((g - b) * sqrt(3e0) / 2, r - (g + b) / 2) AS a FROM samples s JOIN notes n ON n.song_id = s.song_id AND n.note_idx = s.note_idx WHERE s.time_sec = s.start_sec),
    v AS MATERIALIZED (SELECT *, cos(a) AS x, sin(a) AS y FROM s),
    f AS (SELECT song_id, arg_min(x, note_idx) AS x0, arg_min(y, note_idx) AS y0 FROM v GROUP BY song_id),
    o AS (SELECT v.song_id, x0, y0, x, y, row_number() OVER (PARTITION BY v.song_id ORDER BY (x - x0) ** 2 + (y - y0) ** 2 DESC, note_idx) AS k FROM v JOIN f USING (song_id)),
    c0 AS MATERIALIZED (SELECT song_id, x0, y0, x AS x1, y AS y1 FROM o WHERE k = 1)"""
_NEARER = "sqrt((x - x1) ** 2 + (y - y1) ** 2) < sqrt((x - x0) ** 2 + (y - y0) ** 2)"
for _i in range(1, 21):
    _HUES += f""",
    c{_i} AS MATERIALIZED (SELECT v.song_id, coalesce(avg(x) FILTER (NOT ({_NEARER})), any_value(x0)) AS x0, coalesce(avg(y) FILTER (NOT ({_NEARER})), any_value(y0)) AS y0,
        coalesce(avg(x) FILTER ({_NEARER}), any_value(x1)) AS x1, coalesce(avg(y) FILTER ({_NEARER}), any_value(y1)) AS y1 FROM v JOIN c{_i - 1} USING (song_id) GROUP BY v.song_id)"""
_HUES += f""",
    k AS (SELECT v.*, CASE WHEN {_NEARER} THEN 1 ELSE 0 END AS cluster, sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) AS separation FROM v JOIN c20 USING (song_id)),
    m AS (SELECT song_id, coalesce(avg(pitch) FILTER (cluster = 0), 'inf'::DOUBLE) <= coalesce(avg(pitch) FILTER (cluster = 1), 'inf'::DOUBLE) AS low0 FROM k GROUP BY song_id)"""
ORACLE["colour_clusters"] = A.with_tables("notes", "samples") + _HUES + " SELECT k.song_id, note_idx, cluster, separation, CASE WHEN (cluster = 0) = low0 THEN 'L' ELSE 'R' END AS hand FROM k JOIN m USING (song_id)"


@query(A.with_tables("notes", "samples") + _HUES + """, w AS (SELECT song_id, avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END) AS sat, median(pitch) AS mid FROM v GROUP BY song_id),
    j AS (SELECT k.*, low0, mid, sat < 0.3e0 OR NOT separation >= 0.5e0 AS degenerate FROM k JOIN m USING (song_id) JOIN w USING (song_id))
    SELECT song_id, note_idx, degenerate, CASE WHEN degenerate THEN CASE WHEN mid < 60 THEN 'L' ELSE 'R' END WHEN (cluster = 0) = low0 THEN 'L' ELSE 'R' END AS hand,
        CASE WHEN degenerate THEN 0 ELSE separation / (separation + 0.5e0) END AS confidence FROM j""")
def hands_by_colour(spark, d):
    """Each note's hand from its colour, with the fallback of songs whose colours tell nothing."""
    s = A.samples(spark, d).where("time_sec = start_sec").join(A.notes(spark, d).select(*K, "note_idx", "pitch"), [*K, "note_idx"])
    return signal.assigned_hands(s.select(*K, "note_idx", "pitch", "r", "g", "b"), K, "note_idx", grey=0.3).select(*K, "note_idx", "degenerate", "hand", "confidence")


# --- streams


def _ran(out, tables, name):
    """A stream's rows, after it has read what there is."""
    q = out.writeStream.format("parquet").option("path", f"{tables.root}/{name}").option("checkpointLocation", f"{tables.root}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return tables.spark.read.schema(out.schema).parquet(f"{tables.root}/{name}")


def _streamed(spark, d):
    """Notes and frames with points as streams; each ends with a row far ahead, which lets the watermarks pass all others.

    Songs begin in 2000: a watermark begins at 1970, and rows at that moment or before it would be late.
    """
    tables = SharedTables(spark, "streams")
    at = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long") + 946_684_800_000_000)
    n = A.notes(spark, d).select("song_id", "note_idx", "pitch", at("start_sec").alias("on_at"), (at("start_sec") + F.make_dt_interval(secs=F.col("duration_sec").cast("decimal(18,6)"))).alias("off_at"))
    f = A.points(spark, d).select("song_id", "frame_idx", at("time_sec").alias("at")).distinct()
    far = F.lit("2030-01-01 00:00:00").cast("timestamp")
    one = spark.range(1)
    n = n.unionByName(one.select(F.lit("~").alias("song_id"), F.lit(None).cast("long").alias("note_idx"), F.lit(None).cast("int").alias("pitch"), far.alias("on_at"), far.alias("off_at")))
    f = f.unionByName(one.select(F.lit("~~").alias("song_id"), F.lit(None).cast("long").alias("frame_idx"), far.alias("at")))
    notes, frames = tables.write(n, "notes"), tables.write(f, "frames")
    stream = lambda df, name: spark.readStream.schema(df.schema).parquet(f"{tables.root}/{name}")
    return stream(notes, "notes"), stream(frames, "frames"), tables


_MICROS = """, n AS (SELECT song_id, note_idx, pitch, round(start_sec * 1e6)::BIGINT AS lo, round(start_sec * 1e6)::BIGINT + round(duration_sec * 1e6)::BIGINT AS hi FROM notes),
    f AS (SELECT DISTINCT song_id, frame_idx, round(time_sec * 1e6)::BIGINT AS t FROM points)"""


@query(A.with_tables("notes", "frames", "points") + _MICROS + " SELECT f.song_id, frame_idx, count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM f JOIN n ON n.song_id = f.song_id AND t BETWEEN lo AND hi GROUP BY ALL")
def streamed_sounding(spark, d):
    """What sounds at each frame, from a join of two streams."""
    notes, frames, tables = _streamed(spark, d)
    met = _ran(joins.streamed_range_join(frames, notes, K, "at", "on_at", "off_at", "2 SECONDS"), tables, "met")
    return met.groupBy(*K, "frame_idx").agg(F.count("*").alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))


@query(A.with_tables("notes", "frames", "points") + _MICROS + " SELECT song_id, note_idx FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.song_id = n.song_id AND t BETWEEN lo - 150000 AND lo + 150000)")
def streamed_occlusion(spark, d):
    """Notes without a tracked point near their onset, from two streams."""
    notes, frames, tables = _streamed(spark, d)
    unseen = joins.streamed_unseen(notes, frames, K, "on_at", "at", "0.15 SECONDS")
    return _ran(unseen, tables, "unseen").where("song_id NOT LIKE '~%'").select(*K, "note_idx")


# --- sketches


@query("""WITH e AS (SELECT event_type, user_id, value FROM events), g AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact FROM e GROUP BY event_type UNION ALL SELECT NULL, count(*), count(DISTINCT user_id) FROM e)
    SELECT coalesce(event_type, 'all') AS event_type, n, exact, true AS distinct_within, true AS median_within, true AS frequent_within FROM g""")
def sketch_bounds(spark, d):
    """Sketches per kind of event and day, rolled up to kinds and to all, held against exact values and stated bounds."""
    e = A.events(spark, d).withColumn("day", F.to_date("ts"))
    fine = sketches.sketched(e, ["event_type", "day"], F.col("value"), F.col("user_id"))
    total = sketches.rolled_up(fine, []).withColumn("event_type", F.lit("all"))
    told = sketches.estimates(sketches.rolled_up(fine, ["event_type"]).unionByName(total), top=3)
    told = told.select("event_type", "n", "n_distinct", F.get("quantiles", 0).alias("median"), F.col("frequent"))
    both = e.select("event_type", "user_id", "value").unionByName(e.select(F.lit("all").alias("event_type"), "user_id", "value"))
    met = both.join(told.select("event_type", "median"), "event_type")
    share = lambda c: F.avg(c.cast("double"))
    exact = met.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"), share(F.col("value") < F.col("median")).alias("below"), share(F.col("value") <= F.col("median")).alias("upto"))
    counts = both.groupBy("event_type", F.col("user_id").cast("string").alias("item")).agg(F.count("*").alias("c"))
    often = told.select("event_type", F.explode("frequent").alias("f")).select("event_type", F.col("f.item").alias("item"), F.col("f.count").alias("told"))
    often = sketches.frequent_within(often, counts, ["event_type"], top=3)
    off = sketches.rank_error()
    return told.join(exact, "event_type").join(often, "event_type").select(
        "event_type", "n", "exact", (F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.distinct_error() * F.col("exact"))).alias("distinct_within"),
        ((F.col("below") <= 0.5 + off) & (F.col("upto") >= 0.5 - off)).alias("median_within"), "frequent_within")


# --- functions in SQL


@query(A.with_tables("notes") + """, g AS (SELECT song_id, start_sec, pitch, CASE WHEN start_sec - lag(start_sec) OVER (PARTITION BY song_id ORDER BY start_sec) > 0.5e0 THEN 1 ELSE 0 END AS cut FROM notes),
    r AS (SELECT song_id, start_sec, sum(cut) OVER (PARTITION BY song_id ORDER BY start_sec ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT song_id, min(start_sec) AS first, max(start_sec) AS last, count(*) AS n FROM r GROUP BY song_id, run),
    m AS (SELECT song_id, median(pitch) AS mid FROM notes GROUP BY song_id), a AS (SELECT n.song_id, median(abs(pitch - mid)) AS deviation FROM notes n JOIN m ON m.song_id = n.song_id GROUP BY n.song_id)
    SELECT s.song_id, first, last, n, deviation FROM s JOIN a USING (song_id)""")
def table_functions(spark, d):
    """A table function over ordered partitions and an aggregate of our own, both called from SQL."""
    sql_tables.register(spark)
    A.notes(spark, d).createOrReplaceTempView("cadenza_notes")
    return spark.sql("""
        WITH s AS (SELECT * FROM stretches(TABLE(SELECT song_id, start_sec FROM cadenza_notes) PARTITION BY song_id ORDER BY (start_sec), 'start_sec', 0.5)),
        a AS (SELECT song_id, median_deviation(pitch) AS deviation FROM cadenza_notes GROUP BY song_id)
        SELECT s.song_id, s.first, s.last, s.n, a.deviation FROM s JOIN a ON a.song_id = s.song_id""")


# --- stores


@query(ORACLE["settings_upsert"])
def store_upserts(spark, d):
    """Settings that are stored and then replaced in part, read back from the store."""
    tables = SharedTables(spark, "store")
    s = read(spark, d, "customer").groupBy(F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string")).alias("key")).agg(F.min("c_acctbal").alias("value"))
    f = read(spark, d, "supplier").groupBy(F.concat(F.lit("k"), (F.col("s_suppkey") % 30).cast("string")).alias("key")).agg(F.max("s_acctbal").alias("value"))
    store = KeyedStore(spark, f"{tables.root}/settings", s.schema)
    store.upsert(s)
    store.upsert(f)
    return store.read()


# --- renders and whole folders


@query(A.with_tables("notes", "frames") + "," + _PATCH + f""",
    d AS (SELECT s.*, n.pitch FROM sampled s JOIN notes n ON n.song_id = s.song_id AND n.note_idx = s.note_idx), k AS (SELECT pitch, median(r) AS r, median(g) AS g, median(b) AS b FROM d GROUP BY pitch),
    l AS (SELECT d.*, sqrt((d.r - k.r) ** 2 + (d.g - k.g) ** 2 + (d.b - k.b) ** 2) > 40 AS lit, row_number() OVER (PARTITION BY song_id, note_idx ORDER BY time_sec, d.r, d.g, d.b) AS nth FROM d JOIN k ON k.pitch = d.pitch),
    s AS (SELECT *, bool_or(lit AND time_sec >= start_sec) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
        NOT lit AND NOT coalesce(lead(lit, 1) OVER w, true) AND NOT coalesce(lead(lit, 2) OVER w, true) AS run FROM l WINDOW w AS (PARTITION BY song_id, note_idx ORDER BY time_sec)),
    e AS (SELECT song_id, note_idx, min(time_sec) FILTER (seen AND run) AS lit_end FROM s GROUP BY ALL),
    h AS (SELECT song_id, note_idx, least({_d(_REFS['LH_white'])}, {_d(_REFS['LH_black'])}) AS l, least({_d(_REFS['RH_white'])}, {_d(_REFS['RH_black'])}) AS r FROM l AS d WHERE nth = 1),
    c AS (SELECT n.*, h.l, h.r, least(duration_sec, lit_end - start_sec) AS cut FROM notes n JOIN h ON h.song_id = n.song_id AND h.note_idx = n.note_idx JOIN e ON e.song_id = n.song_id AND e.note_idx = n.note_idx)
    SELECT song_id, note_idx, onset_tick, pitch, CASE WHEN l <= r THEN 'L' ELSE 'R' END AS hand, round(CASE WHEN l + r = 0 THEN 1 ELSE greatest(l, r) / (l + r) END, 4) AS confidence, start_sec,
      CASE WHEN cut >= 0.05::DOUBLE THEN cut ELSE duration_sec END AS duration_sec, CASE WHEN cut >= 0.05::DOUBLE AND cut <> duration_sec THEN round(cut, 4) END AS trimmed_sec FROM c""")
def picture_render(spark, d):
    """A rendered video's notes from its pictures: hands by the first sample of all, durations until keys go dark."""
    tables = SharedTables(spark, "render")
    s, n = tables.write(_samples(spark, d), "samples"), A.notes(spark, d)
    base = N.key_baselines(s.join(n.select(*K, "note_idx", "pitch"), [*K, "note_idx"]))
    return render.analyse_render(n, s, base, _REFS)


@query(A.with_tables("notes") + "SELECT song_id, count(*) AS notes, true AS same_fingering, true AS same_midi, 'DISCLAIMER.txt,fingering.json,manifest.json,song.mid' AS names FROM notes GROUP BY song_id")
def folder_analysis(spark, d):
    """Songs from a MIDI folder and nested landmarks to fingerings, cut MIDI and bundles, all read again."""
    _, _, tables = _song_events(spark, d)
    out = f"{tables.root}/out"
    files.analyse_folder(spark, f"{tables.root}/songs", _nested(spark, d), lambda x, y: 21 + (x - 40) / 12.0, out, disclaimer="No warranty.")
    tables.drop("songs")
    song = lambda ending: F.regexp_extract("path", rf"([^/]*)\.{ending}$", 1).alias("song_id")
    read_files = lambda kind, ending: spark.read.format("binaryFile").load(f"{out}/{kind}").select(song(ending), "content")
    notes = midi.read_notes(tables.write(spark.read.format("midi").load(f"{out}/midi"))).groupBy(song("mid")).agg(F.count("*").alias("notes"))
    zips = read_files("bundles", "zip").mapInPandas(files.opened, "song_id string, names string, fingering string, midi binary")
    loose = read_files("fingerings", "json").select("song_id", F.col("content").alias("text")).join(read_files("midi", "mid").select("song_id", F.col("content").alias("mid")), "song_id")
    told = lambda c: F.from_json(c.cast("string"), "version INT, notes ARRAY<STRUCT<onset_tick: BIGINT, pitch: INT, hand: STRING, finger: INT, start_sec: DOUBLE, corrected_end_sec: DOUBLE>>")
    return zips.join(loose, "song_id").join(notes, "song_id").select("song_id", "notes", (told(F.col("fingering")) == told(F.col("text"))).alias("same_fingering"), (F.col("midi") == F.col("mid")).alias("same_midi"), "names")


# --- rows of keys, second looks


ORACLE["keyboard_rows"] = f"""WITH {catalogue2._CENTROIDS},
    anchors AS (SELECT n_nationkey, ({catalogue2._white('pitch')} - {catalogue2._white('36')}) / ({catalogue2._white('96')} - {catalogue2._white('36')}) AS u, x, 3e2 AS y FROM k),
    moments AS (SELECT n_nationkey, var_pop(u) AS uu, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(u * x, u) AS uxu, covar_pop(u * y, u) AS uyu, covar_pop(x, u * x) AS xux, covar_pop(y, u * y) AS yuy,
        var_pop(u * x) AS uxux, var_pop(u * y) AS uyuy, avg(u) AS mu, avg(x) AS mx, avg(y) AS my, avg(u * x) AS mux, avg(u * y) AS muy FROM anchors GROUP BY n_nationkey),
    slant AS (SELECT *, -((xux - xu * uxu / uu) + (yuy - yu * uyu / uu)) / ((uxux - uxu * uxu / uu) + (uyuy - uyu * uyu / uu)) AS e FROM moments),
    fitted AS (SELECT *, (xu + e * uxu) / uu AS a, (yu + e * uyu) / uu AS c FROM slant)
    SELECT n_nationkey, round(a, 6) AS a, round(mx + e * mux - a * mu, 6) AS b, round(c, 6) AS c, round(my + e * muy - c * mu, 6) AS d, round(e, 6) AS e FROM fitted"""

_TARGETS = """, h AS (SELECT f.song_id, f.frame_idx, f.time_sec, count(DISTINCT p.hand) AS hands FROM frames f LEFT JOIN points p ON p.song_id = f.song_id AND p.frame_idx = f.frame_idx GROUP BY ALL),
    w AS (SELECT song_id, frame_idx, hand, avg(wi) AS wi FROM points WHERE finger = 6 GROUP BY ALL),
    u AS (SELECT h.*, n.wi AS nwi FROM h JOIN notes n ON n.song_id = h.song_id AND h.time_sec >= n.start_sec - 0.03::DOUBLE AND h.time_sec <= n.start_sec + n.duration_sec + 0.03::DOUBLE
        WHERE hands < 2 AND NOT EXISTS (SELECT 1 FROM w WHERE w.song_id = h.song_id AND w.frame_idx = h.frame_idx AND abs(w.wi - n.wi) <= 5)),
    ta AS (SELECT song_id, frame_idx, min(nwi) AS x_min, max(nwi) AS x_max FROM u GROUP BY ALL)"""


@query(A.with_tables("notes", "frames", "points") + _TARGETS + """, c AS (SELECT song_id, frame_idx, greatest(0, trunc(x_min * 20 - 80)::INTEGER) AS cx1, least(900, trunc(x_max * 20 + 80)::INTEGER) AS cx2, 200 AS cy1, 420 AS cy2 FROM ta)
    SELECT * FROM c WHERE cx2 - cx1 >= 20""")
def recovery_crops(spark, d):
    """Where a second look for missing hands looks."""
    t = N.recovery_targets(A.frames(spark, d), A.points(spark, d), A.notes(spark, d))
    return N.recovery_crops(t, lambda wi: wi * 20.0, 900, 200, 420, 20.0).select(*K, "frame_idx", "cx1", "cx2", "cy1", "cy2")


@query(A.with_tables("notes", "frames", "points") + ", " + catalogue2._RECOVERED + ", " + catalogue2._TRACKED + _TARGETS + """,
    lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY frame_idx) AS k FROM ta) WHERE k <= 40),
    far AS (SELECT rc.* FROM rc WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.song_id = rc.song_id AND tr.frame_idx = rc.frame_idx AND abs(tr.x - rc.x) < 60)),
    kept AS (SELECT * FROM far b WHERE pos = 0 OR NOT EXISTS (SELECT 1 FROM far a WHERE a.song_id = b.song_id AND a.frame_idx = b.frame_idx AND a.pos = 0 AND abs(a.x - b.x) < 60)),
    me AS (SELECT kept.* FROM kept JOIN lo ON lo.song_id = kept.song_id AND lo.frame_idx = kept.frame_idx),
    du AS (SELECT song_id, frame_idx FROM (SELECT song_id, frame_idx FROM tr UNION ALL SELECT song_id, frame_idx FROM me) GROUP BY ALL HAVING count(*) >= 2)
    SELECT song_id, (SELECT count(*) FROM ta t WHERE t.song_id = s.song_id) AS problem_frames, (SELECT count(*) FROM lo t WHERE t.song_id = s.song_id) AS reran, (SELECT count(*) FROM me t WHERE t.song_id = s.song_id) AS hands_recovered,
      (SELECT count(*) FROM lo t JOIN du ON du.song_id = t.song_id AND du.frame_idx = t.frame_idx WHERE t.song_id = s.song_id) AS frames_now_dual FROM (SELECT DISTINCT song_id FROM ta) s""")
def recovery_counts(spark, d):
    """What a second look at up to forty frames a song came to."""
    frames, points, notes = A.frames(spark, d), A.points(spark, d), A.notes(spark, d)
    t, looked = N.recovery_targets(frames, points, notes), N.recovery_targets(frames, points, notes, most=40)
    found = catalogue2._found(spark, d).join(looked.select(*K, "frame_idx"), [*K, "frame_idx"], "left_semi")
    tracked = catalogue2._tracked(spark, d)
    return N.recovery_counts(t, looked, N.merged_recoveries(found, tracked), tracked)


# --- Paths of results, and calibrations as text


@query("""WITH p AS (
      SELECT page_id, url || ['/a.b', '.mid', '.midi', '/piece.fingering.json', '.json', '/..name', '/.hidden.mp4'][page_id % 7 + 1] AS path FROM pages WHERE url IS NOT NULL),
    q AS (
      SELECT page_id, path, split_part(path, '/', -1) AS name, left(path, length(path) - length(split_part(path, '/', -1))) AS folder,
        CASE WHEN path LIKE '%.fingering.json' THEN left(path, length(path) - 15) WHEN path LIKE '%.json' THEN left(path, length(path) - 5) ELSE path END AS bare FROM p),
    r AS (
      SELECT *, CASE WHEN ltrim(name, '.') LIKE '%.%' THEN left(name, length(name) - length(split_part(name, '.', -1)) - 1) ELSE name END AS stem FROM q)
    SELECT page_id, folder || stem || '.fingering.json' AS output, '/out/' || stem || '.fingering.json' AS of_video, bare || '.zip' AS bundle, bare || '.truth.json' AS truth,
      CASE WHEN bare <> path THEN bare ELSE folder || stem END AS plain FROM r""")
def output_paths(spark, d):
    """Where results, bundles and files of true fingers go, from paths with all sorts of names."""
    ends = F.array(*map(F.lit, ["/a.b", ".mid", ".midi", "/piece.fingering.json", ".json", "/..name", "/.hidden.mp4"]))
    p = read(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.concat("url", ends[(F.col("page_id") % 7).cast("int")]).alias("path"))
    path = F.col("path")
    return p.select(
        "page_id", text.output_path(path).alias("output"), text.video_output_path(path, F.lit("/out")).alias("of_video"), text.bundle_path(path, ".zip").alias("bundle"),
        text.truth_path(path).alias("truth"), text.without_json(path).alias("plain"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (21 + o_orderkey % 20)::INTEGER END AS low_pitch, CASE WHEN o_orderkey % 11 <> 0 THEN 108 END AS high_pitch,
      CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 / 8e0 END END AS k1,
      CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 4 / 2e0 END END AS rotation,
      CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 100 + 1280)::DOUBLE END AS right_x,
      CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN 15e-1 * (o_orderkey % 9) END AS row_start,
      CASE WHEN o_orderkey % 11 <> 0 THEN 'corners,low_pitch,high_pitch,k1' || CASE WHEN o_orderkey % 2 = 0 THEN ',row' ELSE '' END
        || CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0 THEN ',rotation_deg' ELSE '' END END AS fields FROM orders""")
def stored_calibrations(spark, d):
    """Calibrations read from texts that leave out fields or are broken, written and read again."""
    k = F.col("o_orderkey")
    right = (k % 100 + 1280).cast("double")
    corners = F.array(*(F.array(x, y) for x, y in ((F.lit(0.0), F.lit(5.0)), (right, F.lit(5.0)), (right, F.lit(90.0)), (F.lit(0.0), F.lit(90.0)))))
    low = F.when(k % 22 != 0, (21 + k % 20).cast("int"))
    row = F.when(k % 2 == 0, F.array((1.5 * (k % 9)).cast("double"), *map(F.lit, (0.5, 2.0, 0.0, 0.1))))
    told = F.to_json(F.struct(
        corners.alias("corners"), low.alias("low_pitch"), F.lit(108).alias("high_pitch"), F.when(k % 3 != 0, k % 7 / F.lit(8.0)).alias("k1"), row.alias("row"),
        F.when(k % 5 != 0, k % 4 / F.lit(2.0)).alias("rotation_deg"), F.lit("more").alias("other")))
    told = F.when(k % 22 == 11, F.lit("[1, {")).otherwise(told)
    o = read(spark, d, "orders").select("o_orderkey", calibration.to_stored(calibration.from_stored(told)).alias("written"))
    o = o.withColumn("c", F.explode(F.array(calibration.from_stored(F.col("written")))))  # a row each, parsed once
    c = F.col("c")
    return o.select(
        "o_orderkey", c["low_pitch"].alias("low_pitch"), c["high_pitch"].alias("high_pitch"), c["k1"].alias("k1"), c["rotation_deg"].alias("rotation"),
        c["corners"][1][0].alias("right_x"), c["row"][0].alias("row_start"), F.array_join(F.json_object_keys("written"), ",").alias("fields"))
