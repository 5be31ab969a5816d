"""Registered queries of the performance operators, each with an independent DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour, music, text
from ..operators import matching, refine, release, signal, timeline
from ..operators import notes as N
from ..sources.shared import SharedTables
from . import analogue as A
from . import benchmark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
K = ["song_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filters and windows of values


@query(A.with_tables("notes") + "SELECT song_id, note_idx, pitch, velocity, duration_sec FROM notes WHERE velocity >= 15 AND duration_sec >= 0.05")
def filter_note_events(spark, d):
    """Notes of enough velocity and duration."""
    return N.audible(A.notes(spark, d)).select(*K, "note_idx", "pitch", "velocity", "duration_sec")


@query(A.with_tables("notes") + """SELECT song_id, note_idx, start_sec, CASE WHEN finger BETWEEN 1 AND 5 THEN finger END AS finger FROM notes WHERE start_sec <= 30 AND confidence >= 0.2""")
def trim_notes(spark, d):
    """Notes up to a time, of enough confidence, with wrist and palm matches as null fingers."""
    return N.trimmed(A.notes(spark, d), 30, 0.2).select(*K, "note_idx", "start_sec", "finger")


@query(A.with_tables("notes") + """SELECT song_id, greatest(0, min(pitch) // 12 * 12)::INTEGER AS low, least(127, ceil(max(pitch) / 12e0) * 12)::INTEGER AS high FROM notes GROUP BY song_id""")
def pitch_range(spark, d):
    """Whole octaves around each song's pitches."""
    r = A.notes(spark, d).groupBy(*K).agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    low, high = music.seed_range(F.col("lo"), F.col("hi"))
    return r.select(*K, low.cast("int").alias("low"), high.cast("int").alias("high"))


@query(A.with_tables("notes") + "SELECT song_id, floor(start_sec / 1e1) * 1e1 AS window_start, avg(confidence) AS mean, count(*) AS n FROM notes GROUP BY ALL")
def confidence_windows(spark, d):
    """Mean confidence per ten seconds."""
    return signal.window_means(A.notes(spark, d), K, "start_sec", "confidence", 10.0)


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL")
def tumbling_mean(spark, d):
    """Mean value per hour and type of event."""
    e = A.events(spark, d).withColumn("hour", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) DIV 3600000000"))
    return e.groupBy("hour", "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


# --- names and scalar functions


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 128)::INTEGER AS pitch FROM part), n AS (SELECT range::INTEGER AS q,
    [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6][range % 12 + 1]::DOUBLE + 7 * (range // 12) + CASE WHEN range % 12 IN (1, 3, 6, 8, 10) THEN 7e-1 ELSE 0e0 END AS wi FROM range(128))
    SELECT p_partkey, pitch, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || (pitch // 12 - 1)::VARCHAR AS name, n.wi AS white_index,
    (SELECT arg_min(m.q, abs(m.wi - (n.wi + 2e-1)) * 1e6 + m.q * 1e-6) FROM n m) AS nearest FROM p JOIN n ON n.q = p.pitch""")
def note_names(spark, d):
    """Names and white-key places of pitches, and the pitch nearest to a place."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 128).cast("int").alias("pitch"))
    p = p.withColumns({"name": music.note_name(F.col("pitch")), "white_index": music.white_index(F.col("pitch"))})
    return p.withColumn("nearest", music.nearest_pitch(F.col("white_index") + 0.2))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN p_brand || ' - ' || p_name || ' Piano Tutorial' WHEN 1 THEN p_name || ' (Hard) by ' || p_brand WHEN 2 THEN p_type || ': ' || p_name || ' Easy Piano | Channel' WHEN 3 THEN p_name || '｜' || p_brand || ' beginner' ELSE p_name || ' (Piano Cover)' END"


def _noise(sql: str) -> str:
    for n in text.TITLE_NOISE:
        sql = f"trim(replace(replace({sql}, '{n}', ''), '{n.lower()}', ''))"
    return sql


@query(f"""WITH t AS (SELECT p_partkey, replace({_TITLE}, '｜', '|') AS r FROM part), c AS (SELECT p_partkey, CASE WHEN contains(r, '|') THEN trim(split_part(r, '|', 1)) ELSE r END AS t FROM t),
    s AS (SELECT p_partkey, CASE WHEN contains(t, ' - ') THEN trim(left(t, instr(t, ' - ') - 1)) WHEN contains(t, ' by ') THEN trim(substr(t, instr(t, ' by ') + 4)) WHEN contains(t, ': ') THEN trim(left(t, instr(t, ': ') - 1)) ELSE '' END AS artist,
    CASE WHEN contains(t, ' - ') THEN trim(substr(t, instr(t, ' - ') + 3)) WHEN contains(t, ' by ') THEN trim(left(t, instr(t, ' by ') - 1)) WHEN contains(t, ': ') THEN trim(substr(t, instr(t, ': ') + 2)) ELSE t END AS raw FROM c)
    SELECT p_partkey, artist, {_noise('raw')} AS title, CASE {' '.join(f"WHEN contains(lower(raw), '{w}') THEN '{v}'" for w, v in text.DIFFICULTY.items())} ELSE '' END AS difficulty, 'Piano' AS genre FROM s""")
def title_parse(spark, d):
    """Artist, title and difficulty of video titles."""
    p = read(spark, d, "part").select("p_partkey", text.parsed_title(F.expr(_TITLE)).alias("t"))
    return p.select("p_partkey", "t.artist", "t.title", "t.difficulty", "t.genre")


@query("""WITH s AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'ch ' || (page_id % 10)::VARCHAR END AS channel FROM pages),
    k AS (SELECT page_id, url, CASE WHEN channel <> '' THEN 'channel-' || channel ELSE 'path-' || left(sha1(url), 16) END AS key FROM s)
    SELECT page_id, key, regexp_replace(key, '[^\\p{L}\\p{N}\\-_.]', '_', 'g') AS file, regexp_replace(url || '.fingering.json', '(\\.fingering\\.json|\\.json|\\.mid)$', '') AS stem FROM k""")
def source_keys(spark, d):
    """Keys and file names under which what belongs to a source is stored."""
    p = read(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("ch "), (F.col("page_id") % 10).cast("string"))).alias("channel"))
    p = p.withColumn("key", text.source_key(F.col("channel"), F.col("url")))
    return p.select("page_id", "key", text.file_name_of(F.col("key")).alias("file"), text.without_suffix(F.concat("url", F.lit(".fingering.json"))).alias("stem"))


@query(A.with_tables("notes") + "SELECT song_id, note_idx, exp(-greatest(0, distance) / 8e-1) AS confidence FROM notes")
def match_confidence(spark, d):
    """Confidence that falls with distance."""
    return A.notes(spark, d).select(*K, "note_idx", music.confidence(F.col("distance"), 0.8).alias("confidence"))


_CORNERS = [(100.0, 200.0), (1700.0, 210.0), (1720.0, 480.0), (90.0, 470.0)]
_H = music.solve_homography(_CORNERS, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
_ROW = [1500.0, 150.0, 20.0, 400.0, 0.05]


def _h(row: int) -> str:
    return f"({_H[row][0]!r}::DOUBLE * x + {_H[row][1]!r}::DOUBLE * y + {_H[row][2]!r}::DOUBLE)"


@query(A.with_tables("notes", "frames", "points") + f"""SELECT song_id, frame_idx, hand, finger, {_h(0)} / {_h(2)} AS u, {_h(1)} / {_h(2)} AS v, 12 + {_h(0)} / {_h(2)} * 51 AS white_index,
    (x - 150e0) / (1500e0 - 5e-2 * x) AS row_u FROM points""")
def calibration_map(spark, d):
    """Screen points in keyboard space, by a homography of four corners and by a row of keys."""
    p = A.points(spark, d)
    u, v = music.homography(_H, F.col("x"), F.col("y"))
    return p.select(*K, "frame_idx", "hand", "finger", u.alias("u"), v.alias("v"), (12 + u * 51).alias("white_index"), music.row_invert(_ROW, F.col("x")).alias("row_u"))


# --- time joins


@query(A.with_tables("notes", "frames") + """SELECT f.song_id, f.frame_idx, count(n.note_idx) AS sounding, min(n.pitch) AS lowest, max(n.pitch) AS highest FROM frames f
    JOIN notes n ON n.song_id = f.song_id AND f.time_sec >= n.start_sec - 0.03::DOUBLE AND f.time_sec <= n.start_sec + greatest(n.duration_sec, 0) + 0.03::DOUBLE GROUP BY ALL""")
def sounding_pitches(spark, d):
    """Notes that sound at each frame."""
    n = A.notes(spark, d).select(*K, "note_idx", "pitch", (F.col("start_sec") - 0.03).alias("lo"), (F.col("start_sec") + F.greatest("duration_sec", F.lit(0.0)) + 0.03).alias("hi"))
    got = timeline.range_join(A.frames(spark, d).select(*K, "frame_idx", "time_sec"), n, K, "time_sec", "lo", "hi", 1.0)
    return got.groupBy(*K, "frame_idx").agg(F.count("note_idx").alias("sounding"), F.min("pitch").alias("lowest"), F.max("pitch").alias("highest"))


@query(A.with_tables("notes", "frames", "points") + """SELECT song_id, note_idx, NOT EXISTS (SELECT 1 FROM points p WHERE p.song_id = n.song_id AND p.time_sec >= n.start_sec - 0.15::DOUBLE AND p.time_sec <= n.start_sec + 0.15::DOUBLE) AS occluded FROM notes n""")
def occlusion(spark, d):
    """Notes without any tracked point near their onset."""
    return release.occluded(A.notes(spark, d).select(*K, "note_idx", "start_sec"), A.points(spark, d)).select(*K, "note_idx", "occluded")


_PEDAL = """, m AS (SELECT song_id, time_sec, event_id, value >= 64 AS down, coalesce(lag(value >= 64) OVER w, false) AS was, max(time_sec) OVER (PARTITION BY song_id) AS over FROM pedals WINDOW w AS (PARTITION BY song_id ORDER BY time_sec, event_id)),
    t AS (SELECT *, lead(time_sec) OVER (PARTITION BY song_id ORDER BY time_sec, event_id) AS nxt FROM m WHERE down <> was), pedal AS (SELECT song_id, time_sec AS start_sec, coalesce(nxt, over) AS end_sec FROM t WHERE down AND coalesce(nxt, over) > time_sec)"""


def _pedal(spark, d):
    return timeline.islands(A.pedal_events(spark, d), K, "time_sec", ["event_id"], F.col("value") >= 64)


@query(A.with_tables("notes", "pedals") + _PEDAL + "SELECT * FROM pedal")
def pedal_islands(spark, d):
    """Stretches with the pedal down."""
    return _pedal(spark, d)


@query(A.with_tables("notes", "pedals") + _PEDAL + "SELECT song_id, note_idx FROM notes n WHERE EXISTS (SELECT 1 FROM pedal p WHERE p.song_id = n.song_id AND n.start_sec + n.duration_sec BETWEEN p.start_sec AND p.end_sec)")
def notes_in_pedal(spark, d):
    """Notes that end under the pedal."""
    n = A.notes(spark, d).select(*K, "note_idx", (F.col("start_sec") + F.col("duration_sec")).alias("end"))
    p = _pedal(spark, d).withColumnsRenamed({"start_sec": "ps", "end_sec": "pe"})
    return timeline.range_join(n, p, K, "end", "ps", "pe", 2.0, "left_semi").select(*K, "note_idx")


#: Points at the times q (song_id, query_id, q_at), as tips (song_id, query_id, hand, finger, x, y).
_TIPS = """, live AS (SELECT DISTINCT song_id, frame_idx, time_sec FROM points),
    lb AS (SELECT song_id, time_sec, max(frame_idx) AS frame_idx FROM live GROUP BY ALL), la AS (SELECT song_id, time_sec, min(frame_idx) AS frame_idx FROM live GROUP BY ALL),
    n AS (SELECT q.*, b.frame_idx AS bf, b.time_sec AS bt, a.frame_idx AS af, a.time_sec AS at2 FROM q
      ASOF LEFT JOIN lb b ON b.song_id = q.song_id AND q.q_at >= b.time_sec ASOF LEFT JOIN la a ON a.song_id = q.song_id AND q.q_at < a.time_sec),
    m AS (SELECT *, CASE WHEN at2 - bt <= 0.2::DOUBLE THEN 'lerp' WHEN q_at - bt <= 0.15::DOUBLE AND (at2 IS NULL OR q_at - bt <= at2 - q_at) THEN 'before'
      WHEN at2 - q_at <= 0.15::DOUBLE THEN 'after' END AS mode FROM n),
    sides AS (SELECT m.song_id, m.query_id, p.hand, p.finger, 0 AS side, {x} AS x, {y} AS y, m.q_at, m.bt, m.at2 FROM m JOIN points p ON p.song_id = m.song_id AND p.frame_idx = m.bf
        WHERE mode IN ('lerp', 'before')
      UNION ALL SELECT m.song_id, m.query_id, p.hand, p.finger, 1, {x}, {y}, m.q_at, m.bt, m.at2 FROM m JOIN points p ON p.song_id = m.song_id AND p.frame_idx = m.af
        WHERE mode IN ('lerp', 'after')),
    g AS (SELECT song_id, query_id, hand, finger, max(x) FILTER (side = 0) AS x0, max(x) FILTER (side = 1) AS x1, max(y) FILTER (side = 0) AS y0, max(y) FILTER (side = 1) AS y1,
      max((q_at - bt) / (at2 - bt)) AS w FROM sides GROUP BY ALL),
    tips AS (SELECT song_id, query_id, hand, finger, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + w * (x1 - x0) END AS x,
      CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + w * (y1 - y0) END AS y FROM g)"""


@query(A.with_tables("notes", "frames", "points") + ", q AS (SELECT song_id, note_idx AS query_id, start_sec + 4e-2 AS q_at FROM notes)" + _TIPS.format(x="p.x", y="p.y") + "SELECT * FROM tips")
def asof_two_sided(spark, d):
    """Fingertips at given times, interpolated between the frames on either side."""
    q = A.notes(spark, d).select(*K, F.col("note_idx").alias("query_id"), (F.col("start_sec") + 0.04).alias("at"))
    return timeline.interpolated_points(q, A.frames(spark, d).select(*K, "frame_idx", "time_sec"), A.points(spark, d).select(*K, "frame_idx", "hand", "finger", "x", "y"))


@query(A.with_tables("notes") + """, k AS (SELECT DISTINCT song_id, hand, finger, start_sec FROM notes), l AS (SELECT *, lead(start_sec) OVER (PARTITION BY song_id, hand, finger ORDER BY start_sec) AS next_start FROM k)
    SELECT n.song_id, n.note_idx, l.next_start FROM notes n JOIN l USING (song_id, hand, finger, start_sec)""")
def next_strict(spark, d):
    """The next later onset of the same finger."""
    n = A.notes(spark, d).select(*K, "note_idx", "hand", "finger", "start_sec")
    return timeline.next_strictly_greater(n, [*K, "hand", "finger"], "start_sec", "next_start").select(*K, "note_idx", "next_start")


@query(A.with_tables("notes") + """, i AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE start_sec + duration_sec END AS oe, CASE WHEN event_id % 4 = 0 THEN start_sec + 0.2::DOUBLE END AS vr FROM notes),
    c AS (SELECT *, (SELECT min(o.start_sec) FROM i o WHERE o.song_id = i.song_id AND o.hand = i.hand AND o.finger = i.finger AND o.start_sec > i.start_sec) - 0.015::DOUBLE AS nf,
      (SELECT min(o.start_sec) FROM i o WHERE o.song_id = i.song_id AND o.pitch = i.pitch AND o.start_sec > i.start_sec) - 0.015::DOUBLE AS np FROM i),
    v AS (SELECT *, coalesce(least(nf, np, vr, oe), start_sec + 0.3::DOUBLE) AS val FROM c)
    SELECT song_id, note_idx, greatest(least(greatest(val, start_sec + 0.03::DOUBLE), coalesce(oe, greatest(val, start_sec + 0.03::DOUBLE))), start_sec) AS corrected_end_sec,
      CASE WHEN nf = val THEN 'same_finger_new_note' WHEN np = val THEN 'same_pitch_restrike' WHEN vr = val THEN 'visual_key_release' WHEN oe = val THEN 'original_midi_offset' ELSE 'fallback_estimate' END AS reason FROM v""")
def release_caps(spark, d):
    """When keys were let go, by the earliest of what caps a note."""
    n = A.notes(spark, d).withColumns({"original_end_sec": F.when(F.col("event_id") % 11 != 0, F.col("start_sec") + F.col("duration_sec")), "visual_release_sec": F.when(F.col("event_id") % 4 == 0, F.col("start_sec") + 0.2)})
    return release.corrected_ends(n).select(*K, "note_idx", "corrected_end_sec", "reason")


_SPIKES = """, o AS (SELECT *, lag(wi) OVER w AS p, lead(wi) OVER w AS n, lag(time_sec) OVER w AS tp, lead(time_sec) OVER w AS tn FROM points WHERE finger BETWEEN 1 AND 5 WINDOW w AS (PARTITION BY song_id, hand, finger ORDER BY time_sec, frame_idx)),
    s AS (SELECT * FROM o WHERE time_sec - tp <= 0.12::DOUBLE AND tn - time_sec <= 0.12::DOUBLE AND abs(wi - p) > 3 AND abs(n - wi) > 3 AND abs(n - p) <= 0.5::DOUBLE * least(abs(wi - p), abs(n - wi)))"""


@query(A.with_tables("notes", "frames", "points") + _SPIKES + """SELECT song_id, hand, finger, frame_idx, EXISTS (SELECT 1 FROM notes t WHERE t.song_id = s.song_id AND t.start_sec >= s.time_sec - 0.08::DOUBLE AND t.start_sec <= s.time_sec + 0.08::DOUBLE AND abs(t.wi - s.wi) <= 1.5) AS protected FROM s""")
def spike_detect(spark, d):
    """Fingers that jump away for one frame."""
    n = A.notes(spark, d).select(*K, "start_sec", F.col("wi").alias("note_wi"))
    return refine.spikes(A.points(spark, d), n).select(*K, "hand", "finger", "frame_idx", "protected")


_LEAPS = """, p AS (SELECT *, lead(start_sec) OVER w AS tb, lead(pitch) OVER w AS pb, lead(confidence) OVER w AS cb, lead(note_idx) OVER w AS nb, lag(pitch) OVER w AS before, lead(pitch, 2) OVER w AS after FROM notes WINDOW w AS (PARTITION BY song_id, hand ORDER BY start_sec, note_idx)),
    v AS (SELECT *, coalesce(abs(before - pitch) <= 18, false) AS af, coalesce(abs(after - pb) <= 18, false) AS bf FROM p WHERE tb - start_sec <= 0.2::DOUBLE AND abs(pb - pitch) > 18),
    x AS (SELECT *, CASE WHEN af AND NOT bf THEN true WHEN bf AND NOT af THEN false ELSE confidence > cb END AS isb FROM v)"""


@query(A.with_tables("notes") + _LEAPS + "SELECT song_id, hand, pitch AS pitch_a, pb AS pitch_b, CASE WHEN isb THEN nb ELSE note_idx END AS suspect, CASE WHEN isb THEN cb ELSE confidence END <= 0.35 AS fixed FROM x")
def leap_check(spark, d):
    """Leaps that no hand makes in that time."""
    return refine.leaps(A.notes(spark, d)).drop("time")


@query(A.with_tables("notes") + _LEAPS + """, f AS (SELECT DISTINCT song_id, CASE WHEN isb THEN nb ELSE note_idx END AS note_idx FROM x WHERE CASE WHEN isb THEN cb ELSE confidence END <= 0.35)
    SELECT n.song_id, n.note_idx, CASE WHEN f.note_idx IS NULL THEN n.hand WHEN n.hand = 'L' THEN 'R' ELSE 'L' END AS hand FROM notes n LEFT JOIN f USING (song_id, note_idx)""")
def leap_fix(spark, d):
    """Labels after the leaps' suspects are moved."""
    return refine.without_leaps(A.notes(spark, d)).select(*K, "note_idx", "hand")


@query(A.with_tables("notes") + """, v AS (SELECT a.song_id, a.note_idx, count(*) FILTER (b.hand = a.hand) AS same, count(*) FILTER (b.hand <> a.hand) AS opp FROM notes a JOIN notes b ON b.song_id = a.song_id AND b.note_idx <> a.note_idx
      AND b.start_sec >= a.start_sec - 0.6::DOUBLE AND b.start_sec <= a.start_sec + 0.6::DOUBLE AND abs(b.pitch - a.pitch) <= 7 WHERE a.confidence <= 0.35 GROUP BY ALL)
    SELECT n.song_id, n.note_idx, CASE WHEN v.opp >= 3 AND v.opp >= 4 * (v.same + 1) - 1 AND v.opp > v.same THEN CASE WHEN n.hand = 'L' THEN 'R' ELSE 'L' END ELSE n.hand END AS hand FROM notes n LEFT JOIN v USING (song_id, note_idx)""")
def band_neighbours(spark, d):
    """Labels smoothed by neighbours in time and pitch."""
    return refine.smoothed(A.notes(spark, d)).select(*K, "note_idx", "hand")


_CLUSTER = """, o AS (SELECT song_id, note_idx, start_sec, pitch, row_number() OVER (PARTITION BY song_id ORDER BY start_sec, note_idx) AS r FROM notes),
    f AS (SELECT song_id, r, start_sec AS first, 0::BIGINT AS cluster FROM o WHERE r = 1 UNION ALL
      SELECT o.song_id, o.r, CASE WHEN o.start_sec - f.first > {tol}::DOUBLE THEN o.start_sec ELSE f.first END, f.cluster + CASE WHEN o.start_sec - f.first > {tol}::DOUBLE THEN 1 ELSE 0 END FROM f JOIN o ON o.song_id = f.song_id AND o.r = f.r + 1),
    c AS (SELECT o.song_id, o.note_idx, o.pitch, f.cluster FROM o JOIN f USING (song_id, r))"""


@query(A.with_tables("notes") + _CLUSTER.format(tol=0.06) + "SELECT song_id, note_idx, cluster, min(pitch) OVER (PARTITION BY song_id, cluster) AS lowest FROM c")
def anchored_groups(spark, d):
    """Notes that start together: clusters anchored at their first note, with the lowest pitch of each."""
    c = timeline.anchored_clusters(A.notes(spark, d).select(*K, "note_idx", "start_sec", "pitch"), K, "start_sec", ["note_idx"], 0.06)
    return c.select(*K, "note_idx", F.col("cluster").cast("long").alias("cluster"), F.min("pitch").over(Window.partitionBy(*K, "cluster")).alias("lowest"))


@query(A.with_tables("notes") + _CLUSTER.format(tol=0.03) + """, l AS (SELECT song_id, note_idx, min(pitch) OVER (PARTITION BY song_id, cluster) AS lowest FROM c),
    a AS (SELECT song_id, start_sec, pitch, hand FROM notes WHERE confidence >= 0.5 AND song_id IN (SELECT song_id FROM notes WHERE confidence >= 0.5 GROUP BY song_id HAVING count(*) >= 4)),
    g AS (SELECT n.song_id, n.note_idx, n.pitch, avg(a.pitch) FILTER (a.hand = 'L') AS lc, avg(a.pitch) FILTER (a.hand = 'R') AS rc, count(*) FILTER (a.hand = 'L' AND abs(a.pitch - n.pitch) <= 1) AS nl, count(*) FILTER (a.hand = 'R' AND abs(a.pitch - n.pitch) <= 1) AS nr
      FROM notes n JOIN a ON a.song_id = n.song_id AND a.start_sec >= n.start_sec - 3e0 AND a.start_sec <= n.start_sec + 3e0 WHERE n.confidence < 0.5 GROUP BY ALL),
    p AS (SELECT g.song_id, g.note_idx, ((abs(g.pitch - rc) - abs(g.pitch - lc)) / (abs(g.pitch - rc) + abs(g.pitch - lc) + 1e-6) + (nl - nr) / (nl + nr + 1)::DOUBLE + CASE WHEN l.lowest = g.pitch THEN 5e-1 ELSE 0e0 END) / 2.5e0 AS pref
      FROM g JOIN l USING (song_id, note_idx) WHERE lc IS NOT NULL AND rc IS NOT NULL)
    SELECT n.song_id, n.note_idx, CASE WHEN p.pref >= 0.35::DOUBLE THEN 'L' WHEN p.pref <= -0.35::DOUBLE THEN 'R' ELSE n.hand END AS hand FROM notes n LEFT JOIN p USING (song_id, note_idx)""")
def voice_refine(spark, d):
    """Labels by register, recurrence and lowest voice."""
    return refine.by_voice(A.notes(spark, d)).select(*K, "note_idx", "hand")


@query(A.with_tables("notes") + _CLUSTER.format(tol=0.06) + """,
    ps AS (SELECT song_id, cluster, list(pitch ORDER BY pitch, note_idx) AS ps FROM c GROUP BY ALL),
    gaps AS (SELECT *, ps[len(ps)] - ps[1] > 18 AS wide, list_transform(range(1, len(ps)), lambda i: ps[i + 1] - ps[i]) AS gaps FROM ps),
    cuts AS (SELECT *, CASE WHEN wide THEN list_position(gaps, list_max(gaps)) ELSE 0 END AS cut FROM gaps),
    means AS (SELECT song_id, cluster, wide, cut, list_avg(CASE WHEN wide THEN ps[1:cut] ELSE ps END) AS lm, list_avg(CASE WHEN wide THEN ps[cut + 1:] ELSE ps END) AS rm FROM cuts),
    ends AS (SELECT song_id, min(pitch) + (max(pitch) - min(pitch)) * 0.25e0 AS l, min(pitch) + (max(pitch) - min(pitch)) * 0.75e0 AS r FROM notes GROUP BY song_id),
    fold AS (SELECT song_id, -1::BIGINT AS cluster, CASE WHEN r - l < 1 THEN l - 6 ELSE l END AS l, CASE WHEN r - l < 1 THEN r + 6 ELSE r END AS r, '' AS side FROM ends UNION ALL
      SELECT song_id, cluster, CASE WHEN side <> 'R' THEN l + 0.25e0 * (lm - l) ELSE l END, CASE WHEN side <> 'L' THEN r + 0.25e0 * (rm - r) ELSE r END, side
      FROM (SELECT f.song_id, m.cluster, f.l, f.r, m.lm, m.rm, CASE WHEN m.wide THEN 'B' WHEN abs(m.lm - f.l) <= abs(m.lm - f.r) THEN 'L' ELSE 'R' END AS side
        FROM fold f JOIN means m ON m.song_id = f.song_id AND m.cluster = f.cluster + 1)),
    placed AS (SELECT song_id, note_idx, cluster, pitch, row_number() OVER (PARTITION BY song_id, cluster ORDER BY pitch, note_idx) AS k FROM c),
    prior AS (SELECT p.song_id, p.note_idx, CASE WHEN f.side <> 'B' THEN f.side WHEN p.k <= m.cut THEN 'L' ELSE 'R' END AS hand, least(1, abs(p.pitch - (f.l + f.r) / 2e0) / 12e0) AS strength
      FROM placed p JOIN fold f ON f.song_id = p.song_id AND f.cluster = p.cluster JOIN means m ON m.song_id = p.song_id AND m.cluster = p.cluster)
    SELECT n.song_id, n.note_idx, CASE WHEN n.confidence < 0.5 AND p.strength >= 0.5 THEN p.hand ELSE n.hand END AS hand FROM notes n JOIN prior p USING (song_id, note_idx)""")
def prior_fuse(spark, d):
    """Labels fused with the prior of pitch alone (a fold over each song)."""
    n = A.notes(spark, d)
    return refine.fused(n, refine.hand_prior(n)).select(*K, "note_idx", "hand")


@query(A.with_tables("notes", "frames", "points") + """,
    h AS (SELECT *, count(*) OVER w AS n, max(x) FILTER (hand = 'L') OVER w AS lx, max(x) FILTER (hand = 'R') OVER w AS rx FROM points WHERE finger = 0 WINDOW w AS (PARTITION BY song_id, frame_idx)),
    u AS (SELECT song_id, frame_idx, struct_pack(hand := CASE WHEN n = 2 AND lx > rx THEN CASE WHEN hand = 'L' THEN 'R' ELSE 'L' END ELSE hand END, x := x) AS h FROM h),
    f AS (SELECT f.song_id, f.frame_idx, row_number() OVER (PARTITION BY f.song_id ORDER BY f.frame_idx) AS i, coalesce(list(u.h) FILTER (u.h IS NOT NULL), []) AS hs
      FROM frames f LEFT JOIN u USING (song_id, frame_idx) GROUP BY f.song_id, f.frame_idx),
    a AS (SELECT *, list_concat(list_concat(coalesce(lead(hs, 1) OVER w, []), coalesce(lead(hs, 2) OVER w, [])), coalesce(lead(hs, 3) OVER w, [])) AS ahead
      FROM f WINDOW w AS (PARTITION BY song_id ORDER BY i)),
    v AS (SELECT DISTINCT song_id, -1::BIGINT AS frame_idx, 0::BIGINT AS i, []::STRUCT(hand VARCHAR, x DOUBLE)[] AS now, []::STRUCT(hand VARCHAR, x DOUBLE)[] AS p1, []::STRUCT(hand VARCHAR, x DOUBLE)[] AS p2 FROM f
      UNION ALL SELECT song_id, frame_idx, i, CASE WHEN len(hs) = 1 AND len(list_filter(near, lambda o: o.hand <> hs[1].hand)) > 2 * len(list_filter(near, lambda o: o.hand = hs[1].hand))
        THEN [struct_pack(hand := CASE WHEN hs[1].hand = 'L' THEN 'R' ELSE 'L' END, x := hs[1].x)] ELSE hs END, now, p1
      FROM (SELECT a.song_id, a.frame_idx, a.i, a.hs, v.now, v.p1, list_filter(list_concat(list_concat(v.now, v.p1), list_concat(v.p2, a.ahead)), lambda o: abs(o.x - a.hs[1].x) < 100) AS near
        FROM v JOIN a ON a.song_id = v.song_id AND a.i = v.i + 1))
    SELECT song_id, frame_idx, h.hand AS hand, h.x AS x FROM (SELECT song_id, frame_idx, unnest(now) AS h FROM v)""")
def hand_continuity(spark, d):
    """Hands whose labels are made to follow the frames around (a fold over each song)."""
    return refine.continuous(A.points(spark, d).where("finger = 0").select(*K, "frame_idx", "hand", "x"), A.frames(spark, d))


@query(A.with_tables("notes", "frames", "points") + """, h AS (SELECT song_id, frame_idx, hand, x FROM points WHERE finger = 0), s AS (SELECT *, count(*) OVER w AS n, max(x) FILTER (hand = 'L') OVER w AS lx, max(x) FILTER (hand = 'R') OVER w AS rx FROM h WINDOW w AS (PARTITION BY song_id, frame_idx))
    SELECT song_id, frame_idx, x, CASE WHEN n = 2 AND lx > rx THEN CASE WHEN hand = 'L' THEN 'R' ELSE 'L' END ELSE hand END AS hand FROM s""")
def uncrossed_hands(spark, d):
    """Labels of crossed hands swapped."""
    return refine.uncrossed(A.points(spark, d).where("finger = 0").select(*K, "frame_idx", "hand", "x"))


# --- evidence


_LEFT = """, k AS (SELECT DISTINCT song_id, wi FROM notes),
    c AS (SELECT DISTINCT p.song_id, p.frame_idx, k.wi FROM points p JOIN k ON k.song_id = p.song_id AND abs(p.wi - k.wi) <= 1.5),
    g AS (SELECT f.song_id, f.frame_idx, f.time_sec, k.wi, c.wi IS NOT NULL AS near FROM frames f JOIN k ON k.song_id = f.song_id LEFT JOIN c ON c.song_id = f.song_id AND c.frame_idx = f.frame_idx AND c.wi = k.wi),
    r AS (SELECT *, NOT near AND NOT coalesce(lead(near, 1) OVER w, true) AND NOT coalesce(lead(near, 2) OVER w, true) AS run FROM g WINDOW w AS (PARTITION BY song_id, wi ORDER BY time_sec, frame_idx)),
    s AS (SELECT song_id, wi, time_sec AS left_at FROM r WHERE run),
    left_key AS (SELECT n.song_id, n.note_idx, s.left_at FROM notes n ASOF LEFT JOIN s ON s.song_id = n.song_id AND s.wi = n.wi AND n.start_sec <= s.left_at)"""


@query(A.with_tables("notes", "frames", "points") + _LEFT + "SELECT song_id, note_idx, left_at FROM left_key")
def first_run3(spark, d):
    """When fingers leave keys: the first three frames in a row without one near."""
    n = A.notes(spark, d).select(*K, "note_idx", "start_sec", "wi")
    return release.finger_leaves(n, A.frames(spark, d), A.points(spark, d)).select(*K, "note_idx", "left_at")


@query(A.with_tables("notes", "frames", "points", "pedals") + _PEDAL + _LEFT + """,
    o AS (SELECT DISTINCT n.song_id, n.note_idx FROM notes n JOIN points p ON p.song_id = n.song_id AND p.time_sec >= n.start_sec - 0.15::DOUBLE AND p.time_sec <= n.start_sec + 0.15::DOUBLE),
    h AS (SELECT DISTINCT n.song_id, n.note_idx FROM notes n JOIN pedal p ON p.song_id = n.song_id AND n.start_sec + n.duration_sec BETWEEN p.start_sec AND p.end_sec),
    e AS (SELECT n.*, o.note_idx IS NOT NULL AND n.distance > 2.5::DOUBLE AS ghost, l.left_at - n.start_sec AS trimmed,
        o.note_idx IS NOT NULL AND h.note_idx IS NOT NULL AND coalesce(n.start_sec + n.duration_sec - l.left_at >= 0.15::DOUBLE AND l.left_at - n.start_sec >= 0.12::DOUBLE, false) AS off
      FROM notes n LEFT JOIN left_key l USING (song_id, note_idx) LEFT JOIN o USING (song_id, note_idx) LEFT JOIN h USING (song_id, note_idx))
    SELECT song_id, note_idx, concat_ws(',', CASE WHEN ghost THEN 'ghost' END, CASE WHEN ghost AND velocity < 30 THEN 'dropped' END, CASE WHEN off THEN 'depedaled' END) AS flags,
      CASE WHEN off THEN duration_sec END AS audio_duration_sec, CASE WHEN off THEN trimmed END AS trimmed_duration_sec FROM e""")
def reconcile_notes(spark, d):
    """Ghost and depedalled notes (composed of operators that have oracles of their own)."""
    with timeline.dealt_once(spark):  # all four tables are dealt by song
        out = release.reconciled(A.notes(spark, d), A.points(spark, d), A.frames(spark, d), _pedal(spark, d))
        return SharedTables(spark, "reconciled").write(out.select(*K, "note_idx", F.array_join("flags", ",").alias("flags"), "audio_duration_sec", "trimmed_duration_sec"))


@query(A.with_tables("notes", "frames", "points") + """, h AS (SELECT f.song_id, f.frame_idx, coalesce(bool_or(p.hand = 'L'), false) AND coalesce(bool_or(p.hand = 'R'), false) AS two FROM frames f LEFT JOIN points p USING (song_id, frame_idx) GROUP BY ALL)
    SELECT song_id, avg(two::INTEGER) AS rate FROM h GROUP BY song_id""")
def dual_hand_rate(spark, d):
    """Share of frames, also empty ones, that show both hands."""
    return N.dual_hand_rate(A.frames(spark, d), A.points(spark, d))


@query(A.with_tables("notes", "frames", "points") + """, c AS (SELECT song_id, frame_idx, avg(wi) FILTER (hand = 'L') AS l, avg(wi) FILTER (hand = 'R') AS r FROM points GROUP BY ALL), s AS (SELECT song_id, abs(l - r) AS d FROM c WHERE l IS NOT NULL AND r IS NOT NULL)
    SELECT song_id, count(*) AS n, avg(d) AS mean, median(d) AS median, avg((d < 3)::INTEGER) AS close FROM s GROUP BY song_id""")
def hand_spread(spark, d):
    """How far apart the hands are."""
    return N.hand_spread(A.points(spark, d))


@query(A.with_tables("notes", "frames", "points") + """, h AS (SELECT f.song_id, f.frame_idx, f.time_sec, count(DISTINCT p.hand) AS hands, min(p.hand) AS label FROM frames f LEFT JOIN points p USING (song_id, frame_idx) GROUP BY ALL), w AS (SELECT song_id, frame_idx, hand, avg(wi) AS wi FROM points WHERE finger = 6 GROUP BY ALL),
    u AS (SELECT h.*, n.wi AS nwi FROM h JOIN notes n ON n.song_id = h.song_id AND h.time_sec >= n.start_sec - 0.03::DOUBLE AND h.time_sec <= n.start_sec + n.duration_sec + 0.03::DOUBLE WHERE hands < 2
      AND NOT EXISTS (SELECT 1 FROM w WHERE w.song_id = h.song_id AND w.frame_idx = h.frame_idx AND abs(w.wi - n.wi) <= 5))
    SELECT song_id, frame_idx, min(nwi) AS x_min, max(nwi) AS x_max, CASE WHEN max(hands) = 1 THEN max(label) END AS had_label FROM u GROUP BY ALL""")
def recovery_targets(spark, d):
    """Frames with a hand missing where a note sounds that no tracked hand covers."""
    return N.recovery_targets(A.frames(spark, d), A.points(spark, d), A.notes(spark, d))


# --- signals


@query(A.with_tables("notes") + """, b AS (SELECT song_id, trunc(start_sec / 0.05::DOUBLE)::INTEGER AS bin FROM notes WHERE start_sec >= 0),
    r AS (SELECT song_id, unnest(range(max(bin) + 1)) AS bin FROM b GROUP BY song_id)
    SELECT r.song_id, r.bin::INTEGER AS bin, count(b.bin) AS n FROM r LEFT JOIN b ON b.song_id = r.song_id AND b.bin = r.bin GROUP BY ALL""")
def onset_density(spark, d):
    """Histogram of each song's onsets up to its last one, empty bins too."""
    return signal.onset_density(A.notes(spark, d), K, "start_sec")


@query(A.with_tables("notes") + """, p AS (SELECT song_id, trunc(start_sec / 0.05::DOUBLE)::INTEGER AS bin, count(*) AS n FROM notes WHERE hand = 'L' GROUP BY ALL), o AS (SELECT song_id, trunc(start_sec / 0.05::DOUBLE)::INTEGER AS bin, count(*) AS n FROM notes WHERE hand = 'R' GROUP BY ALL),
    s AS (SELECT song_id, shift FROM (SELECT song_id FROM p INTERSECT SELECT song_id FROM o) CROSS JOIN (SELECT unnest(range(-100, 101)) AS shift)),
    t AS (SELECT s.song_id, s.shift, coalesce(sum(p.n * o.n), 0) AS score FROM s LEFT JOIN (p JOIN o USING (song_id)) ON p.song_id = s.song_id AND p.bin = o.bin + s.shift GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, shift) AS k FROM t)
    SELECT a.song_id, coalesce(r.shift * 0.05::DOUBLE, 0) AS offset_sec, r.score::BIGINT AS score FROM (SELECT DISTINCT song_id FROM notes) a LEFT JOIN r ON r.song_id = a.song_id AND r.k = 1""")
def xcorr_offset(spark, d):
    """The shift at which two sets of onsets agree best."""
    n = A.notes(spark, d)
    return signal.estimated_offset(n.where("hand = 'L'").select(*K, "start_sec"), n.where("hand = 'R'").select(*K, "start_sec"), K, "start_sec")


@query(A.with_tables("notes", "frames", "points") + """, g AS (SELECT *, time_sec - lag(time_sec) OVER w AS a, lead(time_sec) OVER w - time_sec AS b, y - lag(y) OVER w AS dy0, lead(y) OVER w - y AS dy1 FROM points WINDOW w AS (PARTITION BY song_id, hand, finger ORDER BY time_sec, frame_idx)),
    v AS (SELECT *, CASE WHEN a IS NULL THEN dy1 / nullif(b, 0) WHEN b IS NULL THEN dy0 / nullif(a, 0) ELSE (b * (dy0 / nullif(a, 0)) + a * (dy1 / nullif(b, 0))) / nullif(a + b, 0) END AS vy FROM g),
    z AS (SELECT *, lag(vy) OVER (PARTITION BY song_id, hand, finger ORDER BY time_sec, frame_idx) AS v0 FROM v) SELECT song_id, hand, finger, time_sec FROM z WHERE v0 > 0 AND vy <= 0 AND b IS NOT NULL""")
def press_moments(spark, d):
    """Moments at which fingers stop moving down."""
    return signal.press_moments(A.points(spark, d), [*K, "hand", "finger"])


@query(A.with_tables("notes") + "SELECT song_id, trunc(quantile_cont(pitch, 0.05))::INTEGER AS low_anchor, trunc(quantile_cont(pitch, 0.95))::INTEGER AS high_anchor, count(*) AS n FROM notes GROUP BY song_id")
def pct_anchors(spark, d):
    """Pitches at the fifth and the ninety-fifth percentile."""
    return signal.percentile_anchors(A.notes(spark, d), K, "pitch")


_SNAP = "(SELECT arg_min(p, abs(p - {a}) * 1000 + p) FROM (SELECT unnest(range(greatest(0, {a} - 6), least(127, {a} + 7))) AS p) WHERE p % 12 IN (0, 9))"


@query(A.with_tables("notes") + f""", a AS (SELECT song_id, trunc(quantile_cont(pitch, 0.05))::INTEGER AS lo, trunc(quantile_cont(pitch, 0.95))::INTEGER AS hi, count(*) AS n FROM notes GROUP BY song_id),
    s AS (SELECT song_id, n, {_SNAP.format(a='lo')} AS sl, {_SNAP.format(a='hi')} AS sh FROM a)
    SELECT song_id, sl::INTEGER AS snapped_low, sh::INTEGER AS snapped_high, CASE WHEN n >= 10 AND sl - 48 = sh - 96 AND abs(sl - 48) IN (12, 24) THEN sl - 48 ELSE 0 END::INTEGER AS shift FROM s""")
def octave_correction(spark, d):
    """The octaves by which a calibration of keys 48 to 96 is off, judged by the notes."""
    return N.octave_shift(signal.percentile_anchors(A.notes(spark, d), K, "pitch"), 48, 96).select(*K, "snapped_low", "snapped_high", "shift")


@query("""WITH d AS (SELECT s_nationkey, s_acctbal AS v, count(*) AS c, sum(s_acctbal) AS s FROM supplier GROUP BY ALL), r AS (SELECT *, sum(c) OVER w AS n0, sum(s) OVER w AS s0, sum(c) OVER (PARTITION BY s_nationkey) AS n, sum(s) OVER (PARTITION BY s_nationkey) AS st, lead(v) OVER w AS nxt FROM d
      WINDOW w AS (PARTITION BY s_nationkey ORDER BY v)), x AS (SELECT *, (n0 / n::DOUBLE) * ((n - n0) / n::DOUBLE) * (s0 / n0 - (st - s0) / (n - n0)) * (s0 / n0 - (st - s0) / (n - n0)) AS var FROM r WHERE nxt IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY var DESC, v) AS k FROM x) SELECT s_nationkey, (v + nxt) / 2 AS threshold, var AS variance FROM b WHERE k = 1""")
def otsu_split(spark, d):
    """The cut between two classes of account balances per nation."""
    return signal.otsu_threshold(read(spark, d, "supplier"), ["s_nationkey"], "s_acctbal")


@query()
def colour_clusters(spark, d):
    """Two clusters of hues per song and the hands they stand for (an iterative operator)."""
    s = A.samples(spark, d).where("time_sec = start_sec").join(A.notes(spark, d).select(*K, "note_idx", "pitch"), [*K, "note_idx"])
    x, y = colour.hue_vector(F.col("r"), F.col("g"), F.col("b"))
    s = s.withColumns({"hx": x, "hy": y})
    c = signal.two_means(s, K, ["hx", "hy"], "note_idx").join(s.select(*K, "note_idx", "pitch"), [*K, "note_idx"])
    return signal.cluster_hands(c, K, "pitch").select(*K, "note_idx", "cluster", "separation", "hand")


# --- colours


_REFS = {"LH_white": (200.0, 50.0, 50.0), "LH_black": (150.0, 30.0, 30.0), "RH_white": (50.0, 50.0, 200.0), "RH_black": (30.0, 30.0, 150.0)}


def _d(rgb) -> str:
    return "sqrt((r - {0}) * (r - {0}) + (g - {1}) * (g - {1}) + (b - {2}) * (b - {2}))".format(*(f"{v}::DOUBLE" for v in rgb))


@query(A.with_tables("notes", "samples") + f""", d AS (SELECT song_id, note_idx, least({_d(_REFS['LH_white'])}, {_d(_REFS['LH_black'])}) AS l, least({_d(_REFS['RH_white'])}, {_d(_REFS['RH_black'])}) AS r FROM samples WHERE time_sec = start_sec)
    SELECT song_id, note_idx, CASE WHEN l <= r THEN 'L' ELSE 'R' END AS hand, CASE WHEN l + r = 0 THEN 1 ELSE greatest(l, r) / (l + r) END AS confidence FROM d""")
def nearest_ref(spark, d):
    """Hands by the nearest of four picked colours."""
    hand, conf = colour.nearest_reference([F.col("r"), F.col("g"), F.col("b")], _REFS)
    return A.samples(spark, d).where("time_sec = start_sec").select(*K, "note_idx", hand.alias("hand"), conf.alias("confidence"))


@query(A.with_tables("notes", "samples") + """,
    d AS (SELECT song_id, note_idx, pitch, s.start_sec, time_sec, 96 + r / 4e0 AS r, 96 + g / 4e0 AS g, 96 + b / 4e0 AS b FROM samples s JOIN notes USING (song_id, note_idx)),
    k AS (SELECT pitch, median(r) AS r, median(g) AS g, median(b) AS b FROM d GROUP BY pitch),
    l AS (SELECT d.*, sqrt((d.r - k.r) ** 2 + (d.g - k.g) ** 2 + (d.b - k.b) ** 2) > 40 AS lit FROM d JOIN k USING (pitch)),
    s AS (SELECT *, bool_or(lit AND time_sec >= start_sec) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
        NOT lit AND NOT coalesce(lead(lit, 1) OVER w, true) AND NOT coalesce(lead(lit, 2) OVER w, true) AS run FROM l WINDOW w AS (PARTITION BY song_id, note_idx ORDER BY time_sec))
    SELECT song_id, note_idx, min(time_sec) FILTER (seen AND run) AS lit_end FROM s GROUP BY ALL""")
def lit_ends(spark, d):
    """When lit keys go dark: three samples in a row near the key's own unlit colour after the first lit one."""
    s = A.samples(spark, d).join(A.notes(spark, d).select(*K, "note_idx", "pitch"), [*K, "note_idx"])
    s = s.withColumns({c: 96 + F.col(c) / 4.0 for c in "rgb"})
    return N.lit_end(s, N.key_baselines(s))


@query(A.with_tables("notes", "samples") + "SELECT pitch, median(r) AS r, median(g) AS g, median(b) AS b FROM samples JOIN notes USING (song_id, note_idx) GROUP BY pitch")
def key_baselines(spark, d):
    """Median colour per key."""
    return N.key_baselines(A.samples(spark, d).join(A.notes(spark, d).select(*K, "note_idx", "pitch"), [*K, "note_idx"]))


@query(A.with_tables("notes") + """, e AS (SELECT song_id, note_idx, duration_sec, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0.5::DOUBLE * duration_sec ELSE 0.01::DOUBLE END AS lit FROM notes)
    SELECT song_id, note_idx, CASE WHEN lit IS NULL OR least(duration_sec, lit) < 0.05 THEN duration_sec ELSE least(duration_sec, lit) END AS duration_sec FROM e""")
def trim_durations(spark, d):
    """Durations cut where the key goes dark, never below a twentieth of a second."""
    n = A.notes(spark, d).withColumn("lit", F.when(F.col("event_id") % 3 == 1, 0.5 * F.col("duration_sec")).when(F.col("event_id") % 3 == 2, 0.01))
    return n.select(*K, "note_idx", N.trimmed_duration(F.col("duration_sec"), F.col("lit")).alias("duration_sec"))


# --- matching and scores


@query(A.with_tables("notes", "frames", "points") + _CLUSTER.format(tol=0.03) + ", q AS (SELECT song_id, cluster AS query_id, min(start_sec) AS q_at FROM c JOIN notes USING (song_id, note_idx) GROUP BY ALL)"
    + _TIPS.format(x="p.wi", y="0e0") + """,
    cand AS (SELECT *, row_number() OVER (PARTITION BY song_id, query_id ORDER BY hand, finger) AS cand_pos FROM tips),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY song_id, cluster ORDER BY d, note_pos, cand_pos) AS r FROM (
      SELECT c.song_id, c.cluster, c.note_idx AS note_pos, t.cand_pos, t.hand, t.finger, abs(n.wi - t.x) AS d FROM c JOIN notes n USING (song_id, note_idx) JOIN cand t ON t.song_id = c.song_id AND t.query_id = c.cluster)),
    fold AS (SELECT DISTINCT song_id, cluster, 0::BIGINT AS r, []::BIGINT[] AS ns, []::BIGINT[] AS cs, false AS taken FROM pairs UNION ALL
      SELECT song_id, cluster, r, CASE WHEN free THEN list_append(ns, note_pos) ELSE ns END, CASE WHEN free THEN list_append(cs, cand_pos) ELSE cs END, free
      FROM (SELECT p.song_id, p.cluster, p.r, p.note_pos, p.cand_pos, f.ns, f.cs, NOT list_contains(f.ns, p.note_pos) AND NOT list_contains(f.cs, p.cand_pos) AS free
        FROM fold f JOIN pairs p ON p.song_id = f.song_id AND p.cluster = f.cluster AND p.r = f.r + 1))
    SELECT song_id, cluster, note_pos, cand_pos, hand, finger, d AS distance, exp(-d / 0.8::DOUBLE) AS confidence, len(f.ns) - 1 AS pick_rank FROM fold f JOIN pairs p USING (song_id, cluster, r) WHERE f.taken""")
def greedy_chords(spark, d):
    """One-to-one matches of chords' notes and fingertips (a greedy fold)."""
    c = timeline.anchored_clusters(A.notes(spark, d), K, "start_sec", ["note_idx"], 0.03)
    at = c.groupBy(*K, "cluster").agg(F.min("start_sec").alias("at")).withColumnRenamed("cluster", "query_id")
    tips = timeline.interpolated_points(at, A.frames(spark, d).select(*K, "frame_idx", "time_sec"), A.points(spark, d).select(*K, "frame_idx", "hand", "finger", F.col("wi").alias("x"), F.lit(0.0).alias("y")))
    tips = tips.withColumnRenamed("query_id", "cluster").withColumn("cand_pos", F.row_number().over(Window.partitionBy(*K, "cluster").orderBy("hand", "finger")))
    notes = c.select(*K, "cluster", F.col("note_idx").alias("note_pos"), F.col("wi").alias("nx"), F.lit(0.0).alias("ny"))
    m = matching.chord_matches(notes, tips, [*K, "cluster"], 0.8)
    return m.withColumns({c: F.col(c).cast("long") for c in ("cluster", "cand_pos", "pick_rank")})


def _truth_and_pred(spark, d):
    n = A.notes(spark, d)
    truth = n.select(*K, "pitch", F.col("note_idx").alias("pos"), F.col("start_sec").alias("onset_sec"), "hand", music.playable_finger(F.col("finger")).alias("finger"))
    wrong = (F.col("pitch") + (F.col("event_id") % 3 == 0).cast("int")).alias("pitch")
    pred = n.select(*K, wrong, F.col("note_idx").alias("pos"), (F.col("start_sec") + 0.04).alias("onset_sec"), F.when(F.col("event_id") % 5 == 0, "L").otherwise(F.col("hand")).alias("hand"), "finger")
    return truth, pred


#: Truth notes with what they are matched to, as m.
_MATCH = """,
    t AS (SELECT song_id, pitch, note_idx AS pos, start_sec AS onset_sec, hand, CASE WHEN finger BETWEEN 1 AND 5 THEN finger END AS finger, row_number() OVER (PARTITION BY song_id, pitch ORDER BY note_idx) AS r
      FROM notes),
    p AS (SELECT song_id, pitch + (event_id % 3 = 0)::INTEGER AS pitch, note_idx AS pos, start_sec + 0.04::DOUBLE AS onset_sec, CASE WHEN event_id % 5 = 0 THEN 'L' ELSE hand END AS hand, finger FROM notes),
    near AS (SELECT t.song_id, t.pitch, t.r, list(p.pos ORDER BY abs(p.onset_sec - t.onset_sec), p.pos) FILTER (p.pos IS NOT NULL) AS ps
      FROM t LEFT JOIN p ON p.song_id = t.song_id AND p.pitch = t.pitch AND abs(p.onset_sec - t.onset_sec) <= 0.1::DOUBLE GROUP BY ALL),
    fold AS (SELECT DISTINCT song_id, pitch, 0::BIGINT AS r, []::BIGINT[] AS used, NULL::BIGINT AS got FROM t UNION ALL
      SELECT song_id, pitch, r, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got
      FROM (SELECT n.song_id, n.pitch, n.r, f.used, list_filter(coalesce(n.ps, []), lambda x: NOT list_contains(f.used, x))[1] AS got
        FROM fold f JOIN near n ON n.song_id = f.song_id AND n.pitch = f.pitch AND n.r = f.r + 1)),
    m AS (SELECT t.song_id, t.pitch, t.pos, t.onset_sec, t.hand, t.finger, f.got AS pred_pos, p.onset_sec AS pred_onset_sec, p.hand AS pred_hand, p.finger AS pred_finger
      FROM t JOIN fold f USING (song_id, pitch, r) LEFT JOIN p ON p.song_id = t.song_id AND p.pitch = t.pitch AND p.pos = f.got)"""


@query(A.with_tables("notes") + _MATCH + "SELECT * FROM m")
def greedy_match(spark, d):
    """Truth notes with their nearest predictions, each used once (a greedy fold)."""
    return matching.joined_notes(*_truth_and_pred(spark, d), K)


@query(A.with_tables("notes") + _MATCH + """,
    n AS (SELECT coalesce(song_id, 'all') AS song_id, count(*) AS labeled, count(pred_hand) AS matched, count(*) FILTER (hand = pred_hand) AS hand_correct, count(*) FILTER (hand = 'R' AND pred_hand = 'L') AS r_as_l,
      count(*) FILTER (hand = 'L' AND pred_hand = 'R') AS l_as_r, count(*) FILTER (pred_hand IS NOT NULL AND finger IS NOT NULL) AS finger_labeled, count(*) FILTER (pred_hand IS NOT NULL AND finger = pred_finger) AS finger_correct
      FROM m GROUP BY ROLLUP (song_id))
    SELECT *, matched / labeled::DOUBLE AS coverage, coalesce(hand_correct / nullif(matched, 0)::DOUBLE, 0) AS hand_accuracy, coalesce(finger_correct / nullif(finger_labeled, 0)::DOUBLE, 0) AS finger_accuracy FROM n""")
def benchmark_scores(spark, d):
    """Predictions matched to corrected notes and scored, per song and over all."""
    return benchmark.scored(*_truth_and_pred(spark, d), K)


@query("""WITH p AS (SELECT doc_id, source, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT coalesce(source, '?') AS source, count(*) AS labeled, count(*) FILTER (quality = 1) AS matched, count(*) FILTER (quality = 1 AND toxic = 1) AS hand_correct,
      count(*) FILTER (quality = 1 AND toxic = 0) AS r_as_l FROM p GROUP BY ROLLUP (source))
    SELECT CASE WHEN labeled = (SELECT count(*) FROM p) THEN 'all' ELSE source END AS source, labeled, matched, hand_correct, r_as_l, matched / labeled::DOUBLE AS coverage, coalesce(hand_correct / nullif(matched, 0)::DOUBLE, 0) AS hand_accuracy FROM c""")
def score_rollup(spark, d):
    """Counts and shares per source and over all, counts summed before they are divided."""
    p = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source")), "doc_id")
    p = p.select("source", F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "R").otherwise("L")).alias("pred_hand"), F.lit("R").alias("hand"), F.lit(None).cast("int").alias("finger"), F.lit(None).cast("int").alias("pred_finger"))
    return matching.scores(p, ["source"], "all").select("source", "labeled", "matched", "hand_correct", "r_as_l", "coverage", "hand_accuracy")


@query("""SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source""")
def first_seen_dedup(spark, d):
    """The first document of each source."""
    return timeline.first_seen(read(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("""WITH s AS (SELECT page_id AS pos, url, split_part(split_part(url, '//', 2), '/', 1) AS channel, page_id % 4 = 0 AS saved FROM pages), f AS (SELECT *, bool_or(saved) OVER (PARTITION BY channel) AS has, row_number() OVER (PARTITION BY channel ORDER BY pos) AS k FROM s)
    SELECT pos, url, CASE WHEN NOT has AND k = 1 THEN 'manual' ELSE 'reuse' END AS plan FROM f""")
def plan_first_manual(spark, d):
    """The first source of a channel without stored settings is set up by hand, all others reuse them."""
    channel = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    s = read(spark, d, "pages").select(F.col("page_id").alias("pos"), "url", channel.alias("channel"), (F.col("page_id") % 4 == 0).alias("saved"))
    return N.first_manual(s).select("pos", "url", "plan")


@query(A.with_tables("notes") + """, t AS (SELECT song_id, onset_tick, pitch, min((event_id % 5) / 4e0) AS share FROM notes GROUP BY ALL) SELECT n.song_id, n.note_idx, n.onset_tick, greatest(n.onset_tick + 1, least(n.onset_tick + 480, n.onset_tick + (share * 480)::BIGINT)) AS off_tick
    FROM notes n JOIN t USING (song_id, onset_tick, pitch)""")
def trimmed_ticks(spark, d):
    """Note-off ticks moved earlier to a share of the note's span, from none to all of it."""
    n = A.notes(spark, d)
    t = n.groupBy(*K, "onset_tick", "pitch").agg(F.min((F.col("event_id") % 5) / F.lit(4.0)).alias("share"))
    from ..sources.midi import trimmed_off

    out = n.join(t, [*K, "onset_tick", "pitch"], "left")
    return out.select(*K, "note_idx", "onset_tick", trimmed_off(F.col("onset_tick"), F.col("onset_tick") + 480, F.col("share")).alias("off_tick"))
