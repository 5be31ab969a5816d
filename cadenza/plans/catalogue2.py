"""More registered queries: keyboards, colours, blobs, sources, and relational coverage of the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music, text
from ..operators import keyboard, timeline
from ..operators import notes as N
from ..sources import media
from . import analogue as A
from .catalogue import _REFS, ORACLE, QUERIES, K, _d, query, read  # noqa: F401


@query("""WITH s AS (SELECT page_id AS pos, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url, CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'v' || (page_id % 40)::VARCHAR END AS id, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'c' || (page_id % 5)::VARCHAR END AS channel_id, 'u' || (page_id % 7)::VARCHAR AS uploader_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 't' END AS title FROM pages),
    n AS (SELECT pos, coalesce(nullif(url, ''), 'https://www.youtube.com/watch?v=' || nullif(id, '')) AS url, coalesce(nullif(channel_id, ''), nullif(uploader_id, '')) AS channel_id, coalesce(title, '') AS title FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS k FROM n WHERE url IS NOT NULL) SELECT pos, url, channel_id, title FROM r WHERE k = 1""")
def expand_sources(spark, d):
    """Source entries made whole, each address once."""
    p, n = read(spark, d, "pages"), lambda m: (F.col("page_id") % m).cast("string")
    e = p.select(
        F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 6 != 0, F.concat(F.lit("v"), n(40))).alias("id"),
        F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("c"), n(5))).alias("channel_id"), F.concat(F.lit("u"), n(7)).alias("uploader_id"), F.when(F.col("page_id") % 4 != 0, "t").alias("title"))
    return media.expanded_sources(e)


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=a' || page_id::VARCHAR || '&list=x&t=3' WHEN 1 THEN 'https://youtu.be/b' || page_id::VARCHAR || '?t=3' ELSE url || '&k=1' END AS u FROM pages)
    SELECT page_id, CASE WHEN contains(u, 'youtube.com') THEN split_part(u, '&', 1) WHEN contains(u, 'youtu.be') THEN split_part(u, '?', 1) ELSE u END AS clean, trim(CASE WHEN page_id % 2 = 0 THEN '{' || u || '}' ELSE u END, '{}') AS path, printf('%.1f%%', (page_id % 100)::DOUBLE) AS pct FROM p""")
def clean_urls(spark, d):
    """Addresses without list parameters, dropped paths without braces, shares as percentages."""
    i = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=a"), i, F.lit("&list=x&t=3"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/b"), i, F.lit("?t=3"))).otherwise(F.concat("url", F.lit("&k=1")))
    p = read(spark, d, "pages").select("page_id", u.alias("u"))
    braced = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("{"), "u", F.lit("}"))).otherwise(F.col("u"))
    return p.select("page_id", text.watch_url(F.col("u")).alias("clean"), text.unbraced(braced).alias("path"), text.percent((F.col("page_id") % 100) / F.lit(100.0)).alias("pct"))


@query("""WITH c AS (SELECT s_suppkey, (s_suppkey % 9)::DOUBLE AS dx, 1500 + (s_suppkey % 3)::DOUBLE * 10 AS w FROM supplier), k AS (SELECT unnest([48, 60, 72, 84]) AS p),
    x AS (SELECT s_suppkey, 100 + (7 * (p // 12) - 28) / 21e0 * 1500 AS sx, 100 + dx + (7 * (p // 12) - 28) / 21e0 * w AS fx, w / 21 AS key FROM c, k)
    SELECT s_suppkey, bool_and(abs(sx - fx) <= 0.15::DOUBLE * key) AS agree FROM x GROUP BY s_suppkey""")
def calibration_agreement(spark, d):
    """Whether stored calibrations of keys 48 to 84 still fit fresh ones."""
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9).cast("double").alias("dx"), (1500 + (F.col("s_suppkey") % 3).cast("double") * 10).alias("w"))
    saved = lambda p: 100 + music.normal_x(p, 48, 84) * 1500
    fresh = lambda p: 100 + F.col("dx") + music.normal_x(p, 48, 84) * F.col("w")
    return s.select("s_suppkey", keyboard.calibrations_agree(s, saved, fresh, 48, 84).alias("agree"))


def _hue(r: str, g: str, b: str) -> str:
    return f"atan2(({g} - {b}) * sqrt(3e0) / 2, {r} - ({g} + {b}) / 2e0)"


@query(A.with_tables("notes", "samples") + f""", h AS (SELECT song_id, {_hue('r', 'g', 'b')} AS a FROM samples), t AS (SELECT {_hue('200e0', '50e0', '50e0')} AS l, {_hue('50e0', '50e0', '200e0')} AS r)
    SELECT song_id, bool_or(sqrt((cos(a) - cos(l)) ** 2 + (sin(a) - sin(l)) ** 2) <= 2 * sin(radians(25e0) / 2)) AND bool_or(sqrt((cos(a) - cos(r)) ** 2 + (sin(a) - sin(r)) ** 2) <= 2 * sin(radians(25e0) / 2)) AS agree FROM h, t GROUP BY song_id""")
def colour_agreement(spark, d):
    """Whether both stored hand colours occur among a song's samples."""
    return keyboard.colours_agree(A.samples(spark, d), K, {"LH_white": (200.0, 50.0, 50.0), "RH_white": (50.0, 50.0, 200.0)})


def _centroids(spark, d):
    """Black keys 37 to 70 as seen for each nation, with a little noise that tells nations apart."""
    keys = F.filter(F.sequence(F.lit(37), F.lit(70)), lambda p: F.pmod(p, F.lit(12)).isin(*music.BLACK))
    n = read(spark, d, "nation").select("n_nationkey", F.posexplode(keys).alias("idx", "pitch"))
    return n.select("n_nationkey", "idx", "pitch", (music.white_index(F.col("pitch")) * 40 + (F.col("n_nationkey") * (F.col("idx") + 3)) % 7).alias("x"), F.lit(300.0).alias("y"))


_CENTROIDS = """c AS (SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY p) - 1 AS idx, p AS pitch, ([0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6][p % 12 + 1]::DOUBLE + 7 * (p // 12) + 7e-1) * 40 AS x0 FROM nation, (SELECT unnest(range(37, 71)) AS p) WHERE p % 12 IN (1, 3, 6, 8, 10)),
    g AS (SELECT n_nationkey, idx, pitch, x0 + (n_nationkey * (idx + 3)) % 7 AS x FROM c), d AS (SELECT *, x - lag(x) OVER (PARTITION BY n_nationkey ORDER BY idx) AS gap FROM g),
    v AS (SELECT n_nationkey, gap AS v, count(*) AS c, sum(gap) AS s FROM d WHERE gap IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(c) OVER w AS n0, sum(s) OVER w AS s0, sum(c) OVER (PARTITION BY n_nationkey) AS n, sum(s) OVER (PARTITION BY n_nationkey) AS st, lead(v) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY n_nationkey ORDER BY v)),
    b AS (SELECT n_nationkey, arg_max((v + nxt) / 2, (n0 / n::DOUBLE) * ((n - n0) / n::DOUBLE) * (s0 / n0 - (st - s0) / (n - n0)) ** 2) AS cut FROM r WHERE nxt IS NOT NULL GROUP BY n_nationkey),
    k AS (SELECT d.*, sum(CASE WHEN gap > cut THEN 1 ELSE 0 END) OVER (PARTITION BY n_nationkey ORDER BY idx) AS grp FROM d JOIN b USING (n_nationkey))"""


def _grouped(spark, d):
    return keyboard.key_groups(keyboard.large_gaps(_centroids(spark, d), ["n_nationkey"]), ["n_nationkey"])


@query(f"WITH {_CENTROIDS} SELECT n_nationkey, idx, grp::BIGINT AS grp FROM k")
def black_key_groups(spark, d):
    """Groups of black keys, cut at large gaps."""
    return _grouped(spark, d).select("n_nationkey", F.col("idx").cast("long").alias("idx"), F.col("grp").cast("long").alias("grp"))


@query(f"WITH {_CENTROIDS} SELECT n_nationkey, grp::INTEGER AS grp, count(*)::INTEGER AS size, min(pitch)::INTEGER AS first FROM k GROUP BY ALL")
def group_alignment(spark, d):
    """The pitches that the detected groups stand for (the true ones, if the alignment is right)."""
    g = _grouped(spark, d).groupBy("n_nationkey", "grp").agg(F.count("*").alias("size"))
    a = keyboard.aligned_groups(g, ["n_nationkey"], 36, 96)
    return a.select("n_nationkey", "grp", "size", F.element_at("pitches", 1).alias("first"))


@query()
def keyboard_rows(spark, d):
    """Row maps fitted to aligned groups (least squares per keyboard)."""
    c = _grouped(spark, d)
    a = keyboard.aligned_groups(c.groupBy("n_nationkey", "grp").agg(F.count("*").alias("size")), ["n_nationkey"], 36, 96)
    p = keyboard.anchor_points(c.drop("pitch"), a, ["n_nationkey"], 36, 96)
    fit = keyboard.row_fits(p, ["n_nationkey"])
    return fit.select("n_nationkey", *(F.round(F.element_at("row", i + 1), 6).alias(n) for i, n in enumerate("abcde")))


_SOUND = "s AS (SELECT DISTINCT f.song_id, f.frame_idx, n.pitch FROM frames f JOIN notes n ON n.song_id = f.song_id AND f.time_sec >= n.start_sec - 0.03::DOUBLE AND f.time_sec <= n.start_sec + n.duration_sec + 0.03::DOUBLE)"
_SPLIT = _SOUND + """, g AS (SELECT *, lead(pitch) OVER w AS nxt, min(pitch) OVER (PARTITION BY song_id, frame_idx) AS lo, max(pitch) OVER (PARTITION BY song_id, frame_idx) AS hi FROM s WINDOW w AS (PARTITION BY song_id, frame_idx ORDER BY pitch)),
    b AS (SELECT *, row_number() OVER (PARTITION BY song_id, frame_idx ORDER BY nxt - pitch DESC, pitch) AS k FROM g WHERE nxt IS NOT NULL),
    sp AS (SELECT song_id, frame_idx, pitch AS cut_low, nxt AS cut_high, lo AS low_min, hi AS high_max FROM b WHERE k = 1 AND hi - lo > 15 AND nxt - pitch >= 15 AND pitch - lo <= 20 AND hi - nxt <= 20)"""


def _sounding(spark, d):
    n = A.notes(spark, d).select(*K, "pitch", (F.col("start_sec") - 0.03).alias("lo"), (F.col("start_sec") + F.col("duration_sec") + 0.03).alias("hi"))
    return timeline.range_join(A.frames(spark, d).select(*K, "frame_idx", "time_sec"), n, K, "time_sec", "lo", "hi", 1.0).select(*K, "frame_idx", "pitch")


@query(A.with_tables("notes", "frames") + ", " + _SPLIT + " SELECT * FROM sp")
def split_points(spark, d):
    """Where sounding pitches part into two hands."""
    return keyboard.hand_splits(_sounding(spark, d), [*K, "frame_idx"])


def _white(p: str) -> str:
    return f"([0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6][{p} % 12 + 1]::DOUBLE + 7 * ({p} // 12) + CASE WHEN {p} % 12 IN (1, 3, 6, 8, 10) THEN 7e-1 ELSE 0e0 END)"


@query(A.with_tables("notes", "frames", "points") + ", " + _SPLIT + f""", h AS (SELECT song_id, frame_idx, min(hand) AS hand, avg(wi) AS wi FROM points WHERE finger = 6 GROUP BY ALL HAVING count(*) = 1),
    m AS (SELECT h.*, cut_low, cut_high, h.wi <= {_white('round_even((cut_low + cut_high) / 2e0, 0)::INTEGER')} AS low FROM h JOIN sp USING (song_id, frame_idx))
    SELECT song_id, frame_idx, CASE WHEN hand = 'L' THEN 'R' ELSE 'L' END AS hand, {_white('round_even(avg(s.pitch), 0)::INTEGER')} AS wi FROM m JOIN s USING (song_id, frame_idx) WHERE CASE WHEN low THEN s.pitch >= cut_high ELSE s.pitch <= cut_low END GROUP BY ALL""")
def merged_hands(spark, d):
    """Hands to add where one tracked hand can't play what sounds."""
    s, keys = _sounding(spark, d), [*K, "frame_idx"]
    one = A.points(spark, d).where("finger = 6").groupBy(*keys).agg(F.count("*").alias("n"), F.min("hand").alias("hand"), F.avg("wi").alias("wi")).where("n = 1").drop("n")
    return keyboard.missing_hands(one, s, keyboard.hand_splits(s, keys), keys)


_BLOBS = """bl AS (SELECT song_id, note_idx * 2 // 3 AS frame_idx, (event_id * 17 % 1000)::DOUBLE AS cx, (event_id * 23 % 997)::DOUBLE AS area, (event_id * 17 % 1000)::DOUBLE - 60 AS x, (100 + event_id * 7 % 500)::DOUBLE AS w, CASE WHEN event_id % 4 = 0 THEN (event_id * 17 % 1000)::DOUBLE + 5 END AS valley, event_id FROM notes)"""


def _blobs(spark, d):
    n = A.notes(spark, d)
    cx = ((F.col("event_id") * 17) % 1000).cast("double")
    return n.select(*K, F.expr("note_idx * 2 DIV 3").alias("frame_idx"), cx.alias("cx"), ((F.col("event_id") * 23) % 997).cast("double").alias("area"), (cx - 60).alias("x"), (100 + (F.col("event_id") * 7) % 500).cast("double").alias("w"), F.when(F.col("event_id") % 4 == 0, cx + 5).alias("valley"))


@query(A.with_tables("notes") + ", " + _BLOBS + """, r AS (SELECT *, row_number() OVER (PARTITION BY song_id, frame_idx ORDER BY area DESC, cx) AS k FROM bl), f AS (SELECT song_id, frame_idx, count(*) AS n, min(cx) AS lo, max(cx) AS hi, max(cx) FILTER (k = 1) AS c1, max(x) FILTER (k = 1) AS x1, max(w) FILTER (k = 1) AS w1, max(valley) FILTER (k = 1) AS v1 FROM r WHERE k <= 2 GROUP BY ALL),
    l AS (SELECT *, last_value(CASE WHEN n = 2 THEN lo END IGNORE NULLS) OVER w AS pl, last_value(CASE WHEN n = 2 THEN hi END IGNORE NULLS) OVER w AS pr FROM f WINDOW w AS (PARTITION BY song_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, coalesce(v1, (pl + pr) / 2, x1 + w1 / 2) AS cut, CASE WHEN pl IS NOT NULL AND pr IS NOT NULL THEN abs(c1 - pl) <= abs(c1 - pr) ELSE c1 < 500 END AS isl FROM l)
    SELECT song_id, frame_idx, CASE WHEN n = 2 THEN lo WHEN w1 >= 420 THEN (x1 + cut) / 2 WHEN isl THEN c1 END AS lx, CASE WHEN n = 2 THEN hi WHEN w1 >= 420 THEN (cut + x1 + w1) / 2 WHEN NOT isl THEN c1 END AS rx FROM c""")
def blob_hands(spark, d):
    """Coarse hands from blobs, with what earlier frames showed."""
    return keyboard.blob_hands(_blobs(spark, d), K, 1000.0)


_TRACKED = "tr AS (SELECT song_id, frame_idx, hand, x FROM points WHERE finger = 6)"


def _tracked(spark, d):
    return A.points(spark, d).where("finger = 6").select(*K, "frame_idx", "hand", "x")


@query(A.with_tables("notes", "frames", "points") + ", " + _BLOBS + ", " + _TRACKED + """,
    b AS (SELECT *, row_number() OVER (PARTITION BY song_id, frame_idx ORDER BY area DESC, cx) AS k FROM bl),
    f AS (SELECT song_id, frame_idx, count(*) AS n, min(cx) AS lo, max(cx) AS hi, max(cx) FILTER (k = 1) AS c1, max(x) FILTER (k = 1) AS x1, max(w) FILTER (k = 1) AS w1, max(valley) FILTER (k = 1) AS v1 FROM b WHERE k <= 2 GROUP BY ALL),
    t AS (SELECT song_id, frame_idx, count(*) AS seen, min(x) AS tl, max(x) AS th FROM tr GROUP BY ALL),
    j AS (SELECT song_id, frame_idx, f.* EXCLUDE (song_id, frame_idx), seen, CASE WHEN seen >= 2 THEN tl END AS tl, CASE WHEN seen >= 2 THEN th END AS th FROM f FULL JOIN t USING (song_id, frame_idx)),
    l AS (SELECT *, last_value(tl IGNORE NULLS) OVER w AS pl, last_value(th IGNORE NULLS) OVER w AS pr FROM j WINDOW w AS (PARTITION BY song_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, coalesce(v1, (pl + pr) / 2, x1 + w1 / 2) AS cut, CASE WHEN pl IS NOT NULL AND pr IS NOT NULL THEN abs(c1 - pl) <= abs(c1 - pr) ELSE c1 < 500 END AS isl FROM l WHERE n IS NOT NULL AND coalesce(seen, 0) < 2),
    h AS (SELECT song_id, frame_idx, 'L' AS hand, CASE WHEN n = 2 THEN lo WHEN w1 >= 420 THEN (x1 + cut) / 2 WHEN isl THEN c1 END AS x FROM c
      UNION ALL SELECT song_id, frame_idx, 'R', CASE WHEN n = 2 THEN hi WHEN w1 >= 420 THEN (cut + x1 + w1) / 2 WHEN NOT isl THEN c1 END FROM c),
    g AS (SELECT * FROM h WHERE x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.song_id = h.song_id AND tr.frame_idx = h.frame_idx AND abs(tr.x - h.x) < 80))
    SELECT song_id, frame_idx, arg_min(hand, hand) AS hand, arg_min(x, hand) AS x FROM g GROUP BY ALL""")
def blob_additions(spark, d):
    """One coarse hand from blobs in frames that track fewer than two."""
    t = _tracked(spark, d)
    return N.added_hands(keyboard.blob_hands(_blobs(spark, d), K, 1000.0, tracked=t), t)


_RECOVERED = """rc AS (SELECT song_id, note_idx AS frame_idx, 0 AS pos, 'L' AS hand, (event_id * 31 % 900)::DOUBLE AS x FROM notes
      UNION ALL SELECT song_id, note_idx, 1, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END, ((event_id * 31 + event_id % 11 * 20) % 900)::DOUBLE FROM notes)"""


@query(A.with_tables("notes", "frames", "points") + ", " + _RECOVERED + ", " + _TRACKED + """,
    far AS (SELECT * FROM rc WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.song_id = rc.song_id AND tr.frame_idx = rc.frame_idx AND abs(tr.x - rc.x) < 60)),
    kept AS (SELECT * FROM far b WHERE pos = 0 OR NOT EXISTS (SELECT 1 FROM far a WHERE a.song_id = b.song_id AND a.frame_idx = b.frame_idx AND a.pos = 0 AND abs(a.x - b.x) < 60)),
    own AS (SELECT song_id, frame_idx, count(*) AS n, min(hand) AS label FROM tr GROUP BY ALL)
    SELECT song_id, frame_idx, pos, CASE WHEN n = 1 AND row_number() OVER (PARTITION BY song_id, frame_idx ORDER BY pos) = 1 THEN CASE WHEN label = 'L' THEN 'R' ELSE 'L' END ELSE hand END AS hand, x FROM kept LEFT JOIN own USING (song_id, frame_idx)""")
def recovered_hands(spark, d):
    """Hands of a second look that the first lacks."""
    return N.merged_recoveries(_found(spark, d), _tracked(spark, d))


def _found(spark, d):
    """Two hands that a second look found in each frame."""
    n = A.notes(spark, d)
    found = [
        F.struct(F.lit(0).alias("pos"), F.lit("L").alias("hand"), ((F.col("event_id") * 31) % 900).cast("double").alias("x")),
        F.struct(F.lit(1).alias("pos"), F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("hand"), ((F.col("event_id") * 31 + F.col("event_id") % 11 * 20) % 900).cast("double").alias("x")),
    ]
    return n.select(*K, F.col("note_idx").alias("frame_idx"), F.explode(F.array(*found)).alias("f")).select(*K, "frame_idx", "f.*")


@query(A.with_tables("notes") + """, e AS (SELECT song_id, note_idx AS i, (event_id * 37 % 101)::DOUBLE AS strength FROM notes), o AS (SELECT song_id, start_sec AS t FROM notes), p AS (SELECT song_id, max(strength) AS peak, max(i) AS last FROM e GROUP BY song_id),
    j AS (SELECT o.song_id, o.t, e.strength, p.peak FROM o JOIN p USING (song_id) LEFT JOIN e ON e.song_id = o.song_id AND e.i = least(ceil(o.t / 0.25::DOUBLE - 0.5::DOUBLE), p.last)::BIGINT)
    SELECT song_id, coalesce(min(t) FILTER (strength >= 0.3::DOUBLE * peak), min(t)) AS onset FROM j GROUP BY song_id""")
def first_significant_onset(spark, d):
    """The first onset that is loud enough."""
    n = A.notes(spark, d)
    e = n.select(*K, F.col("note_idx").alias("i"), ((F.col("event_id") * 37) % 101).cast("double").alias("strength"))
    return keyboard.significant_onset(n.select(*K, F.col("start_sec").alias("t")), e, K, step=0.25)


@query(A.with_tables("notes") + """, m AS (SELECT song_id, note_idx // 50 AS blob, 100 + (note_idx // 50 % 7) * 30 AS x0, 100 + (note_idx // 50 % 7) * 30 + 50 AS x1, note_idx % 50 AS k, (event_id * 41 % 60)::INTEGER AS n FROM notes), b AS (SELECT *, row_number() OVER (PARTITION BY song_id, blob ORDER BY n, k) AS r FROM m WHERE k >= 10 AND k < 40)
    SELECT a.song_id, a.blob, max(x0 + k) FILTER (r = 1) AS valley FROM (SELECT DISTINCT song_id, blob FROM m) a LEFT JOIN b ON b.song_id = a.song_id AND b.blob = a.blob GROUP BY ALL""")
def blob_valleys(spark, d):
    """The seam of two touching hands: the emptiest inner column."""
    n = A.notes(spark, d).withColumn("blob", F.expr("note_idx DIV 50"))
    x0 = 100 + (F.col("blob") % 7) * 30
    m = n.select(*K, "blob", x0.alias("x0"), (x0 + 50).alias("x1"), (x0 + F.col("note_idx") % 50).alias("x"), ((F.col("event_id") * 41) % 60).cast("int").alias("n"))
    return keyboard.split_columns(m, [*K, "blob"])


@query("""WITH s AS (SELECT 'k' || (c_custkey % 50)::VARCHAR AS key, min(c_acctbal) AS saved FROM customer GROUP BY ALL), f AS (SELECT 'k' || (s_suppkey % 30)::VARCHAR AS key, max(s_acctbal) AS fresh FROM supplier GROUP BY ALL)
    SELECT coalesce(s.key, f.key) AS key, coalesce(f.fresh, s.saved) AS value FROM s FULL JOIN f ON s.key = f.key""")
def settings_upsert(spark, d):
    """Stored settings replaced by fresh ones of the same key."""
    s = read(spark, d, "customer").groupBy(F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string")).alias("key")).agg(F.min("c_acctbal").alias("value"))
    f = read(spark, d, "supplier").groupBy(F.concat(F.lit("k"), (F.col("s_suppkey") % 30).cast("string")).alias("key")).agg(F.max("s_acctbal").alias("value"))
    return media.upserted(s, f)


@query("""WITH s AS (SELECT s_suppkey AS key, s_acctbal AS v FROM supplier), f AS (SELECT s_suppkey AS key, s_suppkey % 2 = 0 AS agree FROM supplier WHERE s_suppkey % 3 = 0) SELECT s.key, s.v FROM s LEFT JOIN f USING (key) WHERE f.key IS NULL OR f.agree""")
def trusted_settings(spark, d):
    """Stored settings that no fresh reading contradicts."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v"))
    f = s.where("key % 3 = 0").select("key")
    return media.trusted(s, f, f.select("key", (F.col("key") % 2 == 0).alias("agree")))


@query(A.with_tables("notes") + "SELECT song_id, count(*) AS notes, sum(pitch)::BIGINT AS pitches FROM notes GROUP BY song_id")
def output_files(spark, d):
    """Songs' JSON outputs, read again."""
    j = media.output_json(A.notes(spark, d).select(*K, "note_idx", "onset_tick", "pitch", "hand"), K)
    back = F.from_json("json", "version INT, notes ARRAY<STRUCT<onset_tick: BIGINT, pitch: INT, hand: STRING>>")
    notes = back["notes"]
    return j.select(*K, F.size(notes).cast("long").alias("notes"), F.aggregate(notes, F.lit(0).cast("long"), lambda a, n: a + n["pitch"]).alias("pitches"))


# --- relational coverage: Spark's own operators over the star schema


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY ALL""")
def tpch_q1(spark, d):
    """Pricing summary."""
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '2001-09-02 00:00:00'"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def tpch_q3(spark, d):
    """Ten orders of most revenue of a segment."""
    j = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey", "o_orderdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def tpch_q5(spark, d):
    """Revenue of local suppliers by nation."""
    j = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(read(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, d):
    """Revenue of a band of discounts."""
    return read(spark, d, "lineitem").where((F.col("l_discount") >= 0.05) & (F.col("l_discount") <= 0.07) & (F.col("l_quantity") < 24)).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query("SELECT coalesce(p_brand, '*') AS brand, coalesce(p_type, '*') AS type, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_parts(spark, d):
    """Counts by all combinations of brand and type."""
    c = read(spark, d, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))
    return c.select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce("p_type", F.lit("*")).alias("type"), "n", "sizes")


@query("""SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quarter, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)""")
def ranks(spark, d):
    """Customers ranked within their nations."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    t = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(t).alias("quarter"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))


@query("""(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def set_operations(spark, d):
    """Nations with rich customers and suppliers, outside of a region."""
    a = read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))
    return a.exceptAll(read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderpriority")
def semi_anti(spark, d):
    """Orders with a large line and a customer without debts."""
    o = read(spark, d, "orders").join(read(spark, d, "lineitem").where("l_quantity > 30"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    o = o.join(read(spark, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query()
def whole_song_analysis(spark, d):
    """Every pass in order, from fingertips to key releases (composed of operators that have oracles of their own)."""
    from .pipeline import SecondLooks, analyse

    pedal = timeline.islands(A.pedal_events(spark, d), K, "time_sec", ["event_id"], F.col("value") >= 64)
    notes = A.notes(spark, d).select(*K, "note_idx", "onset_tick", "pitch", "start_sec", "duration_sec", "velocity", "wi")
    return analyse(notes, A.frames(spark, d).select(*K, "frame_idx", "time_sec"), A.points(spark, d), pedal, looks=SecondLooks(to_x=lambda wi: wi * 20.0)).withColumn("flags", F.array_join("flags", ","))


_CUT = f"""
    d AS (SELECT song_id, note_idx, pitch, s.start_sec, time_sec, 96 + r / 4e0 AS r, 96 + g / 4e0 AS g, 96 + b / 4e0 AS b FROM samples s JOIN notes USING (song_id, note_idx)),
    k AS (SELECT pitch, median(r) AS r, median(g) AS g, median(b) AS b FROM d GROUP BY pitch),
    l AS (SELECT d.*, sqrt((d.r - k.r) ** 2 + (d.g - k.g) ** 2 + (d.b - k.b) ** 2) > 40 AS lit FROM d JOIN k USING (pitch)),
    s AS (SELECT *, bool_or(lit AND time_sec >= start_sec) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
        NOT lit AND NOT coalesce(lead(lit, 1) OVER w, true) AND NOT coalesce(lead(lit, 2) OVER w, true) AS run FROM l WINDOW w AS (PARTITION BY song_id, note_idx ORDER BY time_sec)),
    e AS (SELECT song_id, note_idx, min(time_sec) FILTER (seen AND run) AS lit_end FROM s GROUP BY ALL),
    h AS (SELECT song_id, note_idx, least({_d(_REFS['LH_white'])}, {_d(_REFS['LH_black'])}) AS l, least({_d(_REFS['RH_white'])}, {_d(_REFS['RH_black'])}) AS r FROM d WHERE time_sec = start_sec),
    c AS (SELECT n.*, h.l, h.r, least(duration_sec, lit_end - start_sec) AS cut FROM notes n JOIN h USING (song_id, note_idx) JOIN e USING (song_id, note_idx))"""


@query(A.with_tables("notes", "samples") + "," + _CUT + """
    SELECT song_id, note_idx, onset_tick, pitch, CASE WHEN l <= r THEN 'L' ELSE 'R' END AS hand, round(CASE WHEN l + r = 0 THEN 1 ELSE greatest(l, r) / (l + r) END, 4) AS confidence, start_sec,
      CASE WHEN cut >= 0.05::DOUBLE THEN cut ELSE duration_sec END AS duration_sec, CASE WHEN cut >= 0.05::DOUBLE AND cut <> duration_sec THEN round(cut, 4) END AS trimmed_sec FROM c""")
def render_analysis(spark, d):
    """A rendered video's notes: hands by picked colours, durations until keys go dark."""
    from .render import analyse_render

    s = A.samples(spark, d).withColumns({c: 96 + F.col(c) / 4.0 for c in "rgb"})
    n = A.notes(spark, d)
    return analyse_render(n, s, N.key_baselines(s.join(n.select(*K, "note_idx", "pitch"), [*K, "note_idx"])), _REFS)
