"""Cases that a review found, each of which failed before."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import calibration, colour
from cadenza.operators import pictures, release, sketches
from cadenza.plans import catalogue3, pipeline
from cadenza.sources import midi

from . import duck

K = ["song_id"]


def test_hues_are_those_of_the_c_library(spark):
    rows = [(float(e * 3 % 256), float(e * 5 % 256), float(e * 7 % 256)) for e in range(256)] + [(9.0, 9.0, 9.0)]
    x, y = colour.hue_vector(F.col("r"), F.col("g"), F.col("b"))
    d = spark.createDataFrame([*rows, (None, 1.0, 2.0)], "r double, g double, b double").select("r", "g", "b", x.alias("x"), y.alias("y")).collect()
    for r in d:
        if r.r is None:
            assert r.x is None and r.y is None
            continue
        a = math.atan2((r.g - r.b) * math.sqrt(3.0) / 2, r.r - (r.g + r.b) / 2)
        assert (r.x, r.y) == (math.cos(a), math.sin(a))


@pytest.mark.parametrize("kinds", [3, 5000])
def test_frequent_items_fit_where_there_are_none(spark, kinds):
    d = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") % kinds).cast("string").alias("item"), F.col("id").cast("double").alias("v"))
    told = sketches.estimates(sketches.sketched(d, ["g"], F.col("v"), F.col("item")), top=3).select("g", F.explode("frequent").alias("f")).select("g", F.col("f.item").alias("item"), F.col("f.count").alias("told"))
    counts = d.groupBy("g", "item").agg(F.count("*").alias("c"))
    fits = lambda t: [tuple(r) for r in sketches.frequent_within(t, counts, ["g"], 3).collect()]
    assert fits(told) == [("g", True)]
    assert fits(told.limit(0)) == [("g", kinds == 5000)]  # items that are frequent must be told
    assert fits(told.where("false").unionByName(counts.limit(1).select("g", "item", (F.col("c") + 500).alias("told")))) == [("g", False)]


def test_lines_are_merged_not_broadcast(spark, tmp_path):
    lines = spark.createDataFrame([("a", y, [30 if x % 12 < 5 else 220 for x in range(240)]) for y in range(60)], "song_id string, y int, grey array<int>")
    lines.write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    rows = pictures.key_rows(lines, K, 240, 60)
    for d in (rows, pictures.key_centres(lines, rows, K, 240)):
        assert d.count() > 0
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_samples_take_no_join_after_their_pictures(spark, sf_dir):
    """Places meet notes, and pictures their stretch's notes; answers don't go back by a join, and nothing is made distinct."""
    r = spark.createDataFrame([], "song_id string, frame_idx long, time_sec double, width int, height int, pixels binary")
    n = spark.createDataFrame([], "song_id string, note_idx long, pitch int, start_sec double")
    p = spark.createDataFrame([], "song_id string, pitch int, x double, y double")
    assert pictures.note_samples(r, n, p, K)._jdf.queryExecution().analyzed().toString().count("Join ") == 2


def test_streams_are_written_by_many_tasks(spark, sf_dir):
    from pathlib import Path

    *_, tables = catalogue3._streamed(spark, sf_dir)
    for name in ("notes", "frames"):
        assert len(list(Path(tables.root.removeprefix("file:"), name).glob("*.parquet"))) > 1


def test_stored_texts_are_parsed_once(spark):
    d = spark.range(3).select(F.concat(F.lit('{"corners": [[0, 1]], "low_pitch": 21, "high_pitch": '), F.col("id").cast("string"), F.lit("}")).alias("t"))
    out = d.select(calibration.to_stored(calibration.from_stored(F.col("t"))).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") + out._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs") <= 1
    assert [r.t for r in out.collect()] == [f'{{"corners":[[0.0,1.0]],"low_pitch":21,"high_pitch":{i},"k1":0.0}}' for i in range(3)]


@pytest.mark.parametrize("name", ["streamed_sounding", "streamed_occlusion"])
def test_streams_take_rows_of_their_first_moment(spark, tmp_path, name):
    """The first 40 ms of a month are a song's moment 0, and what lies before is before it."""
    rows = [(i, f"2024-01-01 00:00:00.0{i:02}", i // 3) for i in range(12)] + [(20, "2023-12-30 01:00:00", 0), (21, "2024-01-01 01:00:00", 0), (5, "2023-11-01 00:00:00", 9)]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long")
    d = d.withColumns({"ts": F.to_timestamp_ntz("ts"), "event_type": F.lit("click"), "value": F.lit(1.0), "props": F.lit("{}")})
    d.coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = sorted(tuple(r) for r in catalogue3.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(duck.connect(str(tmp_path)).execute(catalogue3.ORACLE[name]).fetchall())
    assert len(got) == (10 if name == "streamed_sounding" else 2)


def test_songs_are_dealt_once_for_reconciling(spark, sf_dir):
    from cadenza.operators import release, timeline
    from cadenza.plans import analogue as A
    from cadenza.plans import catalogue

    def dealt() -> int:
        out = release.reconciled(A.notes(spark, sf_dir), A.points(spark, sf_dir), A.frames(spark, sf_dir), catalogue._pedal(spark, sf_dir))
        return out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    name, small = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"
    before, threshold = spark.conf.get(name), spark.conf.get(small)
    spark.conf.set(small, "-1")
    try:
        each_time = dealt()
        with timeline.dealt_once(spark):
            once = dealt()
    finally:
        spark.conf.set(small, threshold)
    assert once < each_time / 1.5
    assert spark.conf.get(name) == before


def test_fingers_leave_as_told_frame_by_frame(spark):
    """Backwards in one pass: no row for each key and frame near it, so but two joins."""
    rng = random.Random(3)
    frames = [(s, i, round(i * 0.1, 1)) for s in "ab" for i in range(60)]
    points = [(s, i, rng.choice([30.0, 31.4, 33.0, 36.5, None])) for s, i, _ in frames for _ in range(rng.randrange(3))]
    notes = [(s, n, round(rng.randrange(62) * 0.1, 1), rng.choice([29.0, 30.0, 32.5, 36.0, None])) for s in "abc" for n in range(40)]
    d = lambda rows, schema: spark.createDataFrame(rows, f"song_id string, {schema}")
    got = release.finger_leaves(d(notes, "note_idx long, start_sec double, wi double"), d(frames, "frame_idx long, time_sec double"), d(points, "frame_idx long, wi double"))
    told = {(r.song_id, r.note_idx): r.left_at for r in got.collect()}
    for s, n, start, wi in notes:
        after = [(t, any(p[:2] == (s, i) and None not in (p[2], wi) and abs(p[2] - wi) <= 1.5 for p in points)) for f, i, t in frames if f == s and t >= start]
        runs = [after[i][0] for i in range(len(after) - 2) if not any(near for _, near in after[i : i + 3])]
        assert told[s, n] == (runs[0] if runs else None)
    assert got._jdf.queryExecution().analyzed().toString().count("Join ") == 2


def test_hands_are_relabelled_by_one_join(spark):
    """Only hands that change go back to their points."""
    s = "song_id string, frame_idx long, time_sec double, hand string, finger int, x double, y double, wi double"
    p = spark.createDataFrame([("a", 0, 0.0, "L", 0, 500.0, 0.0, 1.0), ("a", 0, 0.0, "R", 0, 100.0, 0.0, 2.0), ("a", 0, 0.0, "L", 2, 510.0, 0.0, 3.0), ("a", 1, 0.1, "L", 0, 90.0, 0.0, 4.0), ("b", 9, 0.1, "L", 0, 90.0, 0.0, 5.0)], s)
    f = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "song_id string, frame_idx long")
    out = pipeline._continuous(p, f)
    assert sorted((r.wi, r.hand) for r in out.collect()) == [(1.0, "R"), (2.0, "L"), (3.0, "R"), (4.0, "L"), (5.0, "L")]
    assert out._jdf.queryExecution().analyzed().toString().count("Join ") == 1


def test_midi_files_are_made_in_a_stream(spark):
    """A file's events pass in order through a task; a union's parts are dealt anew, or a file would be made twice."""
    notes = spark.range(600).select(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"), F.lit(".mid")).alias("path"), (F.col("id") * 7).alias("onset_tick"), (F.col("id") * 7 + 200).alias("off_tick"), F.lit(60).alias("pitch"), F.lit(9).alias("velocity"), F.lit(0).alias("channel"))
    made = midi.files_of(midi.events_of_notes(notes))
    files = {r.path: bytes(r.content) for r in made.collect()}
    assert made.count() == len(files) == 40
    assert all(sum(e[4] == "on" for e in midi.events_of(c)) == 15 and list(midi.events_of(c))[-1][4] == "end" for c in files.values())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "hashpartitioning(xxhash64" in plan
