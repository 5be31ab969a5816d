import json
import os

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.functions.calibration import Calibration, from_stored, to_stored
from cadenza.sources import media, midi
from cadenza.streaming.windows import streamed_means, streamed_runs, streamed_sessions


def vlq(n):
    out = [n & 0x7F]
    while n := n >> 7:
        out.insert(0, n & 0x7F | 0x80)
    return bytes(out)


def song(events, ppq=480):
    """A MIDI file of one track from (tick, bytes)."""
    body, last = b"", 0
    for tick, data in events:
        body += vlq(tick - last) + data
        last = tick
    return b"MThd" + (6).to_bytes(4) + (1).to_bytes(2) + (1).to_bytes(2) + ppq.to_bytes(2) + b"MTrk" + len(body).to_bytes(4) + body


END = b"\xff\x2f\x00"


def test_midi(spark, tmp_path):
    tempo = lambda us: b"\xff\x51\x03" + us.to_bytes(3)
    (tmp_path / "a.mid").write_bytes(song([
        (0, bytes([0x80, 60, 0])), (0, bytes([0x90, 60, 80])), (0, bytes([0xB0, 64, 100])), (240, bytes([0x90, 60, 70])), (480, bytes([0x90, 60, 0])), (480, tempo(250_000)), (480, bytes([0xB0, 64, 0])),
        (960, bytes([0x80, 60, 0])), (960, bytes([0xB0, 64, 127])), (1440, END)]))
    e = midi.read_events(spark, str(tmp_path)).cache()
    n = [(r.onset_tick, round(r.start_sec, 6), round(r.duration_sec, 6), r.velocity) for r in midi.read_notes(e).orderBy("note_idx").collect()]
    assert n == [(0, 0.0, 0.5, 80), (240, 0.25, 0.5, 70)]
    assert [(round(r.start_sec, 6), round(r.end_sec, 6)) for r in midi.pedal_segments(e).orderBy("start_sec").collect()] == [(0.0, 0.5), (0.75, 1.0)]
    t = e.select("path").distinct().select("path", F.lit(0).cast("long").alias("onset_tick"), F.lit(60).alias("pitch"), F.lit(0.25).alias("duration_sec"))
    moved = midi.with_trims(e, t).where("kind = 'off'").orderBy("tick").collect()
    assert [r.tick for r in moved] == [0, 240, 960]


def test_sources(spark):
    s = "pos int, id string, url string, channel_id string, uploader_id string, title string"
    d = spark.createDataFrame([(0, "x", None, None, "u", "t"), (1, None, "http://a", "c", None, None), (2, None, None, None, None, "t"), (3, None, "http://a", "z", None, "again")], s)
    got = [tuple(r) for r in media.expanded_sources(d).orderBy("pos").collect()]
    assert got == [(0, "https://www.youtube.com/watch?v=x", "u", "t"), (1, "http://a", "c", "")]


def test_files(spark, tmp_path):
    for name, notes in (("one", [{"pitch": 60, "startSec": 1.0, "hand": "R", "finger": 1}, {"pitch": 61, "hand": "L"}]), ("two", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pred.json").write_text(json.dumps({"notes": notes}))
    assert [(r.song, r.pitch) for r in media.read_predictions(spark, f"{tmp_path}/*/pred.json").collect()] == [("one", 60)]
    archive = media.bundle({"title": "t", "artist": ""}, b"MThd", {"notes": []})
    again = media.relabelled_bundle(archive, {"artist": "b"})
    import io
    import zipfile

    head = json.loads(zipfile.ZipFile(io.BytesIO(again)).read("manifest.json"))
    assert head["metadata"] == {"artist": "b"} and "artist" not in head and "DISCLAIMER.txt" in head["contents"]


def test_streams(spark, tmp_path):
    d = spark.sql("SELECT 'u' AS k, timestamp_seconds(1704067200 + id * 60) AS ts, CAST(id % 5 AS double) AS value FROM range(40)")
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streamed_means(stream, ["k"], "ts", "value").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.mean, r.n) for r in spark.table("means").collect()} == {(2.0, 10)}
    q = streamed_runs(stream, "k", "ts", "value", 3.0).writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("runs").count() == 8


def test_sliding_and_session_streams(spark, tmp_path):
    minutes = [0, 1, 2, 30, 31, 90]
    d = spark.createDataFrame([("u", m, float(m)) for m in minutes] + [("v", 5, None)], "k string, m int, value double")
    d = d.selectExpr("k", "timestamp_seconds(1704067200 + m * 60) AS ts", "value")
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def told(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    for streamed, name, options in ((streamed_means, "sliding", {"slide": "5 minutes"}), (streamed_sessions, "sessions", {"gap": "10 minutes"})):
        got = told(streamed(stream, ["k"], "ts", "value", **options), name)
        assert got == sorted(map(tuple, streamed(d, ["k"], "ts", "value", **options).collect()), key=str)  # as over a table at rest
        assert streamed(d.limit(0), ["k"], "ts", "value", **options).count() == 0
    assert sorted((r.k, r.n, r.mean) for r in spark.table("sessions").collect() if r.k == "u") == [("u", 1, 90.0), ("u", 2, 30.5), ("u", 3, 1.0)]
    assert sum(r.n for r in spark.table("sliding").collect()) == 2 * len(minutes)


def test_functions_in_sql(spark):
    from cadenza.functions import registered

    registered.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM keys_between(59, 61)").collect()] == [(59, "B3"), (60, "C4"), (61, "C#4")]
    assert spark.sql("SELECT * FROM keys_between(5, 4)").count() == spark.sql("SELECT * FROM keys_between(NULL, 4)").count() == 0
    assert spark.sql("SELECT note_name(CAST(NULL AS INT)), is_black_key(70)").first()[:] == (None, True)


@pytest.mark.parametrize("path", ["/a/b/piece.mid", "/a.b/piece", "piece.fingering.json", "/x/piece.json", "/x/.hidden", "/x/.hidden.mp4", "a.b.c", "/x/..two", ""])
def test_default_paths(spark, path):
    p = F.lit(path)
    got = spark.range(1).select(text.output_path(p), text.without_json(p), text.bundle_path(p, ".zip"), text.truth_path(p), text.video_output_path(p, F.lit("/out"))).first()
    bare = next((path[: -len(x)] for x in (".fingering.json", ".json") if path.endswith(x)), path)
    stem = os.path.splitext(path)[0]
    assert tuple(got) == (stem + ".fingering.json", bare if bare != path else stem, bare + ".zip", bare + ".truth.json", f"/out/{os.path.basename(stem)}.fingering.json")


def test_calibrations_as_text(spark):
    whole = Calibration(((0.0, 0.0), (9.0, 0.0), (9.0, 5.0), (0.0, 5.0)), 21, 108, 0.1, (1.0, 2.0, 3.0, 4.0, 5.0), None, 2.5)
    plain = Calibration(((0.0, 0.0), (9.0, 0.0), (9.0, 5.0), (0.0, 5.0)), 21, 108)
    texts = [json.dumps(c.stored()) for c in (whole, plain)] + ['{"corners": [[0, 0], [9, 0], [9, 5], [0, 5]], "low_pitch": 21, "high_pitch": 108, "row": null}', "{}", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    rows = df.select(from_stored(F.col("t")).alias("c"), to_stored(from_stored(F.col("t"))).alias("w")).collect()
    assert [Calibration.of(r.c.asDict()) if r.c else None for r in rows] == [whole, plain, plain, None, None, None]
    assert [json.loads(r.w) if r.w else None for r in rows] == [whole.stored(), plain.stored(), plain.stored(), None, None, None]
