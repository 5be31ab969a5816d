"""Operators over notes, frames and samples, scalar functions, and the benchmark over folders."""

import json

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import colour, music, text
from cadenza.operators import notes as N
from cadenza.operators import signal
from cadenza.plans import benchmark
from cadenza.sources import media


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    row = [2.0, 1.0, 0.0, 5.0, -1.0]
    for u in (0.25, 1.0 + 1e-12, 1.0 - 1e-12):  # the divisor keeps its sign
        w = -1.0 * u + 1.0
        w = w if abs(w) >= 1e-9 else (1e-9 if w >= 0 else -1e-9)
        assert abs(value(spark, music.row_project(row, F.lit(u))[0]) - (2 * u + 1) / w) <= 1e-9 * abs((2 * u + 1) / w)
    assert abs(value(spark, music.row_invert(row, music.row_project(row, F.lit(0.25))[0])) - 0.25) < 1e-12
    h = [[2.0, 0.0, 1.0], [0.0, 3.0, 2.0], [0.0, 0.0, 1.0]]
    assert np.allclose([value(spark, c) for c in music.to_screen(F.lit(0.5), None, h)], [(0.5 - 1) / 2, (0.9 - 2) / 3])
    assert value(spark, music.to_screen(F.lit(0.25), row, h)[0]) == value(spark, music.row_project(row, F.lit(0.25))[0])
    assert value(spark, text.stripped(F.lit("\t\u00a0 a b \n"))) == "a b"
    assert value(spark, text.utc_stamp(F.lit("2024-01-31 09:05:00").cast("timestamp"))) == "2024-01-31T09:05:00Z"
    assert value(spark, colour.is_separated(F.lit(60.0))) and not value(spark, colour.is_separated_in_hue(F.lit(0.49)))


def test_assigned_hands(spark):
    red, blue, grey = (200.0, 20.0, 20.0), (20.0, 20.0, 200.0), (90.0, 90.0, 90.0)
    d = [("two", i, 40 + i, *(red if i < 3 else blue)) for i in range(6)] + [("one", i, 70 + i, *red) for i in range(4)] + [("grey", i, 40 + i, *grey) for i in range(3)]
    d = spark.createDataFrame(d, "song_id string, note_idx long, pitch int, r double, g double, b double")
    got = {(r.song_id, r.note_idx): (r.hand, r.degenerate, r.confidence) for r in signal.assigned_hands(d, ["song_id"], "note_idx", flip=False).collect()}
    assert [got["two", i][0] for i in range(6)] == list("LLLRRR") and not got["two", 0][1] and got["two", 0][2] > 0.5
    assert all(got["one", i] == ("R", True, 0.0) for i in range(4)) and all(got["grey", i] == ("L", True, 0.0) for i in range(3))
    assert signal.assigned_hands(d, ["song_id"], "note_idx", flip=True).where("song_id = 'two' AND note_idx = 0").first().hand == "R"


def test_samples(spark):
    s = spark.createDataFrame([(60, float(i), float(i), 0.0, 9.0) for i in range(100)] + [(61, 0.0, 1.0, 2.0, 3.0)], "pitch int, t double, r double, g double, b double")
    even = sorted(r.t for r in N.even_samples(s, ["pitch"], "t").where("pitch = 60").collect())
    assert even == [round(i * 99 / 7) for i in range(8)]
    base = {r.pitch: (r.r, r.g, r.b) for r in N.key_baselines(s, spark.createDataFrame([(60,), (61,), (62,)], "pitch int")).collect()}
    assert base == {60: (49.5, 0.0, 9.0), 61: (1.0, 2.0, 3.0), 62: (128.0, 128.0, 128.0)}
    lit = [0, 99, 99, 0, 0, 99, 0, 0, 0, 0]
    n = spark.createDataFrame([("a", 0, 61, 0.0, float(i), 1.0 + v, 2.0, 3.0) for i, v in enumerate(lit)], "song_id string, note_idx long, pitch int, start_sec double, time_sec double, r double, g double, b double")
    assert N.lit_end(n, N.key_baselines(s)).first().lit_end == 6.0
    assert N.lit_end(n.where("time_sec < 8"), N.key_baselines(s)).first().lit_end is None


def test_rows(spark):
    s = spark.createDataFrame([("c", 1, False), ("c", 0, False), ("d", 2, True), ("d", 3, False)], "channel string, pos int, saved boolean")
    assert {(r.pos, r.plan) for r in N.first_manual(s).collect()} == {(0, "manual"), (1, "reuse"), (2, "reuse"), (3, "reuse")}
    assert tuple(N.outcomes(spark.createDataFrame([(True,), (False,), (None,)], "ok boolean")).first()) == (1, 2)
    tracked = spark.createDataFrame([("a", 0, 100.0)], "song_id string, frame_idx long, x double")
    found = spark.createDataFrame([("a", 0, 120.0), ("a", 0, 200.0), ("a", 1, 100.0)], "song_id string, frame_idx long, x double")
    assert {(r.frame_idx, r.x) for r in N.without_neighbours(found, tracked, 50.0).collect()} == {(0, 200.0), (1, 100.0)}


def test_benchmark_folders(spark, tmp_path):
    def song(name, truth, pred):
        (tmp_path / name).mkdir()
        for file, notes in (("truth.json", truth), ("predicted.json", pred)):
            if notes is not None:
                (tmp_path / name / file).write_text(json.dumps({"notes": notes}))

    t = lambda p, at, hand, finger=None: {"pitch": p, "onsetSec": at, "hand": hand, "finger": finger}
    p = lambda p, at, hand, finger=None: {"pitch": p, "startSec": at, "hand": hand, "finger": finger}
    song("one", [t(60, 1.0, "R", 1), t(62, 2.0, "L", 2), t(64, 3.0, "L")], [p(60, 1.05, "R", 1), p(62, 2.02, "R", 2), p(64, 3.5, "L", 1)])
    song("two", [t(60, 0.0, "L", 5)], [p(60, 0.0, "L", 4), {"pitch": 1}])
    song("alone", [t(60, 0.0, "L")], None)
    got = {r.song: r for r in benchmark.scored_folders(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two", "all"}
    assert (got["one"].labeled, got["one"].matched, got["one"].hand_correct, got["one"].finger_accuracy) == (3, 2, 1, 1.0)
    assert (got["all"].labeled, got["all"].matched, got["all"].hand_correct, got["all"].finger_labeled, got["all"].finger_correct) == (4, 3, 2, 3, 2)
    mixed = media.read_predictions(spark, f"{tmp_path}/*/predicted.json")
    assert [r.onset_sec for r in benchmark.truth_template(mixed).where("song = 'one'").orderBy("pos").collect()] == [1.05, 2.02, 3.5]
