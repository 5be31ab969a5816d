"""Patch means, samples of notes, landmarks, and spans, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import landmarks, pictures

K = ["song_id"]


def plain_patch(p, x, y, r=3):
    h, w = p.shape[:2]
    xi, yi = int(round(x)), int(round(y))
    part = [p[j, i] for j in range(max(0, yi - r), min(h, yi + r + 1)) for i in range(max(0, xi - r), min(w, xi + r + 1))]
    return np.mean(part, axis=0) if part else np.zeros(3)


def test_patch_means():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (9, 14, 3)).astype(np.uint8)
    x, y = rng.uniform(-8, 22, 300), rng.uniform(-8, 17, 300)
    x[:4], y[:4] = [0.5, 1.5, -3.5, 2.5], [2.5, -4.0, 0.5, 0.5]
    for r in (0, 1, 3):
        assert np.allclose(pictures.patch_means(p, x, y, r), [plain_patch(p, a, b, r) for a, b in zip(x, y, strict=True)])


@pytest.fixture(scope="module")
def shown(spark):
    rng = np.random.default_rng(4)
    frames = [(s, i, round(i * 0.1, 1), 14, 9, bytes(rng.integers(0, 256, 9 * 14 * 3, np.uint8))) for s in ("a", "b") for i in range(80)]
    rasters = [(*f[:5], bytearray(f[5])) for f in frames] + [("a", 99, 0.0, 14, 9, None), ("c", 0, None, 14, 9, bytearray(378))]
    notes = [("a", 0, 60, 0.02), ("a", 1, 61, 3.0), ("a", 2, 60, 7.95), ("a", 3, 99, 1.0), ("b", 0, 60, 2.55), ("b", 1, 61, None), ("d", 0, 60, 1.0), ("b", 2, 60, 99.0)]
    places = [("a", 60, 3.4, 2.0), ("a", 61, 20.0, 3.0), ("b", 60, 13.0, 8.0), ("b", 61, None, 1.0)]
    make = spark.createDataFrame
    return frames, notes, places, make(rasters, "song_id string, frame_idx long, time_sec double, width int, height int, pixels binary"), make(notes, "song_id string, note_idx long, pitch int, start_sec double"), make(places, "song_id string, pitch int, x double, y double")


def test_note_samples(shown):
    frames, notes, places, r, n, p = shown
    at = {(s, k): (x, y) for s, k, x, y in places if x is not None}
    want = []
    for s, i, k, t in notes:
        for f in frames:
            if t is not None and f[0] == s and (s, k) in at and t - 0.05 <= f[2] <= t + 4.0:
                want.append((s, i, f[2], *np.round(plain_patch(np.frombuffer(f[5], np.uint8).reshape(9, 14, 3), *at[s, k]), 6)))
    got = pictures.note_samples(r, n, p, K)
    assert sorted((x.song_id, x.note_idx, x.time_sec, round(x.r, 6), round(x.g, 6), round(x.b, 6)) for x in got.collect()) == sorted(want)
    first = {(w[0], w[1]): w[3:] for w in sorted(want, reverse=True)}
    assert {(x.song_id, x.note_idx): (round(x.r, 6), round(x.g, 6), round(x.b, 6)) for x in pictures.onset_colours(got, K).collect()} == first
    assert pictures.note_samples(r.limit(0), n, p, K).count() == 0 == pictures.note_samples(r, n.limit(0), p, K).count()


def test_pixels_stay_out_of_the_interval_join(shown):
    """Pictures meet only the keys asked of them; the join over time carries no pixels."""
    *_, r, n, p = shown
    plan = pictures.note_samples(r, n, p, K)._jdf.queryExecution().optimizedPlan().toString()
    assert "pixels" in plan
    for line in plan.splitlines():
        assert not ("_bucket" in line and "pixels" in line)


def test_broken_pictures_are_refused(spark):
    r = spark.createDataFrame([("a", 0, 0.0, 4, 4, bytearray(5))], "song_id string, frame_idx long, time_sec double, width int, height int, pixels binary")
    asked = spark.createDataFrame([("a", 0, 60, 1.0, 1.0)], "song_id string, frame_idx long, pitch int, x double, y double")
    with pytest.raises(Exception, match="has 5 bytes"):
        pictures.key_colours(r, asked, K).collect()


def test_strides(spark):
    f = spark.range(10).select(F.col("id").alias("frame_idx"))
    assert [pictures.strided(f, fps).count() for fps in (60, 30, 0, 75)] == [5, 10, 10, 5]


def test_landmarks(spark):
    marks = [(i / 100, i / 50) for i in range(21)]
    rows = [("a", 0, 0.0, [("Left", marks), ("Right", marks[:9])], 10.0, 20.0, 100.0, 50.0), ("a", 1, 0.1, [], 10.0, 20.0, 100.0, 50.0), ("a", 2, 0.2, None, 10.0, 20.0, 100.0, 50.0), ("a", 3, 0.3, [("Other", None)], 0.0, 0.0, 1.0, 1.0)]
    f = spark.createDataFrame(rows, f"song_id string, frame_idx long, time_sec double, hands {landmarks.HANDS}, cx double, cy double, cw double, ch double")
    got = {(r.frame_idx, r.pos, r.hand, r.finger): (round(r.x, 6), round(r.y, 6)) for r in landmarks.points(f, K).collect()}
    want = {(0, 0, "L", k): (10 + i, 20 + i) for k, i in ((0, 0), (1, 4), (2, 8), (3, 12), (4, 16), (5, 20))} | {(0, 0, "L", 6): (21.0, 31.0)}
    want |= {(0, 1, "R", k): (10 + i, 20 + i) for k, i in ((0, 0), (1, 4), (2, 8))}
    assert got == want
    assert {r.hand for r in landmarks.points(f, K, flip=True).where("pos = 0").collect()} == {"R"}
    places = lambda d: {(r.pos): (r.x, r.y) for r in landmarks.hand_places(d, K).collect()}
    p = landmarks.points(f, K)
    assert places(p) == {0: (21.0, 31.0), 1: (10.0, 20.0)}
    assert places(p.where("finger BETWEEN 1 AND 5")) == {0: (22.0, 32.0), 1: (16.0, 26.0)}


def plain_spans(line, dark=90):
    out, start = [], None
    for x, v in enumerate([*line, 255]):
        if v is not None and v < dark and start is None:
            start = x
        elif not (v is not None and v < dark) and start is not None:
            out.append((start, x))
            start = None
    return out


def test_masks_and_stability(spark):
    rng = np.random.default_rng(9)
    pics = {s: rng.choice([10, 89, 90, 200], (40, 50), p=[0.3, 0.2, 0.2, 0.3]) for s in "ab"}
    pics["b"][:20] = 200
    lines = spark.createDataFrame([(s, y, [int(v) for v in p[y]]) for s, p in pics.items() for y in range(40)] + [("c", 0, []), ("c", 1, None), ("c", 2, [5, None, 5])], "song_id string, y int, grey array<int>")
    masks = pictures.dark_masks(lines, K)
    got = {(r.song_id, r.y): [tuple(s) for s in r.spans] for r in masks.collect()}
    assert got == {(s, y): plain_spans(p[y]) for s, p in pics.items() for y in range(40)} | {("c", 0): [], ("c", 2): [(0, 1), (2, 3)]}
    iou = {(r.song_id, r.y): r.iou for r in pictures.stability(masks, K).collect()}
    for s, p in pics.items():
        for y in range(40):
            a, b = (p[y] < 90, p[y + 15] < 90) if y < 25 else (np.zeros(1), np.zeros(1))
            union = np.logical_or(a, b).sum()
            assert abs(iou[s, y] - (np.logical_and(a, b).sum() / union if union else 0)) < 1e-12


def test_key_rows(spark):
    def line(period, wide, shift=0):
        return [30 if (x + shift) % period < wide else 220 for x in range(240)]

    rows = [("even", y, line(12, 5)) for y in range(60)] + [("slanted", y, line(12, 5, y if y < 30 else 0)) for y in range(60)] + [("few", y, line(40, 9)) for y in range(60)]
    lines = spark.createDataFrame(rows, "song_id string, y int, grey array<int>")
    got = {r.song_id: (r.y, r.n, round(r.iou, 6)) for r in pictures.key_rows(lines, K, 240, 60).collect()}
    assert got == {"even": (21, 20, 1.0), "slanted": (24, 20, 1.0)}  # 24 lines slant by two periods
    centres = pictures.key_centres(lines, pictures.key_rows(lines, K, 240, 60), K, 240).where("song_id = 'even'").orderBy("idx").collect()
    assert [r.x for r in centres] == [12 * i + 2.5 for i in range(20)] and {r.y for r in centres} == {21.0}
