import random
import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import matching, refine, release, signal, timeline


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_anchored_clusters_are_no_sessions(spark):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 0.02, 0.04, 1.0, 1.005, 2.5])], "song_id string, note_idx long, start_sec double")
    out = timeline.anchored_clusters(d, ["song_id"], "start_sec", ["note_idx"], 0.03)
    assert [r[1] for r in rows(out, "note_idx", "cluster")] == [0, 0, 1, 2, 2, 3]


def test_anchored_clusters_random(spark):
    rng = random.Random(3)
    data = [(s, i, round(rng.random() * 3, 3)) for s in "ab" for i in range(200)]
    d = spark.createDataFrame(data, "song_id string, note_idx long, start_sec double")
    got = {(r.song_id, r.note_idx): r.cluster for r in timeline.anchored_clusters(d, ["song_id"], "start_sec", ["note_idx"], 0.05).collect()}
    for s in "ab":
        first, n = None, -1
        for _, i, t in sorted((x for x in data if x[0] == s), key=lambda x: (x[2], x[1])):
            if first is None or t - first > 0.05:
                first, n = t, n + 1
            assert got[s, i] == n


def test_greedy_chords(spark):
    n = spark.createDataFrame([(0, 0, 100.0, 0.0), (0, 1, 300.0, 0.0), (0, 2, 500.0, 0.0)], "k int, note_pos long, nx double, ny double")
    c = spark.createDataFrame([(0, 0, "L", 5, 105.0, 0.0), (0, 1, "L", 1, 305.0, 0.0), (0, 2, "R", 1, 505.0, 0.0), (0, 3, "R", 2, 520.0, 0.0)], "k int, cand_pos long, hand string, finger int, x double, y double")
    out = matching.chord_matches(n, c, ["k"], 60.0)
    assert rows(out, "note_pos", "hand", "finger") == [(0, "L", 5), (1, "L", 1), (2, "R", 1)]
    assert matching.chord_matches(n, c.limit(1), ["k"], 60.0).count() == 1
    near = {r.note_pos: r for r in matching.nearest_candidate(n, c, ["k"], 60.0).collect()}
    assert (near[0].hand, near[0].finger) == ("L", 5) and near[0].confidence > 0.9


def test_greedy_chords_random(spark):
    rng = random.Random(5)
    notes = [(k, i, float(rng.randrange(12)), 0.0) for k in range(60) for i in range(4)]
    cands = [(k, i, "LR"[i % 2], i, float(rng.randrange(12)), 0.0) for k in range(60) for i in range(5)]
    out = matching.chord_matches(spark.createDataFrame(notes, "k int, note_pos long, nx double, ny double"), spark.createDataFrame(cands, "k int, cand_pos long, hand string, finger int, x double, y double"), ["k"], 1.0)
    want = set()
    for k in range(60):
        ns, cs = [n for n in notes if n[0] == k], [c for c in cands if c[0] == k]
        pairs = sorted((abs(n[2] - c[4]), n[1], c[1]) for n in ns for c in cs)
        un, uc = set(), set()
        for _, n, c in pairs:
            if n not in un and c not in uc:
                un.add(n), uc.add(c), want.add((k, n, c))
    assert set(rows(out, "k", "note_pos", "cand_pos")) == want


def _pairs(spark, truth, pred):
    s = "song string, pos long, pitch int, onset_sec double, hand string, finger int"
    return matching.joined_notes(spark.createDataFrame(truth, s), spark.createDataFrame(pred, s), ["song"], 0.1)


def test_joined_notes(spark):
    out = _pairs(spark, [("a", 0, 60, 1.0, "R", 1), ("a", 1, 60, 1.08, "R", 2), ("a", 2, 62, 3.0, "L", None)], [("a", 0, 60, 1.08, "R", 1), ("a", 1, 60, 1.02, "R", 1), ("a", 2, 62, 3.2, "L", 1)])
    assert rows(out, "pos", "pred_onset_sec")[:2] == [(0, 1.02), (1, 1.08)]
    assert out.where("pos = 2").first().pred_hand is None


def test_joined_notes_random(spark):
    rng = random.Random(9)
    truth = [("a", i, rng.randrange(60, 63), round(rng.random() * 4, 2), "R", 1) for i in range(80)]
    pred = [("a", i, rng.randrange(60, 63), round(rng.random() * 4, 2), "L", 1) for i in range(80)]
    got = {r.pos: r.pred_pos for r in _pairs(spark, truth, pred).collect()}
    # per pitch in order of onset and pos, as runs are folded
    used = set()
    for t in sorted(truth, key=lambda t: t[1]):
        best = None
        for p in sorted(pred, key=lambda p: p[1]):
            d = abs(p[3] - t[3])
            if p[2] == t[2] and p[1] not in used and d <= 0.1 and (best is None or d < best[0]):
                best = d, p[1]
        if best:
            used.add(best[1])
        assert got[t[1]] == (best and best[1])


def test_scores(spark):
    s = "song string, hand string, finger int, pred_hand string, pred_finger int"
    p = spark.createDataFrame([("a", "R", 1, "L", 1), ("a", "L", 2, "L", 3), ("b", "R", None, "R", 5), ("b", "R", 1, None, None)], s)
    out = {r.song: r for r in matching.scores(p, ["song"], "all").collect()}
    assert (out["all"].labeled, out["all"].matched, out["all"].hand_correct, out["all"].r_as_l) == (4, 3, 2, 1)
    assert abs(out["all"].hand_accuracy - 2 / 3) < 1e-9 and out["all"].finger_labeled == 2 and out["a"].finger_accuracy == 0.5
    assert matching.scores(p.limit(0), ["song"]).count() == 0


def test_release(spark):
    s = "song_id string, note_idx long, start_sec double, original_end_sec double, hand string, finger int, pitch int, visual_release_sec double"
    d = spark.createDataFrame([
        ("a", 0, 0.0, 3.0, "R", 2, 60, None), ("a", 1, 1.0, 3.0, "R", 2, 62, None), ("b", 0, 0.0, 2.5, None, None, 60, 0.6), ("c", 0, 0.0, None, None, None, 60, None),
        ("d", 0, 0.0, 2.0, "R", 1, 60, None), ("d", 1, 0.5, 2.0, "L", 3, 60, None), ("e", 0, 0.0, 1.0, "R", 1, 50, None), ("e", 1, 0.01, 1.0, "R", 1, 55, None)], s)
    got = {(r.song_id, r.note_idx): (round(r.corrected_end_sec, 6), r.reason) for r in release.corrected_ends(d).collect()}
    assert got["a", 0] == (0.985, "same_finger_new_note") and got["a", 1] == (3.0, "original_midi_offset")
    assert got["b", 0] == (0.6, "visual_key_release") and got["c", 0] == (0.3, "fallback_estimate")
    assert got["d", 0] == (0.485, "same_pitch_restrike") and got["e", 0][0] == 0.03


def test_occlusion_and_leaving(spark):
    p = spark.createDataFrame([("a", i, t, "R", 1, 30.0) for i, t in enumerate([0.0, 0.1])], "song_id string, frame_idx long, time_sec double, hand string, finger int, wi double")
    n = spark.createDataFrame([("a", 0, 0.0, 30.0), ("a", 1, 0.5, 30.0)], "song_id string, note_idx long, start_sec double, wi double")
    assert rows(release.occluded(n, p), "note_idx", "occluded") == [(0, False), (1, True)]
    f = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 0.3, 0.4])], "song_id string, frame_idx long, time_sec double")
    assert release.finger_leaves(n.where("note_idx = 0"), f, p).first().left_at == 0.2
    assert release.finger_leaves(n.where("note_idx = 0"), f.where("time_sec < 0.35"), p).first().left_at is None


def test_leaps_and_smoothing(spark):
    s = "song_id string, note_idx long, start_sec double, pitch int, hand string, confidence double, pick_rank long"
    d = spark.createDataFrame([("a", 0, 0.0, 40, "L", 0.9, 0), ("a", 1, 0.1, 70, "L", 0.1, 1), ("a", 2, 1.0, 42, "L", 0.9, 2)], s)
    v = refine.leaps(d).collect()
    assert [(r.suspect, r.fixed) for r in v] == [(1, True)]
    assert rows(refine.without_leaps(d), "note_idx", "hand")[1] == (1, "R")
    sm = spark.createDataFrame([("a", i, i * 0.1, 60 + i, h, c, i) for i, (h, c) in enumerate([("R", 0.9), ("R", 0.9), ("L", 0.2), ("R", 0.9)])], s)
    assert rows(refine.smoothed(sm), "note_idx", "hand")[2] == (2, "R")


def test_prior_and_fuse(spark):
    s = "song_id string, note_idx long, start_sec double, pitch int, hand string, confidence double"
    d = spark.createDataFrame([("a", 0, 0.0, 40, "R", 0.4), ("a", 1, 0.01, 84, "L", 0.5), ("a", 2, 1.0, 45, "R", 0.1)], s)
    p = {r.note_idx: r for r in refine.hand_prior(d).collect()}
    assert p[0].prior_hand == "L" and p[1].prior_hand == "R" and p[2].prior_hand == "L"
    out = dict(rows(refine.fused(d, refine.hand_prior(d)), "note_idx", "hand"))
    assert out[0] == "L" and out[1] == "L" and out[2] == "L"


def test_continuity_votes_see_earlier_flips(spark):
    rng = random.Random(1)
    hands, frames = [], []
    for s in range(10):
        for f in range(12):
            frames.append((f"s{s}", f))
            for h in rng.choice([["L"], ["R"], ["L", "R"], []]):
                hands.append((f"s{s}", f, h, float(rng.randrange(300))))
    hd = spark.createDataFrame(hands, "song_id string, frame_idx long, hand string, x double")
    fd = spark.createDataFrame(frames, "song_id string, frame_idx long")
    got = rows(refine.continuous(hd, fd), "song_id", "frame_idx", "hand", "x")
    want = []
    for s in range(10):
        fr = [[[h, x] for a, b, h, x in hands if a == f"s{s}" and b == f] for f in range(12)]
        for f in fr:
            by = {h[0]: h for h in f}
            if len(f) == 2 and by["L"][1] > by["R"][1]:
                by["L"][0], by["R"][0] = "R", "L"
        for i, f in enumerate(fr):
            if len(f) == 1:
                near = [o[0] == f[0][0] for j in range(max(0, i - 3), min(12, i + 4)) if j != i for o in fr[j] if abs(o[1] - f[0][1]) < 100]
                if near.count(False) > 2 * near.count(True):
                    f[0][0] = "R" if f[0][0] == "L" else "L"
        want += [(f"s{s}", i, h, x) for i, f in enumerate(fr) for h, x in f]
    assert got == sorted(want)


def test_offsets(spark):
    on = [0.3 * i + 0.01 * (i % 3) for i in range(30)]
    a = spark.createDataFrame([("a", t + 1.35) for t in on] + [("b", 0.0)], "song_id string, t double")
    b = spark.createDataFrame([("a", t) for t in on] + [("b", 100.0), ("c", 1.0)], "song_id string, t double")
    got = dict(rows(signal.estimated_offset(a, b, ["song_id"], "t"), "song_id", "offset_sec"))
    assert abs(got["a"] - 1.35) <= 0.06 and got["b"] == -5.0 and got["c"] == 0.0


def test_clusters(spark):
    d = spark.createDataFrame([("a", i, x, 0.0, 40 + i) for i, x in enumerate([0.0, 0.1, 1.0, 1.1])], "k string, i long, x double, y double, pitch int")
    c = signal.two_means(d, ["k"], ["x", "y"], "i")
    out = signal.cluster_hands(c.join(d.select("i", "pitch"), "i"), ["k"], "pitch")
    assert [r[1] for r in rows(out, "i", "hand")] == ["L", "L", "R", "R"]


@pytest.mark.parametrize("left,right", [(0.0, 0.1), (0.0, 1.0)])
def test_interpolation(spark, left, right):
    f = spark.createDataFrame([("a", 0, left), ("a", 1, right)], "song_id string, frame_idx long, time_sec double")
    p = spark.createDataFrame([("a", 0, "R", 1, 0.0, 0.0), ("a", 1, "R", 1, 10.0, 0.0), ("a", 1, "R", 2, 7.0, 0.0)], "song_id string, frame_idx long, hand string, finger int, x double, y double")
    q = spark.createDataFrame([("a", 0, 0.05), ("a", 1, 0.16)], "song_id string, query_id long, at double")
    got = {(r.query_id, r.finger): r.x for r in timeline.interpolated_points(q, f, p).collect()}
    if right == 0.1:
        assert got[0, 1] == 5.0 and got[0, 2] == 7.0
    else:
        assert got == {(0, 1): 0.0}


def test_islands_and_range_join(spark):
    e = spark.createDataFrame([("a", t, v) for t, v in [(0.0, 100), (1.0, 0), (2.0, 127), (3.0, 127)]], "k string, t double, v int")
    i = timeline.islands(e, ["k"], "t", [], F.col("v") >= 64)
    assert rows(i, "start_sec", "end_sec") == [(0.0, 1.0), (2.0, 3.0)]
    q = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", 2.5), (None, 2.5)], "k string, at double")
    assert rows(timeline.range_join(q, i, ["k"], "at", "start_sec", "end_sec", 0.5), "at") == [(1.0,), (2.5,)]


def test_asof_over_stretches(spark):
    rng = random.Random(11)
    f = [("a", i, round(rng.random() * 900, 1)) for i in range(60)] + [("a", 99, None), ("b", 0, 400.0)]
    q = [("a", i, round(rng.random() * 900, 1)) for i in range(80)] + [("a", 900, None), ("b", 1, 1.0), ("b", 2, 899.0), (None, 3, 5.0)]
    got = timeline.neighbours_two_sided(spark.createDataFrame(q, "k string, q long, at double"), spark.createDataFrame(f, "k string, f long, t double"), ["k"], "at", "t", "f")
    want = set()
    for k, i, at in q:
        own = sorted((t, n) for s, n, t in f if s == k and t is not None and at is not None)
        before, after = [x for x in own if x[0] <= at][-1:], [x for x in own if x[0] > at][:1]
        want.add((k, i, *(before[0] if before else (None, None)), *(after[0] if after else (None, None))))
    assert {(r.k, r.q, r.before_at, r.before_id, r.after_at, r.after_id) for r in got.collect()} == want


def test_positions_over_stretches(spark):
    rng = random.Random(12)
    d = [(rng.choice("ab"), i, float(rng.randrange(900))) for i in range(120)]
    got = timeline.positions(spark.createDataFrame(d, "k string, i long, t double"), ["k"], "t", ["i"], "n", F.col("i") % 3 == 0)
    for r in got.collect():
        assert r.n == sum(k == r.k and i % 3 == 0 and (t, i) < (r.t, r.i) for k, i, t in d)


def test_long_song_as_of_is_linear(spark):
    n = 40_000
    f = spark.range(n).selectExpr("'a' AS song_id", "id AS frame_idx", "id * 0.1 AS time_sec")
    q = spark.range(n).selectExpr("'a' AS song_id", "id AS query_id", "id * 0.1 + 0.04 AS at")
    began = time.time()
    got = timeline.neighbours_two_sided(q, f, ["song_id"], "at", "time_sec", "frame_idx").where("before_id = query_id AND (after_id = query_id + 1 OR query_id = 39999)")
    assert got.count() == n and time.time() - began < 20
