"""Ordered folds against plain loops, and on long dense timelines."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import matching, refine, signal, timeline
from cadenza.operators.folds import greedy_nearest, ordered_fold


def plain_greedy(truth, pred, reach):
    used, out = set(), []
    for t in sorted(truth):
        near = [(abs(p[1] - t[1]), p[0]) for p in pred if p[0] not in used and abs(p[1] - t[1]) <= reach]
        used |= {min(near)[1]} if near else set()
        out.append((t[0], min(near)[1] if near else None))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_greedy_nearest(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 5, 60])
    truth = [(i, rng.randrange(40) / 8) for i in rng.sample(range(200), n)]
    pred = [(i, rng.randrange(40) / 8) for i in rng.sample(range(200), rng.choice([0, 3, 60]))]
    got = [(t[0], p and p[0]) for t, p in greedy_nearest(truth, pred, 0.25)]
    assert got == plain_greedy(truth, pred, 0.25)


def test_dense_runs_of_one_pitch(spark):
    """50,000 notes of a pitch without a gap."""
    one = spark.range(50_000).select(F.lit("s").alias("song"), F.col("id").alias("pos"), F.lit(60).alias("pitch"), (F.col("id") * 0.01).alias("onset_sec"), F.lit("L").alias("hand"), F.lit(1).alias("finger"))
    began = time.time()
    got = matching.joined_notes(one, one.withColumn("onset_sec", F.col("onset_sec") + 0.004), ["song"])
    assert got.where("pos = pred_pos").count() == 50_000 and time.time() - began < 20


def test_missing_onsets_match_nothing(spark):
    s = "song string, pos long, pitch int, onset_sec double, hand string, finger int"
    t = spark.createDataFrame([("a", 0, 60, None, "L", 1), ("a", 1, 60, 1.0, "R", None), (None, 2, None, 2.0, None, None)], s)
    p = spark.createDataFrame([("a", 0, 60, None, "L", 1), ("a", 1, 60, 1.05, "L", 3), (None, 2, None, 2.0, "R", 5)], s)
    got = {r.pos: (r.pred_pos, r.pred_hand, r.pred_finger) for r in matching.joined_notes(t, p, ["song"]).collect()}
    assert got == {0: (None, None, None), 1: (1, "L", 3), 2: (2, "R", 5)}


def test_dense_stretches(spark):
    """100,000 rows without a gap, each cluster anchored at its first row; other columns stay as they are."""
    rows = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 0.013).alias("t"), F.col("id"), F.array(F.col("id")).alias("other"))
    began = time.time()
    got = timeline.anchored_clusters(rows, ["k"], "t", ["id"], 0.05).orderBy("id").collect()
    assert time.time() - began < 10
    first, number = None, -1
    for r in got:
        if first is None or r.t - first > 0.05:
            first, number = r.t, number + 1
        assert r["cluster"] == number and r.other == [r.id]


def test_rows_without_a_time(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", 0.0, 2), (None, 5.0, 3), ("a", 0.2, 4)], "k string, t double, i int")
    assert {r.i: r.cluster for r in timeline.anchored_clusters(d, ["k"], "t", ["i"], 0.1).collect()} == {1: None, 2: 0, 3: 0, 4: 1}
    assert timeline.anchored_clusters(d.limit(0), ["k"], "t", ["i"], 0.1).count() == 0


def plain_continuity(frames, reach=3, near=100.0):
    """frames: list of lists of [hand, x] in order."""
    for i, own in enumerate(frames):
        if len(own) == 1:
            votes = [h == own[0][0] for j in range(max(0, i - reach), min(len(frames), i + reach + 1)) if j != i for h, x in frames[j] if abs(x - own[0][1]) < near]
            if votes.count(False) > 2 * votes.count(True):
                own[0][0] = "R" if own[0][0] == "L" else "L"
    return frames


@pytest.mark.parametrize("n", [1, 3, 4, 7, 200])
def test_continuity_over_windows(spark, n):
    rng = random.Random(n)
    frames = [[[h, float(rng.randrange(0, 400, 40))] for h in sorted(rng.choice(["", "L", "R", "L", "R", "LR"]))] for _ in range(n)]
    for f in frames:
        if len(f) == 2 and f[0][1] > f[1][1]:
            f[0][1], f[1][1] = f[1][1], f[0][1]
    hands = [("s", i, h, x) for i, f in enumerate(frames) for h, x in f]
    fd = spark.createDataFrame([("s", i) for i in range(n)], "song_id string, frame_idx long")
    hd = spark.createDataFrame(hands, "song_id string, frame_idx long, hand string, x double")
    want = sorted((i, h, x) for i, f in enumerate(plain_continuity(frames)) for h, x in f)
    assert sorted((r.frame_idx, r.hand, r.x) for r in refine.continuous(hd, fd).collect()) == want


def plain_means(x, rounds=20):
    c = np.stack([x[0], x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]])
    own = None
    for _ in range(rounds):
        new = np.linalg.norm(x - c[1], axis=1) < np.linalg.norm(x - c[0], axis=1)
        if own is not None and (new == own).all():
            break
        own = new
        for k in (0, 1):
            if (own == k).any():
                c[k] = x[own == k].mean(axis=0)
    return own.astype(int), np.linalg.norm(c[0] - c[1])


def test_two_means_by_rounds(spark):
    rng = np.random.default_rng(6)
    data = {k: rng.normal(size=(n, 2)) + (rng.integers(0, 2, n) * k)[:, None] for k, n in ((0, 1), (1, 2), (2, 50), (3, 400), (4, 7))}
    data[4][:] = 1.5
    d = spark.createDataFrame([(k, i, float(a), float(b)) for k, x in data.items() for i, (a, b) in enumerate(x)] + [(2, 99, None, 1.0)], "k int, i long, a double, b double")
    got = {(r.k, r.i): (r.cluster, r.separation) for r in signal.two_means(d, ["k"], ["a", "b"], "i").collect()}
    assert len(got) == sum(map(len, data.values()))
    for k, x in data.items():
        own, gap = plain_means(x)
        assert [got[k, i][0] for i in range(len(x))] == own.tolist() and abs(got[k, 0][1] - gap) < 1e-9


def test_folds_refuse_columns_twice(spark):
    with pytest.raises(ValueError):
        ordered_fold(spark.range(1), ["id"], [], ["id"], lambda: None, "id long, x long")
