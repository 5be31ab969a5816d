"""Queries that answer for all of their input, against brute force and the whole form of their SQL."""

from cadenza.operators import signal
from cadenza.plans import analogue as A
from cadenza.plans import catalogue, catalogue2
from tests.duck import connect, same


def test_leave_times_of_all_notes(spark, sf_dir):
    same(catalogue.first_run3(spark, sf_dir), catalogue2.ORACLE["first_run3"], connect(sf_dir))


def test_all_notes_are_reconciled(spark, sf_dir):
    notes, points, frames = (f(spark, sf_dir).collect() for f in (A.notes, A.points, A.frames))
    pedal = [(r.song_id, r.start_sec, r.end_sec) for r in catalogue._pedal(spark, sf_dir).collect()]
    near, tracks = {}, {}
    for p in points:
        near.setdefault((p.song_id, p.frame_idx), []).append(p.wi)
    for f in sorted(frames, key=lambda f: (f.time_sec, f.frame_idx)):
        tracks.setdefault(f.song_id, []).append((f.time_sec, near.get((f.song_id, f.frame_idx), [])))
    due = {}
    for n in notes:
        track, end = tracks[n.song_id], n.start_sec + n.duration_sec
        away = [all(abs(w - n.wi) > 1.5 for w in wis) for _, wis in track]
        left = min((t for i, (t, _) in enumerate(track) if t >= n.start_sec and len(away) >= i + 3 and all(away[i : i + 3])), default=None)
        seen = any(wis and n.start_sec - 0.15 <= t <= n.start_sec + 0.15 for t, wis in track)
        held = any(s == n.song_id and a <= end <= b for s, a, b in pedal)
        off = seen and held and left is not None and end - left >= 0.15 and left - n.start_sec >= 0.12
        ghost = seen and n.distance > 2.5
        flags = ["ghost"] * ghost + ["dropped"] * (ghost and n.velocity < 30) + ["depedaled"] * off
        due[n.song_id, n.note_idx] = ",".join(flags), n.duration_sec if off else None, left - n.start_sec if off else None
    got = catalogue.reconcile_notes(spark, sf_dir).collect()
    assert len(got) == len(due) == len(notes)
    assert {(r.song_id, r.note_idx): (r.flags, r.audio_duration_sec, r.trimmed_duration_sec) for r in got} == due
    assert {"ghost", "ghost,dropped", "depedaled"} <= {f for f, _, _ in due.values()}


def test_points_at_all_onsets(spark, sf_dir):
    same(catalogue.asof_two_sided(spark, sf_dir), catalogue2.ORACLE["asof_two_sided"], connect(sf_dir))


def test_density_of_all_onsets(spark, sf_dir):
    notes = A.notes(spark, sf_dir).collect()
    last = {}
    for n in notes:
        last[n.song_id] = max(last.get(n.song_id, 0), int(n.start_sec / 0.05))
    due = {(s, b): 0 for s, most in last.items() for b in range(most + 1)}
    for n in notes:
        due[n.song_id, int(n.start_sec / 0.05)] += 1
    got = catalogue.onset_density(spark, sf_dir)
    assert {(r.song_id, r.bin): r.n for r in got.collect()} == due
    assert sum(due.values()) == len(notes) and got.count() == len(due)
    same(got, catalogue2.ORACLE["onset_density"], connect(sf_dir))


def test_density_reaches_each_ones_last_time(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("b", 0.25), ("b", -1.0)], "song_id string, t double")
    got = signal.onset_density(d, ["song_id"], "t", width=0.25).collect()
    assert {(r.song_id, r.bin): r.n for r in got} == {("a", 0): 1, ("a", 1): 0, ("a", 2): 1, ("b", 0): 0, ("b", 1): 1}
    assert [(r.bin, r.n) for r in signal.onset_density(d.where("t < 0"), ["song_id"], "t").collect()] == [(0, 0)]
