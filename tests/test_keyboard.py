import pytest
from pyspark.sql import functions as F

from cadenza.functions import colour, music, text
from cadenza.operators import keyboard


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_white_index_round_trip(spark):
    d = spark.range(21, 109).select(F.col("id").cast("int").alias("p"))
    assert d.where(music.nearest_pitch(music.white_index(F.col("p"))) != F.col("p")).count() == 0
    assert one(spark, music.note_name(F.lit(60)), music.note_name(F.lit(21)))[:] == ("C4", "A0")


def test_groups():
    sizes = [len(g) for g in keyboard.expected_groups(21, 108)]
    assert sizes[0] == 1 and sizes[1:5] == [2, 3, 2, 3] and keyboard.expected_groups(21, 108)[0] == [22]


def test_alignment(spark):
    d = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 1, 2, 3, 2, 3, 1])] + [("b", i, 1) for i in range(7)], "k string, grp int, size int")
    got = {(r.k, r.grp): r.pitches for r in keyboard.aligned_groups(d, ["k"], 60, 84).collect()}
    assert got["a", 0] is None and got["a", 2] == [61, 63] and got["a", 5] == [78, 80, 82] and not any(k == "b" for k, _ in got)


def test_titles(spark):
    got = one(spark, text.parsed_title(F.lit("Bach - Air (Hard) Piano Tutorial | Some channel")).alias("t")).t
    assert (got.artist, got.title, got.difficulty, got.genre) == ("Bach", "Air", "advanced", "Piano")
    assert one(spark, text.parsed_title(F.lit("Air by Bach")).alias("t")).t[:2] == ("Bach", "Air")
    assert one(spark, text.without_suffix(F.lit("/a/b/piece.fingering.json")), text.unbraced(F.lit(" {a b} ")))[:] == ("/a/b/piece", "a b")


@pytest.mark.parametrize("rgb,hand,conf", [((198.0, 52.0, 48.0), "L", 0.9), ((52.0, 48.0, 198.0), "R", 0.9), (None, "L", 0.0)])
def test_references(spark, rgb, hand, conf):
    h, c = colour.nearest_reference([F.lit(v) for v in rgb] if rgb else [F.lit(None).cast("double")] * 3, {"LH_white": (200.0, 50.0, 50.0), "RH_white": (50.0, 50.0, 200.0)})
    got = one(spark, h.alias("h"), c.alias("c"))
    assert got.h == hand and got.c >= conf
    assert colour.nearest_reference([F.lit(1.0)] * 3, {})


def test_splits(spark):
    d = spark.createDataFrame([("a", p) for p in (40, 43, 64, 67)] + [("b", p) for p in (40, 50, 60)], "k string, pitch int")
    assert [tuple(r) for r in keyboard.hand_splits(d, ["k"]).collect()] == [("a", 43, 64, 40, 67)]


def test_homography(spark):
    h = music.solve_homography([(0, 0), (2, 0), (2, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    u, v = music.homography(h, F.lit(1.0), F.lit(0.5))
    got = one(spark, u, v)
    assert abs(got[0] - 0.5) < 1e-9 and abs(got[1] - 0.5) < 1e-9
    row = music.fit_row([0.0, 0.5, 1.0], [10.0, 60.0, 110.0], [5.0, 5.0, 5.0])
    assert all(abs(a - b) < 1e-6 for a, b in zip(row, [100, 10, 0, 5, 0], strict=True))
    assert music.fit_row([0.0, 1.0], [0.0, 1.0], [0.0, 0.0]) is None and music.fit_row([0.5] * 4, [1.0] * 4, [2.0] * 4) is None
    assert keyboard.crop_box([100.0, 0.0, 0.0, 500.0, 0.0], 1920, 1080)[0] == 100


def test_row_fits_are_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(6):
        a, b, c, d, e = rng.uniform(200, 1800), rng.uniform(0, 100), rng.uniform(-50, 50), rng.uniform(100, 900), rng.uniform(-0.3, 0.5)
        u = np.sort(rng.uniform(0, 1, 36))
        w = e * u + 1
        x, y = (a * u + b) / w + rng.normal(0, k, 36), (c * u + d) / w + rng.normal(0, k, 36)
        want[k] = music.fit_row(u.tolist(), x.tolist(), y.tolist())
        rows += [(k, *map(float, p)) for p in zip(u, x, y, strict=True)]
        if not k:
            assert np.allclose(want[0], [a, b, c, d, e])
    rows += [(90, 0.1, 1.0, 1.0), (90, 0.2, 2.0, 1.0), (91, 0.5, 1.0, 2.0), (91, 0.5, 2.0, 3.0), (91, 0.5, 3.0, 4.0), (92, None, 1.0, 1.0)]
    got = {r.k: r.row for r in keyboard.row_fits(spark.createDataFrame(rows, "k int, u double, x double, y double"), ["k"]).collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        assert np.allclose(got[k], row, rtol=1e-6, atol=1e-6)
