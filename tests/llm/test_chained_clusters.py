"""Documents that share passages in chains without being alike: one cluster of candidates, hardly any links."""

import random

import numpy as np

from cadenza.llm import ngram_join
from cadenza.llm.shingles import shingle_sets
from tests.llm.test_dedup import classes, shingles, similar


def chained(n, seed=5):
    """Each text shares a passage with the one before and one with the next; a few near copies of others."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice("abcdefghij") + "".join(rng.choice("klmnopq") for _ in range(6)) for _ in range(k)]
    passages = [some(30) for _ in range(n + 1)]
    out = [" ".join(passages[i] + passages[i + 1] + some(rng.randrange(0, 3))) for i in range(n)]
    for _ in range(20):
        w = some(40)
        out += [" ".join(w), " ".join(w[:-1] + some(1))]
    return out


def shuffled(spark, f):
    """What f returns, and how many rows its shuffles wrote."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def stages():
        empty = jvm.java.util.ArrayList
        found = store.stageList(empty(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    out = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(v for k, v in stages().items() if k not in before)


def test_chains(spark):
    """Same links whatever the tiles, and a chained cluster's sets are not sent to each of its tiles."""
    texts = chained(300)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole, one = shuffled(spark, lambda: sorted(map(tuple, ngram_join.near_duplicates(d).collect())))
    tiled, many = shuffled(spark, lambda: sorted(map(tuple, ngram_join.near_duplicates(d, tile=2).collect())))
    ids, sets = list(range(len(texts))), list(map(shingles, texts))
    want = classes(ids, sets, similar)
    assert {i: c for i, _, c in whole} == want and tiled == whole
    assert sum(i != c for i, c in want.items()) == 20
    assert many < 3 * one, (one, many)


def test_sketch_tiles(spark):
    """Sketches meet across tiles and size bands."""
    texts = chained(300, seed=9)
    for i in range(60):  # sizes next to a copy's by up to a fifth
        w = texts[i].split()
        texts.append(" ".join(w[: len(w) - 1 - i % 9]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [sorted(map(tuple, ngram_join.near_duplicates(d, **k).collect())) for k in ({}, {"tile": 2, "sketch_tile": 3}, {"tile": 2, "sketch_bytes": 100})]
    want = classes(list(range(len(texts))), list(map(shingles, texts)), similar)
    assert {i: c for i, _, c in runs[0]} == want
    assert runs[1] == runs[0] and runs[2] == runs[0]


def test_close_forest():
    """All pairs that are similar are connected, sketches of two sizes included."""
    bands = ngram_join.Bands(ngram_join.Fraction(4, 5))
    rng = np.random.default_rng(4)
    sets = []
    for n in (30, 37, 70, 130, 160, 1000, 1100):
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        sets += [base, *(np.sort(np.concatenate([base[cut:], rng.integers(0, 1 << 64, n // 20, np.uint64)])) for cut in (0, 1, n // 20))]
    sets += list(shingle_sets(chained(40), 5))
    n = np.asarray(list(map(len, sets)))
    band = bands.band(n)
    x = [ngram_join.parities(s, bands.bits(b)) for s, b in zip(sets, band.tolist(), strict=True)]
    for low in np.unique(band).tolist():
        for up in (0, 1):
            here = np.flatnonzero((band == low) | (band == low + up))
            side = (band[here] != low).astype(np.int32)
            a, b = ngram_join.close_forest([x[i] for i in here], n[here], side, bands)
            want = classes(list(range(len(here))), [set(sets[i].tolist()) for i in here], similar) if not up else {}
            root = dict(zip(a.tolist(), b.tolist(), strict=True))
            assert all(root.get(i, i) == root.get(c, c) for i, c in want.items())
            for i in np.flatnonzero(side == 0).tolist():
                for j in np.flatnonzero(side == 1).tolist():
                    if similar(set(sets[here[i]].tolist()), set(sets[here[j]].tolist())):
                        assert root.get(i, i) == root.get(j, j)
