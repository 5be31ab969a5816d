"""Collocations against a plain count over lists of words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import collocations as C
from cadenza.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=5, top=2000):
    """rows: (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    often = {key: c for key, c in f.items() if c >= least}
    for (lang, w), a in often.items():
        if len(w) < 2 or any(c >= a and lang == lang2 and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (lang2, v), c in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    rank, got = Counter(), []
    for lang, score, a, phrase, l, r, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, l, r, total, -score))
    return sorted(got)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["a", "b", "É", "new", "york", "times", "of", "the", "x\x00y", "漢字"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", " ?"]
    out = []
    for i in range(150):
        t = "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.randrange(0, 60)))
        out.append((rng.choice(["en", "en", "de", None]), rng.choice(["New york TIMES ", "of the the "]) * rng.randrange(0, 4) + t))
    return [*out, ("en", None), ("en", ""), ("de", " \t\n.,"), ("und", "new york"), ("en", "one two " * 300), ("en", "one two " * 300)]


@pytest.mark.parametrize("shard", [7, 100, 1 << 20])
def test_same_as_plain_counts(spark, texts, shard):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    want = plain(texts, 12)
    assert len(want) > 20
    assert collected(C.collocations(docs, least=12, shard=shard)) == want


def test_ranks_are_cut_and_ties_go_by_phrase(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert collected(C.collocations(docs, least=12, top=3)) == plain(texts, 12, top=3)
    assert collected(C.collocations(docs, least=12, most=2)) == plain(texts, 12, most=2)


def test_blocks_of_text_are_seams_free(spark, texts, monkeypatch):
    """Blocks may end inside pieces and words, and words may be longer than a block."""
    monkeypatch.setattr(W, "BLOCK", 13)
    split = W.SpaceWords()
    for _, t in [*texts, (None, "w" * 50 + " end. " + "v" * 40)]:
        data = (t or "").encode()
        got = [(w.as_py().decode(), bool(x)) for words, new in split.blocks(data) for w, x in zip(words, new, strict=True)]
        want = [(w, i == 0) for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)) for i, w in enumerate(re.findall(r"[^\x20\x09]+", p))]
        assert got == want


def test_products_beyond_64_bits(spark):
    """Counts near 2^40 as sums of shards: the score stays exact."""
    big = 1 << 40
    rows = [("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)]
    f = spark.createDataFrame(rows, "lang string, phrase string, f long")
    over = (1000 * (big - 7) * (1 << 43)) // (big * (big + 1))
    keep = C.phrase_counts
    try:
        C.phrase_counts = lambda *a, **k: (f, spark.createDataFrame([("en", 1 << 43)], "lang string, n long"))
        assert collected(C.collocations(spark.createDataFrame([], "lang string, text string"))) == [("en", 1, "a b", big - 7, big, big + 1, 1 << 43, over)]
    finally:
        C.phrase_counts = keep


def test_odd_rows(spark, odd_docs, empty_docs):
    docs = odd_docs.drop("k")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = plain(rows, 2)
    assert collected(C.collocations(docs, least=2)) == want
    assert collected(C.collocations(docs.selectExpr("*", "1 AS phrase", "2 AS f", "3 AS shard", "4 AS code", "5 AS n"), least=2)) == want
    assert C.collocations(empty_docs, least=2).count() == 0


def test_very_long_text_is_many_shards(spark):
    text = "alpha beta gamma delta. " * 100_000
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    got = {r.phrase: r.a for r in C.collocations(docs, shard=1 << 16).collect()}
    assert got == {"alpha beta gamma delta": 100_000}


def test_bitmaps_keep_their_bits():
    rng = np.random.default_rng(3)
    code = np.sort(np.concatenate([np.arange(50), rng.integers(0, 50, 5000)]))
    place = rng.integers(0, 900, len(code))
    maps = C.Bitmaps.of(code * 901 + place, rng.integers(1, 256, len(code)).astype(np.uint8), 901)
    again = C.Bitmaps.unpacked(maps.packed())
    assert again.places == 901 and (again.keys == maps.keys).all() and (again.bits == maps.bits).all()
    words, new = pa.array([b"a", b"b", b"a"], pa.large_binary()), np.array([True, False, False])
    known, maps = C.word_bitmaps(words, new, 0, 5)
    assert known.to_pylist() == [b"a", b"b"] and [bin(int(b)) for b in maps.bits] == ["0b101", "0b10"]


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_no_phrase_is_made_of_rare_ones(spark, monkeypatch, shard):
    """Pairs are frequent here and longer phrases rare, but for one: shards make no rows of any other phrase."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = random.Random(9)
    docs = [("en", " ".join(rng.choice("abcd") for _ in range(60))) for _ in range(20)] + [("en", "v w x y z")] * 40
    made, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda *a: made.append(apply(*a)) or made[-1])
    monkeypatch.setattr(C.Scratch, "drop", lambda *a: None)
    counts, _ = C.phrase_counts(spark.createDataFrame(docs, "lang string, text string").coalesce(1), C.Scratch(spark, "rows"), 40, 5, shard)
    got = {r.phrase: r.f for r in counts.where("phrase LIKE '% % %'").collect()}
    assert got == dict.fromkeys(["v w x", "w x y", "x y z", "v w x y", "w x y z", "v w x y z"], 40)
    assert {r.phrase for m in made if "phrase" in m.columns for r in m.collect()} == {"v w x y", "w x y z", "v w x y z"}
