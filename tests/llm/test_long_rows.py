"""Texts of a megabyte through packing and mixing, and pages beside columns of any name."""

import random
import zlib

import numpy as np
import pytest

from cadenza.llm import html_extract, mixing, packing, token_counts


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9_000)}" for _ in range(200_000))
    rows = [(1, long, "a"), (2, long, "a"), (3, "of the software " * 65_000, "b"), (4, "short", "b"), (5, "", None)]
    assert len(long) > 1_000_000
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_packing(long_docs):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.vocabulary("word_bpe_49k.json"))
    pieces = {}
    for r in packing.pack(long_docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d in long_docs.collect():
        ids = np.append(np.asarray(lib.encode(d.text, add_special_tokens=False).ids, np.uint32), np.uint32(1))
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_mixing(long_docs):
    got = {r.doc_id: r for r in mixing.mix(long_docs).collect()}
    assert {k: r.size for k, r in got.items()} == {1: 200_000, 2: 200_000, 3: 195_000, 4: 1, 5: 0}
    total = 595_001
    # 5 to 2 of one and a half times all: shares that none of the two sources reaches twice its size with
    first = min(800_000, 1.5 * total * 5 / 7)
    assert got[1].target == pytest.approx(first) and got[3].target == pytest.approx(min(2 * 195_001, 1.5 * total - first))
    for s in ((1, 2), (3, 4)):
        assert sum(got[k].taken for k in s) == pytest.approx(got[s[0]].target, abs=1) and all(got[k].taken <= 2 * got[k].size for k in s)


def test_pages_beside_other_columns(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=a>Site</div><div class=b><p>First {i}.</p><p>Second {i}.</p></div>") for i in range(6)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    odd = spark.createDataFrame([(*r, "odd", "odd", 1, "odd", "odd") for r in rows], "page_id long, url string, html string, text string, host string, n_chars int, k string, salt string")
    got = [sorted(map(tuple, html_extract.main_texts(d).collect())) for d in (plain, odd)]
    assert got[0] == got[1] == [(i, f"http://h.example/{i}", f"First {i}.\nSecond {i}.", len(f"First {i}.\nSecond {i}.")) for i in range(6)]
