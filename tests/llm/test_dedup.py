import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import common, embedding_dedup, ngram_join, suffix_dedup
from cadenza.llm.queries import ORACLE, QUERIES
from tests.duck import connect, same


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(ids, sets, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if links(sets[a], sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_ngram_join_brute_force(spark, mixed_texts):
    ids = [i * 7 % 1009 for i in range(len(mixed_texts))]
    d = spark.createDataFrame(list(zip(ids, mixed_texts, strict=True)), "doc_id long, text string")
    sets = list(map(shingles, mixed_texts))
    want = classes(ids, sets, similar)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d).collect()}
    assert got == {i: (len(s), want[i]) for i, s in zip(ids, sets, strict=True)}
    assert len(set(want.values())) < len(ids)


def test_ngram_join_tiles(spark, mixed_texts):
    d = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string")
    a, b = (sorted(map(tuple, ngram_join.near_duplicates(d, tile=t).collect())) for t in (1024, 2))
    assert a == b


def test_ngram_join_odd_rows(odd_docs, empty_docs):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in ngram_join.near_duplicates(odd_docs).collect())
    assert got == [(-1, 1, -1), (1, 16, 1), (2, 16, 1), (2, 16, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (7, 0, 7), (8, 16, 1)]
    assert ngram_join.near_duplicates(empty_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 60), min_size=1, max_size=60, unique=True), st.integers(0, 12), st.integers(0, 12), st.booleans())
def test_signatures_are_shared(base, cut, add, frequent):
    a = np.unique(np.asarray(base, np.uint64))
    b = np.unique(np.concatenate([a[: len(a) - min(cut, len(a) - 1)], np.arange(add, dtype=np.uint64) + np.uint64(1 << 61)]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 80 * (len(a) + len(b) - both):
        s, o = ngram_join.signatures([a, b], ngram_join.Bands(Fraction(4, 5)), a[::2] if frequent else np.empty(0, np.uint64))
        assert set(s[o == 0]) & set(s[o == 1])


def test_components_chain(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(links, common.Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000
    assert common.components(links.limit(0), common.Scratch(spark, "t")).count() == 0


def removed(texts, length=100):
    """(bytes, removed, spans, kept) by a set of all strings seen."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(t[s : s + length])
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}


def test_suffix_dedup_brute_force(spark, mixed_texts):
    texts = [*mixed_texts, "Und " * 400, "Und " * 300 + "ende", "é" * 120, "x" * 99, "x" * 100, "x" * 101, "x" * 350]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = removed([t.encode() for t in texts])
    assert digest(suffix_dedup.without_repeats(d).collect()) == dict(enumerate(want))


def test_suffix_dedup_crowded_grams(spark, mixed_texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD_SHARE", -1.0)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    try:
        d = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string").repartition(3)
        assert digest(suffix_dedup.without_repeats(d).collect()) == dict(enumerate(removed([t.encode() for t in mixed_texts])))
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_suffix_dedup_odd_rows(odd_docs, empty_docs):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(odd_docs, carry=("k", "source")).collect()]
    n = len("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon")
    assert sorted(x for x in got if x[0] in (1, 2, 3, 4, 7)) == [(1, n, 0), (2, n, n), (2, n, n), (3, 0, 0), (4, 0, 0), (7, 4, 0)]
    assert (5, 150_000, 149_995) in got and (None, 7, 0) in got
    assert suffix_dedup.without_repeats(empty_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=6))
def test_equal_classes(parts):
    buf = np.frombuffer(("".join(parts) + "ab" * 120).encode(), np.uint8)
    start = np.arange(len(buf) - 99)
    order, cls = suffix_dedup.equal_classes(buf, start, 100)
    assert sorted(order) == start.tolist()
    by = {}
    for i, c in zip(order, cls, strict=True):
        by.setdefault(c, set()).add(bytes(buf[i : i + 100]))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def near_graph(rows, threshold=0.98):
    ok = [(i, np.asarray(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    link = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold
    n = {i: sum(link(a, b) for b in ok if b[0] != i) for i, *_ in rows for a in ok if a[0] == i}
    comp = classes([a[0] for a in ok], ok, link)
    return {i: (n.get(i, 0), comp.get(i, i), comp.get(i, i) == i) for i, *_ in rows}


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 10))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + (i // 12) * 0.03 * rng.standard_normal(10)], i % 2) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 10, 1), (202, [float("nan")] * 10, 1), (203, [None] + [1.0] * 9, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [float("inf")] + [1.0] * 9, 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    d = spark.createDataFrame([(i, v, lab, i, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, id long, n string")
    for tile in (1024, 8):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(d, tile=tile).collect()}
        assert got == near_graph(rows)
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op7_suffix_array_dedup"])
def test_oracles(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE[name], connect(sf_dir))
