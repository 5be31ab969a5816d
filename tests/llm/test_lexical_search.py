"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import lexical_search as L
from cadenza.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(L.TERM, (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = {t for i, text in items if i == item for t in terms(text)}
        got = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                got.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(got)[:k], 1)]
    return sorted(map(str, out))


def collected(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdéfg") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    docs = []
    for i in range(400):
        topic = vocab[(i * 7) % 250 :][:40]
        docs.append((i, " ".join(rng.choice(topic if rng.random() < 0.6 else vocab) for _ in range(rng.randrange(1, 90)))))
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(900, None), (901, ""), (902, "-- !!"), (None, docs[3][1]), (3, docs[3][1]), (903, "A1_b2 漢字x " * 5)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, docs[3][1]), (31, "nothing-of-this qqq"), (32, None), (33, "a1_B2"), (None, docs[5][1]), (30, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("leaves,group,cluster,visits", [(1, 1 << 20, 1024, (2, 16)), (8, 1500, 16, (1, 4)), (4, 4000, 5, ())])
def test_same_as_plain_ranking(spark, corpus, leaves, group, cluster, visits):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    scratch = Scratch(spark, "t")
    index = L.build(d, scratch, leaves, group, cluster)
    assert collected(L.search(index, i, scratch, visits=visits, together=4)) == plain(docs, items)


def test_few_clusters_are_visited(spark, corpus):
    """Items made of a topic's words stop early, and the bounds hold for every cluster."""
    docs = [(i, " ".join(f"t{i % 40}w{(i * j) % 9}" for j in range(1, 30)) + (" common" if i // 40 % 3 else "")) for i in range(2000)]
    items = [(i, " ".join(f"t{i}w{j}" for j in range(9)) + " common") for i in range(40)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    scratch = Scratch(spark, "t")
    index = L.build(d, scratch, leaves=8, group_terms=20_000, cluster_docs=50)
    got = L.search(index, q, scratch)
    assert collected(got) == plain(docs, items)
    clusters = index.rows.where("term IS NULL").count()
    bounds = spark.read.parquet(f"{scratch.root}/bounds").count()
    visited = sum(spark.read.parquet(f"{scratch.root}/todo{s}").count() for s in range(3))
    assert clusters >= 40 and bounds >= 35 * clusters and visited < bounds / 4


def test_odd_rows(spark, odd_docs, empty_docs):
    docs, items = odd_docs.drop("k"), [(1, "alpha omega WORD é"), (2, "one")]
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS cluster", "3 AS item")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items)
    assert collected(L.ranked(docs.selectExpr("*", "1 AS id", "2 AS n", "3 AS leaf", "4 AS part"), q)) == want
    assert L.ranked(empty_docs, q).count() == 0
    assert L.ranked(docs, q.limit(0)).count() == 0


def test_long_documents_in_blocks(spark, monkeypatch):
    text = "alpha beta gamma, " * 50_000 + "last"
    whole = next(L.terms_of([text.encode()]))
    monkeypatch.setattr(L, "BLOCK", 1000)
    parts = next(L.terms_of([text.encode()]))
    pairs = lambda t: dict(zip(t.terms.to_pylist(), t.tf.tolist(), strict=True))
    assert pairs(whole) == pairs(parts) == {b"alpha": 50_000, b"beta": 50_000, b"gamma": 50_000, b"last": 1} and int(parts.n[0]) == 150_001


def test_bisection_parts_topics():
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.arange(256) % 2)
    lists = [np.unique(rng.integers(0, 40, 25) + 40 * t) for t in topic]
    postings = L.Postings(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists))
    left, right = L.halves(postings, np.arange(256), 20)
    assert sorted([*left, *right]) == list(range(256)) and len(set(topic[left])) == len(set(topic[right])) == 1
    assert sorted(np.concatenate(L.bisected(postings, np.arange(256), 10))) == list(range(256))
    tree = L.Tree.fitted(L.Postings(postings.ends, postings.terms), np.arange(256), 1)
    leaf = tree.leaf(*postings.of(np.arange(256)), 256)
    assert len(set(leaf[topic == 0])) == len(set(leaf[topic == 1])) == 1
