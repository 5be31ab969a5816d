"""Shares of features that occur more than 65,535 times in a text."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import quality


def test_counts_of_long_texts():
    s = quality.Settings()
    for text in ("", "one two", "word " * 70_000 + "end"):
        ids, counts = quality.document_features(text, s)
        words = text.split()
        due = Counter()
        for w, n in Counter(words).items():
            for f in quality.word_features(w, s):
                due[f] += n
        for a, b in zip(words, words[1:], strict=False):
            due[int(quality.pair_features(np.asarray([quality.word_code(a), quality.word_code(b)], np.uint64), s)[0])] += 1
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == {f: n for f, n in due.items() if n}
        a, b = quality.bag_of(ids.tobytes(), counts.tobytes())
        assert np.array_equal(a, ids) and np.array_equal(b, counts)


def test_long_texts_teach_exact_shares(spark):
    texts = {1: "word " * 70_000 + "end", 3: "some other words", 5: "word end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, quality int").where(~quality.held_out(F.col("doc_id")))
    s = quality.Settings(epochs=1)
    order = [(r.doc_id, r.quality) for r in labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    assert 1 in dict(order)
    exact = [tuple(x.astype(np.int64) for x in quality.document_features(texts[k], s)) for k, _ in order]
    due = quality.train(exact, np.asarray([y for _, y in order]), s)
    got = quality.fit(docs, labels, s)
    assert np.allclose(got.value, due.value, atol=1e-5) and abs(got.bias - due.bias) < 1e-5
