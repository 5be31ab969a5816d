import re

import corpus_pipeline as pipeline
from cadenza.llm import mixing
from tests.llm.test_dedup import classes, removed, shingles, similar


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(400).cache()
    columns = docs.columns
    kept = pipeline.quality_classifier(spark, docs, d).cache()
    assert kept.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    known = [i for i in (r.doc_id for r in docs.collect()) if i in labels]
    assert sum((i in left) == bool(labels[i]) for i in known) >= 0.95 * len(known)

    one = pipeline.near_duplicates(spark, kept, d).cache()
    rows = kept.collect()
    want = classes([r.doc_id for r in rows], [shingles(r.text) for r in rows], similar)
    assert {r.doc_id for r in one.collect()} == set(want.values()) and one.columns == columns

    cut = pipeline.suffix_array_dedup(spark, one, d).cache()
    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    want_n = {r.doc_id: n - gone for r, (n, gone, *_) in zip(rows, removed([r.text.encode() for r in rows]), strict=True)}
    for r in cut.collect():
        assert 0 <= want_n[r.doc_id] - len(r.text.encode()) <= 64 and r.n_chars == len(r.text)  # less split characters
    assert cut.columns == columns

    mixed = pipeline.mixing_sources(spark, cut, d).cache()
    target = {r.source: r.target for r in mixing.mix(cut).collect()}
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(abs(words.get(s, 0) - t) <= 1 for s, t in target.items()) and mixed.columns == columns

    pieces = pipeline.pack(spark, mixed, d)
    assert pieces.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_stages_take_odd_rows(spark, odd_docs, empty_docs, sf_dir):
    clashing = odd_docs.selectExpr("*", "'a' AS _", "1 AS _size", "2 AS id", "3 AS t", "4 AS part", "5 AS component_id", "6 AS kept", "7 AS carry", "8 AS size", "9 AS rounds")
    for docs in (clashing, empty_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            n = out.count()
            assert (name == "packing" or out.columns == docs.columns) and (n == 0 or docs is clashing)


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0 and [n for n, _ in pipeline.STAGES][-1] == "packing"
