"""Extra columns with names that operators use themselves, very long texts, and tokenizer files that are not understood."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_extract, license_scan, mixing, ngram_join, packing, quality, suffix_dedup, token_counts
from tests.llm.test_dedup import shingles

NAMES = "k t id s h size shard quota rounds parts taken n n1 k1 k2 rep feature component tiles u a b d y bucket carry __none __mix_key __mix_plan _ __ score license dice ids counts part gone".split()


def crowded(docs):
    """``docs`` with a column of each name, in strings."""
    return docs.select(docs["doc_id"], docs["text"], docs["source"], *(F.lit("odd").alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def docs(odd_docs):
    return odd_docs.drop("k"), crowded(odd_docs.drop("k"))


def rows(df, *names):
    return sorted(str([r[n] for n in names]) for r in df.collect())


def test_clashing_names(docs):
    plain, odd = docs
    for run, names in [
        (ngram_join.near_duplicates, ("doc_id", "n_shingles", "component_id")),
        (token_counts.token_counts, ("doc_id", "n_bytes", "n_tokens")),
        (license_scan.scan, ("doc_id", "license", "n_matches")),
        (suffix_dedup.without_repeats, ("doc_id", "n_removed")),
        (mixing.mix, ("doc_id", "size", "target", "taken")),
    ]:
        assert rows(run(odd), *names) == rows(run(plain), *names), run
    assert sum(r.length for r in packing.pack(odd).collect()) == sum(r.length for r in packing.pack(plain).collect())


def test_clashing_names_carried(docs):
    plain, odd = docs
    got = suffix_dedup.without_repeats(odd, carry=tuple(NAMES))
    assert got.count() == 10 and all(r.carry[n] == "odd" for r in got.collect() for n in NAMES)
    made = mixing.mixed_documents(odd, mixing.mix(odd, factor=2.0))
    assert made.columns == odd.columns and rows(made, "doc_id", "text") == rows(mixing.mixed_documents(plain, mixing.mix(plain, factor=2.0)), "doc_id", "text")
    assert all(r.rounds == "odd" and r["__mix_key"] == "odd" for r in made.collect())


def test_clashing_names_scored(spark, docs):
    plain, odd = docs
    d = "/root/testdata/sf0.01"
    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), quality.Settings(max_train=200, epochs=1))
    assert quality.accepted(odd, model).columns == odd.columns
    assert rows(quality.accepted(odd, model), "doc_id") == rows(quality.accepted(plain, model), "doc_id")


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    long = " ".join(words)
    near = " ".join(words[:100_000] + ["other"] + words[100_000:])
    other = " ".join(f"v{rng.randrange(50_000)}" for _ in range(200_000))
    d = spark.createDataFrame([(1, long), (2, near), (3, other), (4, "x" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d).collect()}
    assert got == {1: (len(shingles(long)), 1), 2: (len(shingles(near)), 1), 3: (len(shingles(other)), 3), 4: (1, 4)}
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.without_repeats(d).collect()}
    # of the near copy only the new word stays, of a repeated letter the first one
    assert gone == {1: 0, 2: len(near) - len("other"), 3: 0, 4: 199_999}


def test_long_piece_is_counted_exactly():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(token_counts.vocabulary("byte_bpe_50k.json"))
    c = token_counts.PrefixCounter(token_counts.vocabulary("byte_bpe_50k.json"))
    text = "ab" * 50_000
    began = time.perf_counter()
    assert c.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    assert time.perf_counter() - began < 30


def test_long_deep_page(spark):
    html = "<div>" * 20_000 + "<p>" + "word " * 200_000
    d = spark.createDataFrame([(1, "http://a.example/1", html)], "page_id long, url string, html string")
    r = html_extract.main_texts(d).first()
    assert r.text == "word " * 199_999 + "word" and r.n_chars == 999_999


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": {"ignore_merges": True}}, {"model": {"byte_fallback": True}}])
@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", token_counts.PrefixCounter), ("word_bpe_49k.json", packing.WordIds)])
def test_other_settings_are_refused(tmp_path, name, kind, change):
    path = token_counts.vocabulary(name)
    kind(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for k, v in change.items():
        spec[k] = {**spec[k], **v} if k == "model" else v
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        kind(str(tmp_path / "odd.json"))
