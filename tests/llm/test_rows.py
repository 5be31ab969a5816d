import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_extract, license_scan, mixing, packing, quality, token_counts, vp_search
from cadenza.llm.queries import ORACLE, QUERIES
from tests.duck import connect, same

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_file(token_counts.vocabulary(name))


TEXTS = [
    "", " ", "\n\n  a\tb", "it's we'll I'D 'tis", "é ☃ 漢字 ǅ Σίσυφος ΣΑΣ", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "x" * 300, "1234567 3.14 ²½", "don't stop now\x1c\x85end",
    "İstanbul ﬁne é ẛ̣", "🙂🙃 👩‍👩‍👧", "   trailing   ", "\r\nA\r\nB", "aa  bb   cc    dd", "_under_score__ $$$ ### !!",
]


def test_token_counts_equal_library(spark, sf_dir, odd_docs, empty_docs):
    lib = library("byte_bpe_50k.json")
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in token_counts.token_counts(d).join(d, "doc_id").collect():
        assert r.n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids), r.text
        assert r.n_bytes == len(r.text.encode()) and r.over_limit == (r.n_tokens > 1024)
    assert token_counts.token_counts(odd_docs).count() == 10 and token_counts.token_counts(empty_docs).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in token_counts.token_counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids)


def test_prefix_counts(spark):
    lib, c = library("byte_bpe_50k.json"), token_counts.PrefixCounter(token_counts.vocabulary("byte_bpe_50k.json"))
    for t in [*TEXTS, "The quick brownish fox's  tail, unbelievably antidisestablishmentarian!"]:
        known = c.boundaries(t)
        for n in range(len(t) + 1):
            if "<|" not in t[max(0, n - 14) : n + 14]:
                assert c.at_prefix(t, n, known) == len(lib.encode(t[:n], add_special_tokens=False).ids), (t, n)
    d = spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.cut, r.n_tokens) for r in token_counts.budget_cut(d, 3).collect()}
    assert got == {1: (len("one two three"), 3), 2: (0, 0)}
    assert {r.doc_id: r.counts[-1] for r in token_counts.prefix_tables(d).collect()} == {1: 5, 2: 0}


def test_licences(spark, sf_dir, odd_docs, empty_docs):
    assert license_scan.Scanner(license_scan.TEMPLATES, 0.8).match("released under the mit license!")[1] == "MIT"
    d = spark.createDataFrame([(1, "x\nReleased under the MIT License.\n" + license_scan.TEMPLATES["ISC"]), (2, license_scan.TEMPLATES["MIT-grant"].replace(" to ", "\nto ")), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice, r.n_matches) for r in license_scan.scan(d).collect()}
    assert got == {1: ("ISC", 1.0, 3), 2: ("MIT-grant", 1.0, 1), 3: (None, None, 0)}
    assert license_scan.scan(odd_docs).where("n_matches > 0").count() == 0 and license_scan.scan(empty_docs).count() == 0
    same(QUERIES["op4_license_scan"](spark, sf_dir), ORACLE["op4_license_scan"], connect(sf_dir))


def test_quality(spark, odd_docs, empty_docs):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    s = quality.score(docs, model).join(labels, "doc_id").where("held_out")
    right, n = s.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 20 and right >= 0.9 * n
    for r in s.select("doc_id", "held_out").collect():
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    none = quality.fit(empty_docs, labels)
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert np.array_equal(model.value, again.value) and model.bias == again.bias  # held-out labels teach nothing
    kept = quality.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns


def check_packing(texts, rows):
    lib = library("word_bpe_49k.json")
    ids = {k: np.append(np.asarray(lib.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(1)) for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes())
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[k])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing(spark, sf_dir, odd_docs, empty_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*TEXTS, None, "word " * 5000])], "doc_id long, text string")
    both = docs.union(extra).repartition(3)
    texts = {r.doc_id: r.text for r in both.collect()}
    rows = packing.pack(both, shard_docs=64)
    check_packing(texts, rows.collect())
    p = packing.padding(rows).first()
    assert p.padded <= 0.01 * p.tokens
    assert packing.pack(odd_docs).where("doc_id = 2 AND start = 0").count() == 2 and packing.pack(empty_docs).count() == 0


def test_sum_of_squares():
    p = packing.SumOfSquares(10)
    for w in (6, 6, 4):
        p.put(0, w)
    assert sorted(p.fill) == [6, 10]
    rng = np.random.default_rng(1)
    for n in (1, 3, 500):
        lens = rng.integers(1, 60, n)
        pieces = packing.place(lens, 16)
        assert sum(x[2] for x in pieces) == lens.sum() and len({x[3] for x in pieces}) == max(x[3] for x in pieces) + 1


def pages():
    chrome = "<nav><a href=/>Home {i}</a></nav><div class='ad'>Buy {i}</div><!-- x -->"
    foot = "<aside>Rel {i}</aside><footer>&copy; {i}</footer>"
    art = "<article><h1>Title {i}</h1><p>First &amp; <b>bold</b>\n  text {i}<br>more<p>Second &eacute;{i}<form>mail <input></form><div id=comments><p>troll {i}</p></div></article>"
    want = "Title {i}\nFirst & bold text {i} more\nSecond é{i}"
    return [(i, f"http://h{i % 3}.example/{i}", ("<html><body>" + chrome + art + foot + "</body></html>").replace("{i}", str(i)), want.replace("{i}", str(i))) for i in range(30)]


def test_pages(spark):
    rows = pages()
    odd = [(100, None, None, ""), (101, "x", "", ""), (102, "http://h0.example/q", "plain <b>text", "plain text"), (103, "http://h1.example/s", "<script>if(a<b){}</script><main>only main<br></main>", "only main"), (0, rows[0][1], rows[0][2], rows[0][3])]
    d = spark.createDataFrame([(*r[:3], 1, "c") for r in rows + odd], "page_id long, url string, html string, k int, host string")
    got = sorted(html_extract.main_texts(d).select("page_id", "text", "n_chars").collect())
    assert got == sorted((r[0], r[3], len(r[3])) for r in rows + odd)
    assert html_extract.main_texts(d.limit(0)).count() == 0


def test_template():
    paths = html_extract.Paths()
    ps = [html_extract.parse(r[2], paths) for r in pages()[:6]]
    t = html_extract.Template(ps, paths)
    frame = [paths.text(p) for p in t.elements]
    assert "/html/body/article" in frame and frame.index("/html/body") < frame.index("/html/body/article")
    assert paths.text(t.container) == "/html/body/article"
    paths = html_extract.Paths()
    divs = [html_extract.parse(f"<body><div class=top>menu</div><div class=x>{'long text of page ' * 9}{i}</div></body>", paths) for i in range(5)]
    assert paths.text(html_extract.Template(divs, paths).container) == "/body/div.x"
    assert (1,) * 6 in html_extract.equivalence_classes(ps)


def test_pages_synthetic(spark, sf_dir):
    import html

    for r in html_extract.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def plain_targets(sizes, weights, total, most):
    """Water level by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(most * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


def test_apportionment():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        votes = rng.integers(0, 1000, n).astype(float)
        for seats in (0, 1, 13, 999):
            want = np.zeros(n, int)
            for _ in range(seats if votes.sum() else 0):
                want[np.argmax(votes / (2 * want + 1))] += 1
            got = mixing.sainte_lague(votes, seats)
            assert got.sum() == want.sum() and np.allclose(np.sort(votes / (2 * got + 1)), np.sort(votes / (2 * want + 1)))
        sizes, w = rng.integers(0, 500, n), np.resize([5.0, 2, 1], n)
        assert np.allclose(mixing.targets_of(sizes, w, 1.5 * sizes.sum(), 2.0), plain_targets(sizes, w, 1.5 * sizes.sum(), 2.0), atol=1e-3)


def test_mix(spark, sf_dir, odd_docs, empty_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = mixing.mix(docs, shard_docs=5)
    rows = m.collect()
    by = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.rounds * r.size + sum(p.hi - p.lo for p in r.parts) and all(0 <= p.lo < p.hi <= r.size for p in r.parts)
        by.setdefault(r.source, []).append(r)
    order = sorted(by)
    want = plain_targets([by[s][0].source_size for s in order], np.resize([5.0, 2, 1], len(order)), 1.5 * sum(r.size for r in rows), 2.0)
    for s, t in zip(order, want, strict=True):
        assert abs(by[s][0].target - t) < 1e-3 and abs(sum(r.taken for r in by[s]) - t) <= 1 and by[s][0].source_size == sum(r.size for r in by[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7), shard_docs=5).collect()))
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == 10 and all(r.taken <= 2 * r.size for r in odd)
    none = [r for r in odd if r.source is None]
    assert sum(r.taken for r in none) == pytest.approx(none[0].target, abs=1) and mixing.mix(empty_docs).count() == 0
    made = mixing.mixed_documents(docs, m)
    words = made.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    assert {r.source: r.n for r in words.collect()} == {s: sum(r.taken for r in v) for s, v in by.items() if sum(r.taken for r in v)}
    assert made.columns == docs.columns
    again = mixing.mixed_documents(odd_docs, mixing.mix(odd_docs, factor=2.0))  # all is taken twice
    assert again.groupBy("doc_id").count().where("doc_id IS NULL").first()["count"] == 2 and again.where("doc_id = 2").count() == 4


def brute_nearest(rows, k):
    ok = [(i, np.asarray(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-float((q * x).sum()), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out |= {(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(best, 1)}
    return out


def test_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * (1 + i % 5)]) for i in range(1200)]
    rows += [(2000 + i, rows[40][1]) for i in range(30)] + [(3000, None), (3020, [0.0] * 8), (3040, [float("nan")] * 8), (3060, [1.0, 2.0])]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, rank int, id string")
    exact = vp_search.nearest(d, relax=1.0, shard_rows=300, sample_rows=100).collect()
    want = brute_nearest(rows, 20)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in exact} == want
    fast = {(r.query_id, r.vec_id) for r in vp_search.nearest(d, shard_rows=300, sample_rows=100).collect()}
    assert len(fast & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    assert vp_search.nearest(d.limit(0)).count() == 0 and vp_search.nearest(d.limit(3)).count() == 2


def test_search_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in d.collect()]
    want = {(q, v) for q, _, v, _ in brute_nearest(rows, 20)}
    got = {(r.query_id, r.vec_id) for r in vp_search.nearest(d).collect()}
    assert len(got & want) >= 0.9 * len(want)
