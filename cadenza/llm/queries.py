"""The training-data operators as registered queries over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embedding_dedup, html_extract, lexical_search, license_scan, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, vp_search, warc
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_token_counts, op4_license_scan, op5_quality_classifier, op6_packing, op7_suffix_array_dedup, op8_html_main_text, op9_source_mix, op10_vantage_point_search, op11_phrase_collocations, op12_warc_archive, op13_lexical_search)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {}

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE["op10_vantage_point_search"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE["op2_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES.items())
_PAIRS = "list_distinct(list_transform(range(1, len({w})), lambda i: lower({w}[i]) || ' ' || lower({w}[i + 1])))"

ORACLE["op4_license_scan"] = f"""
WITH t AS (SELECT name, {_PAIRS.format(w='w')} AS b FROM (SELECT name, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) v(name, text))),
p AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p, len(string_split(coalesce(text, ''), chr(10) || chr(10))) AS n FROM documents),
u AS (SELECT doc_id, unnest(string_split(p, chr(10))) AS u FROM p
      UNION ALL SELECT doc_id, p FROM p WHERE contains(p, chr(10))
      UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10) || chr(10))),
n AS (SELECT row_number() OVER () AS unit, doc_id, regexp_extract_all(u, '[A-Za-z0-9]+') AS w FROM u),
b AS (SELECT unit, doc_id, {_PAIRS.format(w='w')} AS b FROM n WHERE len(w) > 1),
d AS (SELECT b.unit, b.doc_id, t.name, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice FROM b JOIN t
      ON len(b.b) * 0.8 <= len(t.b) * 1.2 AND len(t.b) * 0.8 <= len(b.b) * 1.2),
m AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, count(DISTINCT unit) AS n_matches FROM d WHERE dice >= 0.8 GROUP BY doc_id)
SELECT documents.doc_id, m.license, m.dice, coalesce(m.n_matches, 0)::BIGINT AS n_matches FROM documents LEFT JOIN m USING (doc_id)
"""

ORACLE["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id
"""

ORACLE["op7_suffix_array_dedup"] = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, b[i + 1 : i + 100] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM t)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n) GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since, hi FROM r),
k AS (SELECT t.doc_id, count(p.lo) AS n_spans, coalesce(sum(p.hi - p.lo), 0) AS n_removed,
      coalesce(string_agg(hex(t.b[p.since + 1 : p.lo]), '' ORDER BY p.lo), '') AS head, coalesce(max(p.hi), 0) AS last FROM t LEFT JOIN p USING (doc_id) GROUP BY t.doc_id)
SELECT t.doc_id, octet_length(t.b)::BIGINT AS n_bytes, k.n_removed::BIGINT AS n_removed, k.n_spans::BIGINT AS n_spans,
  sha256(unhex(k.head || hex(t.b[k.last + 1 : octet_length(t.b)]))) AS kept_sha256 FROM t JOIN k USING (doc_id)
"""

# The pages' articles are flat and use five character references, which SQL can undo.
_DECODED = "b"
for _name, _char in (("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
ORACLE["op8_html_main_text"] = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(regexp_replace({_DECODED.replace("(b,", "(regexp_replace(b, '<[^>]*>', '', 'g'),")}, '\s+', ' ', 'g'), '^ | $', '', 'g'))), lambda x: x <> '') AS b FROM a)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, length(array_to_string(b, chr(10)))::BIGINT AS n_chars FROM b
"""

ORACLE["op11_phrase_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
inside AS (SELECT DISTINCT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM s WHERE k > 2),
c AS (SELECT s.* FROM s ANTI JOIN inside USING (lang, phrase, f) WHERE k > 1),
cut AS (SELECT lang, phrase, f AS a, w, k, unnest(range(1, k)) AS j FROM c),
v AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, t.n, (1000 * a * t.n) // (l.f * r.f) AS score FROM cut JOIN t ON t.lang = cut.lang
      JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:cut.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""

ORACLE["op12_warc_archive"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM r
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op13_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
