"""Ranked lexical search over a clustered index whose order comes from recursive graph bisection.

Bisection halves a set of documents and swaps documents between the halves while that lowers the logarithms of the gaps
that its terms' postings would have; then it goes on in each half. Over a bounded sample it gives a tree; every document
goes down that tree by the gains that the sample's halves give it. What reaches a leaf (cut by hash where it is large) is
bisected further by itself, and stretches of the order so made are the clusters, each with its postings. Documents that
share rare terms come to lie together, so few clusters can hold a query's best.

For each cluster and term the index has the largest contribution to a score; weighted and summed they bound the scores
in a cluster. A query visits the clusters with the highest bounds, then more, then all whose bound reaches its tenth best
score so far. A bound that equals that score is visited too, since ties go by doc_id. So the ranking is exact.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, short_batches
from .words import lowered, words_at

#: Documents of the sample that the tree is fitted on, hashed terms it tells apart, leaves it has at most.
SAMPLE, BUCKETS, LEAVES = 4096, 1 << 14, 64
#: Terms of documents that are bisected together, and of a cluster; documents of a cluster.
GROUP_TERMS, CLUSTER_TERMS, CLUSTER_DOCS = 1 << 21, 1 << 19, 1024
#: Bytes of text that are split at once.
BLOCK = 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_ID = (1 << 63) - 1
INDEX = "cluster long, term string, df long, best long, blob binary"
_INDEX = pa.schema([("cluster", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("best", pa.int64()), ("blob", pa.binary())])
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = lowered()


# --- recursive graph bisection


def _spread(here: np.ndarray, there: np.ndarray, n_here: int, n_there: int) -> np.ndarray:
    """Bits that the postings of terms with so many documents in halves of such sizes take, by logarithms of gaps."""
    here, there = np.maximum(here, 0.0), np.maximum(there, 0.0)  # fewer than none is asked for where nobody looks
    return here * np.log2(n_here / (here + 1.0)) + there * np.log2(n_there / (there + 1.0))


def side_gains(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """For each term the bits that a further document with it saves by joining the left half rather than the right."""
    return _spread(left, right + 1, n_left, n_right) - _spread(left + 1, right, n_left, n_right)


class Postings(NamedTuple):
    """Distinct terms of documents: those of document i are terms[ends[i]:ends[i + 1]]."""

    ends: np.ndarray
    terms: np.ndarray

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in docs, term) of these documents' terms."""
        n = self.ends[docs + 1] - self.ends[docs]
        stop = np.cumsum(n)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.ends[docs] - stop + n, n)
        return np.repeat(np.arange(len(docs)), n), self.terms[at]


def halves(postings: Postings, docs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``docs``: swaps of the documents that gain most, while a swap gains, ``rounds`` times at most."""
    who, term = postings.of(docs)
    _, term = np.unique(term, return_inverse=True)
    terms = int(term.max(initial=-1)) + 1
    n_left = len(docs) // 2
    in_left = np.arange(len(docs)) < n_left
    for _ in range(rounds):
        own = in_left[who]
        left, right = np.bincount(term[own], minlength=terms), np.bincount(term[~own], minlength=terms)
        now = _spread(left, right, n_left, len(docs) - n_left)
        to_right = now - _spread(left - 1.0, right + 1.0, n_left, len(docs) - n_left)
        to_left = now - _spread(left + 1.0, right - 1.0, n_left, len(docs) - n_left)
        gain = np.bincount(who, weights=np.where(own, to_right[term], to_left[term]), minlength=len(docs))
        a, b = np.flatnonzero(in_left), np.flatnonzero(~in_left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        better = gain[a[: len(b)]] + gain[b[: len(a)]] > 1e-9
        swaps = len(better) if better.all() else int(np.argmin(better))
        if not swaps:
            break
        in_left[a[:swaps]], in_left[b[:swaps]] = False, True
    return docs[in_left], docs[~in_left]


def bisected(postings: Postings, docs: np.ndarray, least: int, rounds: int = 5) -> list[np.ndarray]:
    """Documents in stretches of at most ``least``, in the order of the recursion."""
    if len(docs) <= max(1, least):
        return [docs]
    left, right = halves(postings, docs, rounds)
    return bisected(postings, left, least, rounds) + bisected(postings, right, least, rounds)


class Tree(NamedTuple):
    """Inner nodes in heap order: what each bucket gains to the left, and the sum from which a document goes there."""

    gains: np.ndarray
    least: np.ndarray
    depth: int

    @classmethod
    def fitted(cls, postings: Postings, docs: np.ndarray, depth: int, rounds: int = 10) -> Tree:
        gains, least = np.zeros(((1 << depth) - 1, BUCKETS), np.float32), np.zeros((1 << depth) - 1)
        level = {0: docs}
        for _ in range(depth):
            following = {}
            for node, own in level.items():
                if len(own) < 2:
                    following |= {2 * node + 1: own, 2 * node + 2: own[:0]}
                    continue
                left, right = halves(postings, own, rounds)
                count = lambda d: np.bincount(postings.of(d)[1], minlength=BUCKETS)
                gains[node] = side_gains(count(left), count(right), len(left), len(right))
                who, term = postings.of(own)
                least[node] = np.median(np.bincount(who, weights=gains[node][term], minlength=len(own)))
                following |= {2 * node + 1: left, 2 * node + 2: right}
            level = following
        return cls(gains, least, depth)

    def leaf(self, doc: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
        """The leaf of each document, from its terms' buckets (doc, bucket)."""
        node = np.zeros(docs, np.int64)
        for _ in range(self.depth):
            gain = np.bincount(doc, weights=self.gains[node[doc], bucket], minlength=docs)
            node = 2 * node + np.where(gain >= self.least[node], 1, 2)
        return node - ((1 << self.depth) - 1)


# --- terms of documents


class Terms(NamedTuple):
    """Of some documents: where each one's terms begin and end, distinct terms, how often, the documents' lengths."""

    ends: np.ndarray
    terms: pa.Array
    tf: np.ndarray
    n: np.ndarray


def _block_terms(texts: list[bytes]) -> Terms:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    words, start, _ = words_at(buf, _IS_TERM[buf], _LOWER)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends = np.searchsorted(start, first)
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key = np.repeat(np.arange(len(texts)), np.diff(ends)) * size + coded.indices.to_numpy(zero_copy_only=False)
    key, tf = np.unique(key, return_counts=True)
    return Terms(np.searchsorted(key, np.arange(len(texts) + 1) * size), coded.dictionary.take(pa.array(key % size)), tf, np.diff(ends))


def _long_terms(text: bytes) -> Terms:
    """Of one long document, a block at a time; blocks end at bytes that no term has."""
    total, n, at = None, 0, 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and _IS_TERM[text[end]]:
            end += 1
        one = _block_terms([text[at:end]])
        n, at = n + int(one.n[0]), end
        new = pa.table({"t": one.terms, "tf": one.tf})
        total = new if total is None else pa.concat_tables([total, new]).group_by("t").aggregate([("tf", "sum")]).rename_columns(["t", "tf"])
    return Terms(np.array([0, len(total)]), total["t"].combine_chunks(), total["tf"].to_numpy(), np.array([n]))


def terms_of(texts: list[bytes]) -> Iterator[Terms]:
    """The terms of documents in order, a block of short ones or a long one at a time."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield _block_terms(held)
            held, size = [], 0
        if len(t) > BLOCK:
            yield _long_terms(t)
        else:
            held.append(t)
            size += len(t)
    if held:
        yield _block_terms(held)


def _buckets(terms: pa.Array) -> np.ndarray:
    coded = terms.dictionary_encode()
    return np.array([crc32(t) % BUCKETS for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.empty(0, np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in terms_of(batch.column(0).to_pylist()):
            b = _buckets(t.terms)
            out = [np.unique(b[t.ends[i] : t.ends[i + 1]]) for i in range(len(t.n))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["buckets"])


def fitted_tree(docs: DataFrame, leaves: int) -> Tree:
    """From at most SAMPLE rows of ``docs`` (id, text), taken by hash; the tree's size doesn't depend on the table's."""
    depth = max(0, leaves - 1).bit_length()
    rows = docs.count() if depth else 0
    if not rows:
        return Tree(np.zeros((0, BUCKETS), np.float32), np.zeros(0), 0)
    by = F.xxhash64("id", F.octet_length("text"))
    some = docs.where(F.pmod(by, F.lit(1 << 20)) < min(1 << 20, (SAMPLE * 3 // 2 << 20) // rows + 1)) if rows > SAMPLE else docs
    lists = [r[0] for r in some.select("text").mapInArrow(_sampled, "buckets array<long>").limit(SAMPLE).collect()]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    postings = Postings(ends, np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64))
    return Tree.fitted(postings, np.arange(len(lists)), depth)


def _routed(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for t in terms_of(batch.column(1).to_pylist()):
                docs = len(t.n)
                leaf = tree.leaf(np.repeat(np.arange(docs), np.diff(t.ends)), _buckets(t.terms), docs)
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(t.ends), t.terms), pa.scalar(b"\n", pa.large_binary())).cast(pa.binary())
                tf = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((4 * t.ends).astype(np.int32)), pa.py_buffer(t.tf.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch.column(0).slice(at, docs), pa.array(t.n), joined, tf], names=["leaf", "id", "n", "terms", "tf"])
                at += docs

    return go


# --- the index


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs tf times adds to a score, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blob(ids: np.ndarray, m: np.ndarray, terms: pa.Array, ends: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> bytes:
    """Ids, lengths, sorted terms and their postings; documents as gaps, which neighbours make small."""
    text = b"\n".join(terms.to_pylist())
    gap = np.diff(doc, prepend=0)
    first = ends[:-1][ends[:-1] < ends[1:]]
    gap[first] = doc[first]
    raw = b"".join([ids.astype("<i8").tobytes(), m.astype("<i8").tobytes(), np.diff(ends).astype("<u4").tobytes(), gap.astype("<u2").tobytes(), tf.astype("<u4").tobytes(), text])
    return struct.pack("<qqqq", len(ids), len(terms), len(doc), len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


class Cluster:
    """A cluster's postings, with what each asked term adds to its documents' scores."""

    def __init__(self, blob: bytes) -> None:
        docs, terms, postings, size = struct.unpack_from("<qqqq", blob)
        raw = pa.Codec("zstd").decompress(memoryview(blob)[32:], decompressed_size=size, asbytes=True)
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.ids, self.m = take("<i8", docs), take("<i8", docs)
        self.ends = np.concatenate([[0], np.cumsum(take("<u4", terms), dtype=np.int64)])
        self.gap, self.tf = take("<u2", postings), take("<u4", postings)
        self.terms = pa.array(raw[at:].split(b"\n") if terms else [], pa.binary())

    def asked(self, terms: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(documents, parts of scores) of each term; None where the cluster lacks it."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for i in pc.index_in(pa.array(terms, pa.binary()), value_set=self.terms).to_pylist():
            if i is None:
                out.append(None)
                continue
            a, b = self.ends[i], self.ends[i + 1]
            doc = np.cumsum(self.gap[a:b], dtype=np.int64)
            out.append((doc, parts_of(self.tf[a:b].astype(np.int64), self.m[doc])))
        return out


def _indexed(n_docs: int, n_terms: int, cluster_docs: int, cluster_terms: int) -> Callable[[pa.Table], pa.Table]:
    def go(group: pa.Table) -> pa.Table:
        text = group["terms"].to_pylist()
        buf = np.frombuffer(b"\n".join(text) + b"\n", np.uint8)
        words, start, _ = words_at(buf, _IS_TERM[buf], _LOWER)
        ends = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in text)]))
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        vocabulary = coded.dictionary.take(order)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        term = place[coded.indices.to_numpy(zero_copy_only=False)]
        tf = np.frombuffer(b"".join(group["tf"].to_pylist()), "<u4").astype(np.int64)
        n = group["n"].to_numpy()
        ids = group["id"].fill_null(NO_ID).to_numpy()
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
        # a term of one document moves nothing
        often = np.bincount(term, minlength=len(order))[term] > 1
        seen = np.concatenate([[0], np.cumsum(often)])
        postings = Postings(seen[ends], term[often])
        docs = np.concatenate(bisected(postings, np.arange(len(n)), 64)) if len(n) else np.empty(0, np.int64)
        out, base = [], (group["leaf"][0].as_py() << 44) + (group["part"][0].as_py() << 16)
        every = Postings(ends, np.arange(len(term)))
        while len(docs):
            most = max(1, min(cluster_docs, int(np.searchsorted(np.cumsum(n[docs]), cluster_terms, "right"))))
            own, docs = docs[:most], docs[most:]
            doc, at = every.of(own)
            by = np.lexsort((doc, term[at]))
            doc, at = doc[by], at[by]
            first = np.flatnonzero(np.diff(term[at], prepend=-1))
            known = vocabulary.take(pa.array(term[at][first]))
            blob = _blob(ids[own], m[own], known, np.append(first, len(at)), doc, tf[at])
            best = np.maximum.reduceat(parts_of(tf[at], m[own][doc]), first)
            df = np.diff(np.append(first, len(at)))
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(first) + 1, base + len(out))), pa.concat_arrays([known.cast(pa.binary()).view(pa.string()), pa.nulls(1, pa.string())]),
                                                   pa.array(np.append(df, len(own))), pa.array(np.append(best, 0)), pa.array([None] * len(first) + [blob], pa.binary())], schema=_INDEX))
        return pa.Table.from_batches(out, _INDEX)

    return go


class Index(NamedTuple):
    """rows: a cluster's terms with df and best, and (term null) its blob; and the counts that weights need."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, scratch: Scratch, leaves: int = LEAVES, group_terms: int = GROUP_TERMS, cluster_docs: int = CLUSTER_DOCS, cluster_terms: int = CLUSTER_TERMS, key: str = "doc_id", text: str = "text") -> Index:
    """Index all rows of ``docs``; rows without a term are in no cluster. A leaf is cut into as many groups as its terms
    need, so a task holds about ``group_terms`` terms, or one document."""
    if not 1 <= cluster_docs <= 1 << 16:
        raise ValueError("clusters of 1 to 65536 documents are needed")
    short_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    tree = fitted_tree(source, leaves)
    routed = source.mapInArrow(_routed(tree), "leaf int, id long, n long, terms binary, tf binary").where("n > 0")
    routed, seen = scratch.counted(routed, "routed", F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    sizes = {r.leaf: r.terms for r in routed.groupBy("leaf").agg(F.sum("n").alias("terms")).collect()}  # at most LEAVES rows
    parts = F.element_at(F.array(*(F.lit(-(-sizes.get(i, 0) // group_terms) or 1) for i in range(1 << tree.depth))), F.col("leaf") + 1)
    dealt = routed.withColumn("part", F.pmod(F.xxhash64("id", "n"), parts))
    rows = dealt.groupBy("leaf", "part").applyInArrow(_indexed(seen["docs"], seen["terms"], cluster_docs, cluster_terms), INDEX)
    rows = scratch.write(rows, "index")
    scratch.drop("routed")
    return Index(rows, seen["docs"], seen["terms"])


# --- searches


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term), each once. Rows that repeat an id are one item."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(key).alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _searched(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, items in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cluster = Cluster(blob.as_py())
                terms = list({t["term"]: 0 for i in items for t in i["terms"]})
                known = dict(zip(terms, cluster.asked([t.encode() for t in terms]), strict=True))
                out_i, out_d, out_s = [], [], []
                for item in items:
                    score = np.zeros(len(cluster.ids), np.int64)
                    for t in item["terms"]:
                        if got := known[t["term"]]:
                            score[got[0]] += t["w"] * got[1]
                    least = max(1, item["least"])
                    if len(score) > k:
                        least = max(least, int(np.partition(score, -k)[-k]))
                    near = np.flatnonzero(score >= least)
                    near = near[np.lexsort((cluster.ids[near], -score[near]))[:k]]
                    out_i += [item["item"]] * len(near)
                    out_d.append(cluster.ids[near])
                    out_s.append(score[near])
                if out_i:
                    ids = np.concatenate(out_d)
                    yield pa.RecordBatch.from_arrays([pa.array(out_i, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate(out_s))], names=["item", "doc_id", "score"])

    return go


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * df + 1))).cast("long")


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = 10, visits: tuple[int, ...] = (2, 16), together: int = 1024, key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    ``visits`` says how many clusters, by their bounds, each item has visited after the first rounds; the last round
    visits all others whose bound reaches the item's k-th best score. About ``together`` items pass a cluster at once.
    """
    asked = query_terms(items, key, text)
    numbered = scratch.write(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    asked = scratch.write(asked.join(numbered, asked["item_id"].eqNullSafe(numbered["item_id"])).select("item", "term"), "asked")
    maxima = index.rows.where("term IS NOT NULL").select("term", "cluster", "df", "best")
    hits = scratch.write(maxima.join(asked.select("term").distinct(), "term"), "hits")
    df = hits.groupBy("term").agg(F.sum("df").alias("df"))
    terms = scratch.write(asked.join(df, "term").select("item", "term", weight(index.n_docs, F.col("df")).alias("w")), "terms")
    bounds = hits.join(terms, "term").groupBy("item", "cluster").agg(F.sum(F.col("w") * F.col("best")).alias("bound")).where("bound > 0")
    bounds = scratch.write(bounds, "bounds")
    blocks = max(1, -(-numbered.count() // together))
    lists = terms.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    blobs = index.rows.where("term IS NULL").select(F.col("cluster").alias("of"), "blob")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    found = gone = None
    for step, most in enumerate((*visits, None)):
        todo = bounds if most is None else bounds.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= most).drop("nth")
        if found is None:
            todo = todo.withColumn("least", F.lit(1).cast("long"))
        else:
            best = _best(found, "item", k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("least"))
            todo = todo.join(gone, ["item", "cluster"], "left_anti").join(best, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least")
        todo = scratch.write(todo, f"todo{step}")
        per = todo.join(lists, "item").groupBy("cluster", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "least", "terms")).alias("items"))
        got = blobs.join(per, F.col("of") == F.col("cluster")).select("blob", "items").mapInArrow(_searched(k), "item long, doc_id long, score long")
        got = scratch.write(got, f"found{step}")
        visited = todo.select("item", "cluster")
        found, gone = (got, visited) if found is None else (found.unionByName(got), gone.unionByName(visited))
    ranked = _best(found, "item", k).join(numbered, "item")
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` (doc_id, text) and search it for all ``items`` (item_id, text).

    Whole texts are read, null ones as empty. Repeated rows of documents are documents of their own; one without an id
    counts like others and comes last among equal scores; items without an id are one item. Items without a match have
    no rows, as have empty tables. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    return search(build(docs, scratch), items, scratch, k)
