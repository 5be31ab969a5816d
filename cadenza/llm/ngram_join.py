"""N-gram Jaccard join by PartEnum signatures.

Sets are banded by size. Two sets of sizes a and b with Jaccard similarity t or more differ in at most
k = (a + b)(1 - t)/(1 + t) features. A band splits the feature domain by hash into groups of two partitions, more
partitions than k, and enumerates the subsets of one partition a group: a set's signatures are its projections on them.
Sets that are similar enough agree on all but k of the projections; of n non-empty ones that leaves n - k, so if every
set keeps its first k + 1 in an order common to all, two such sets share a kept signature. The order puts projections
that hold frequent features alone last, which keeps common lines and passages from filling a signature. Sets of a
band's upper neighbourhood sign in the next band too, since a partner may be larger by 1/t.

Documents that share a signature form clusters; in a cluster, sets are compared exactly. Equal sets are taken once.
Passages that many documents share chain unlike ones to clusters that grow faster than the input. So a large cluster's
sets are first compared by parity sketches, of a bit or two a feature: two sets differ in as many features at least as
their sketches differ in bits. The pairs that may be similar then form the clusters that are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, short_batches, texts_of
from .shingles import mixed, shingle_sets
from .vectors import groups_of

#: A feature is frequent if more than this share of documents has it. At most (features a document) / share are.
FREQUENT = 0.0002


class Bands:
    """Size bands whose ends are about 1/t apart, so a partner is in the same or a neighbouring band; and how many
    partitions each has."""

    def __init__(self, threshold: Fraction) -> None:
        self.t = threshold
        self.gap = (1 - threshold) / (1 + threshold)
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(self.largest(np.int64(lows[-1]))) + 1))
        self.lows = np.asarray(lows, np.int64)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, side="right") - 1

    def low(self, band: np.ndarray) -> np.ndarray:
        return self.lows[band]

    def top(self, band: np.ndarray) -> np.ndarray:
        return self.lows[band + 1] - 1

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The largest partner of a set of size n."""
        return n * self.t.denominator // self.t.numerator

    def differ(self, total: np.ndarray) -> np.ndarray:
        """How many features two similar sets of that total size differ in at most."""
        return total * self.gap.numerator // self.gap.denominator

    def bits(self, band: int) -> int:
        """How many bits a band's sketches have: a bit or two a feature, 64 at least; 2^20 do for the largest sets."""
        return 1 << min(20, max(6, (int(self.top(np.int64(band))) - 1).bit_length()))

    def partitions(self, band: np.ndarray) -> np.ndarray:
        """A few more than k + 1, so that a set has more non-empty projections than k; many for small sets."""
        top = self.top(band)
        k = self.differ(2 * top)
        groups = np.maximum((k + 1) * 11 // 20 + 2, np.minimum(24, 2 * top))
        return 2 * groups


def signatures(sets: list[np.ndarray], bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all kept signatures of non-empty sets."""
    sizes = np.asarray(list(map(len, sets)), np.int64)
    owner = np.flatnonzero(sizes)
    if not len(owner):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = sizes[owner]
    flat = np.concatenate([sets[i] for i in owner])
    rare = np.ones(len(flat), np.float64)
    if len(frequent):
        rare[_among(flat, frequent)] = 0
    own = bands.band(sizes)
    out_s, out_o = [], []
    for up in (0, 1):
        band = own + up
        if up:
            some = np.flatnonzero(bands.largest(sizes) >= bands.low(band))
            member = np.repeat(np.isin(np.arange(len(sizes)), some), sizes)
            h, r = flat[member], rare[member]
        else:
            some, h, r = np.arange(len(sizes)), flat, rare
        if not len(some):
            continue
        band, n = band[some], sizes[some]
        parts = bands.partitions(band)
        k = bands.differ(n + np.minimum(bands.largest(n), bands.top(band)))
        first = np.cumsum(parts) - parts
        x = mixed(h ^ np.repeat(mixed(band.astype(np.uint64) + np.uint64(977)), n))
        at = np.repeat(first, n) + (((x >> np.uint64(32)) * np.repeat(parts, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        room = int(parts.sum())
        x = mixed(x)
        count = np.bincount(at, minlength=room)
        # sums modulo 2^64 of the projections' features, exact in halves of 32 bits
        low = np.bincount(at, weights=(x & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=room).astype(np.uint64)
        high = np.bincount(at, weights=(x >> np.uint64(32)).astype(np.float64), minlength=room).astype(np.uint64)
        rares = np.bincount(at, weights=r, minlength=room) > 0
        doc = np.repeat(np.arange(len(some)), parts)
        place = np.arange(room) - np.repeat(first, parts)
        there = count > 0
        a, b = there & rares, there & ~rares
        rank_a = np.cumsum(a) - a
        rank_b = np.cumsum(b) - b
        total_a = np.add.reduceat(a.astype(np.int64), first)
        rank = np.where(a, rank_a - rank_a[first][doc], total_a[doc] + rank_b - rank_b[first][doc])
        keep = there & (rank <= k[doc])
        sig = mixed(mixed((high << np.uint64(32)) + low + place.astype(np.uint64)) + band[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out_s.append(sig[keep])
        out_o.append(owner[some][doc[keep]])
        # too few projections: similar sets may agree on empty ones alone, and such sets meet in a signature of their own
        bare = np.flatnonzero(np.add.reduceat(there.astype(np.int64), first) <= k)
        out_s.append(mixed(band[bare].astype(np.uint64) + np.uint64(0xE1117)))
        out_o.append(owner[some][bare])
    return np.concatenate(out_s), np.concatenate(out_o)


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Positions of x that are in the sorted list."""
    seen = np.zeros(1 << 18, bool)
    mask = np.uint64((1 << 18) - 1)
    seen[(listed & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(x & mask).astype(np.int64)])
    return maybe[listed[np.minimum(np.searchsorted(listed, x[maybe]), len(listed) - 1)] == x[maybe]]


def linked_forest(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of links that connect all sets whose similarities num/den or more connect them.

    Breadth first: a set is counted against the sets not reached yet, through lists of the sets that have each
    feature; the lists shrink as sets are reached, so a group of thousands of alike sets takes few counts.
    """
    n = len(sets)
    sizes = np.asarray(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    waiting = np.ones(n, bool)
    lists = ptr = None
    out_a, out_b, queue = [], [], []
    nxt, indexed, left = 0, 0, n
    while left:
        if not queue:
            while not waiting[nxt]:
                nxt += 1
            queue.append(nxt)
            waiting[nxt] = False
            left -= 1
        i = queue.pop()
        if not left:
            break
        if lists is None or left * 2 < indexed:
            alive = waiting[owner]
            order = np.argsort(code[alive], kind="stable")
            lists = owner[alive][order]
            ptr = np.concatenate([[0], np.cumsum(np.bincount(code[alive], minlength=int(code.max()) + 1))])
            indexed = left
        mine = code[first[i] : first[i] + sizes[i]]
        lens = ptr[mine + 1] - ptr[mine]
        if not lens.any():
            continue
        ends = np.cumsum(lens)
        near = lists[np.repeat(ptr[mine] - ends + lens, lens) + np.arange(ends[-1])]
        both = np.bincount(near, minlength=n)
        linked = np.flatnonzero(waiting & (den * both >= num * (sizes[i] + sizes - both)) & (both > 0))
        if len(linked):
            waiting[linked] = False
            left -= len(linked)
            out_a.append(np.full(len(linked), i))
            out_b.append(linked)
            queue += linked.tolist()
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def parities(s: np.ndarray, bits: int) -> bytes:
    """A set's sketch: by the last bits of its features, whether an odd number of them is there. ``bits`` is a power of
    two, 64 at least. Halves laid over each other by exclusive or are the sketch of half the bits."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words(raw: list[bytes], bits: int) -> np.ndarray:
    """Sketches of one size, folded to ``bits``: a row for each 64 bits, a column for each set."""
    x = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
    while x.shape[1] * 64 > bits:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return np.ascontiguousarray(x.T)


def close_forest(x: list[bytes], n: np.ndarray, side: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of links that connect all sets that pairs connect whose sketches and sizes allow similarity: pairs
    of a set of side 0 and one of side 1, or, if all are of side 0, any. Sketches of one side are of one size."""
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1)
    alone = not len(two)
    if alone:
        two = one
    if not len(one) or len(two) < 1 + alone:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = 8 * min(len(x[one[0]]), len(x[two[0]]))
    w1, w2 = _words([x[i] for i in one], bits), _words([x[i] for i in two], bits)
    n1, n2 = n[one], n[two]
    root = np.arange(len(x))
    step = max(1, (1 << 18) // len(two))
    for lo in range(0, len(one), step):
        rows, cols = slice(lo, lo + step), slice(lo if alone else 0, None)
        far = np.abs(n1[rows, None] - n2[None, cols]).astype(np.int32)  # two sets differ in as many features at least
        bit = np.zeros(far.shape, np.int32)
        for u, v in zip(w1, w2, strict=True):
            bit += np.bitwise_count(u[rows, None] ^ v[None, cols])
        may = np.maximum(far, bit) <= bands.differ(n1[rows, None] + n2[None, cols])
        may &= root[one[rows], None] != root[two[cols]][None, :]
        a, b = np.nonzero(may)
        if len(a):
            nodes, to = forest(root[one[rows][a]], root[two[cols][b]])
            new = np.arange(len(x))
            new[nodes] = to
            root = new[root]
    a = np.flatnonzero(root != np.arange(len(x)))
    return a, root[a]


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    k1 = np.asarray([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    k2 = np.asarray([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return k1.view(np.int64), k2.view(np.int64)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), tile: int = 1024, tile_shingles: int = 1 << 20, sketch_tile: int = 2048, sketch_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key (an integer), n_shingles, component_id (smallest key reachable by links, itself included).

    Whole texts are read: a document's set holds its distinct ``words``-word shingles (A-Z lower-cased); with fewer
    words the whole sequence is one; null texts and texts without words have none and link with nothing. Documents link
    if the Jaccard similarity of their sets is ``threshold`` or more. Rows that repeat a key are one document for
    links and a row each in the result; null keys link with nothing; other columns are left out; an empty table gives
    no rows. All links count: nothing is capped, and copies of a set are taken once whatever their number.

    What tasks hold: signatures meet by hash, those of one task merged before; a cluster of more than two ``tile``s, of
    documents or of ``tile_shingles``, is parted by sketches, which meet within their size band and with the next, in
    tiles of ``sketch_tile`` documents or ``sketch_bytes``. What is still larger is cut into tiles that meet in pairs, so
    a task holds about two tiles (and at least one whole set). The list of frequent features has a bound that doesn't
    depend on the input.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    num, den = threshold.numerator, threshold.denominator
    bands = Bands(threshold)
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("t"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its size, set key, size band and sketch; per task the features that may be frequent, with counts."""
        counts: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        docs_here = held = 0
        kept = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def merge():
            x, inverse = np.unique(np.concatenate([kept[0], *counts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([kept[1], *(np.ones(len(c)) for c in counts)])).astype(np.int64)
            counts.clear()
            much = n > max(1, FREQUENT / 4 * docs_here)  # Misra-Gries in blocks: what is rare so far can't be frequent here
            return x[much], n[much]

        none = lambda n, kind: pa.nulls(n, kind)
        names = ["id", "n", "k1", "k2", "band", "x", "feature", "times"]
        for batch in batches:
            sets = list(shingle_sets(texts_of(batch, "t"), words))
            k1, k2 = _keys(sets)
            for s, a, b in zip(sets, k1.tolist(), k2.tolist(), strict=True):
                if len(s) and (a, b) not in seen:
                    seen.add((a, b))
                    docs_here += 1
                    counts.append(s)
                    held += len(s)
            if held > 1_000_000:
                kept, held = merge(), 0
            n = batch.num_rows
            size = np.asarray(list(map(len, sets)), np.int64)
            band = bands.band(size)
            x = [parities(s, bands.bits(b)) if len(s) else None for s, b in zip(sets, band.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(k1), pa.array(k2), pa.array(band, pa.int64()), pa.array(x, pa.binary()), none(n, pa.int64()), none(n, pa.int64())], names=names)
        if counts:
            kept = merge()
        m = len(kept[0])
        if m:
            yield pa.RecordBatch.from_arrays([*(none(m, pa.int64()) for _ in range(5)), none(m, pa.binary()), pa.array(kept[0].view(np.int64)), pa.array(kept[1])], names=names)

    facts = scratch.write(rows.mapInArrow(first_pass, "id long, n long, k1 long, k2 long, band long, x binary, feature long, times long"), "facts")
    sized = facts.where("feature IS NULL").select("id", "n", "k1", "k2")
    sketches = facts.where("x IS NOT NULL AND id IS NOT NULL").select("id", "n", "band", "x")
    total, features = sized.agg(F.count("*"), F.sum("n")).first()
    often = facts.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("times").alias("times")).where(F.col("times") > max(2, FREQUENT * total))
    # bounded: the features' counts sum to all features, and each is above the share
    often = np.sort(often.select("feature").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(often)
    buckets = max(64, -(-int(features or 0) * 2 // 5_000_000))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures by bucket. A signature's documents in this task become links to their first; that one is sent."""
        seen: set[tuple[int, int]] = set()
        sigs, ids, held = [], [], 0

        def flush():
            s, d = np.concatenate(sigs), np.concatenate(ids)
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            start = np.flatnonzero(new)
            lead = np.repeat(d[start], np.diff(np.append(start, len(s))))
            a, b = forest(d[~new], lead[~new])
            s, d = s[new], d[new]
            bucket = (s >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(s))
            out = [(int(bucket[lo]), s[lo:hi].tobytes(), _ids(d[lo:hi]), b"", b"") for lo, hi in zip(cut.tolist(), ends.tolist(), strict=True)]
            if len(a):
                out.append((int(d[0]) % buckets, b"", b"", a.tobytes(), b.tobytes()))
            sigs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[c] for o in out], pa.binary()) for c in range(1, 5))], names=["bucket", "s", "d", "a", "b"])

        for batch in batches:
            sets = list(shingle_sets(texts_of(batch, "t"), words))
            k1, k2 = _keys(sets)
            for i, (a, b) in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                if (a, b) in seen:
                    sets[i] = sets[i][:0]
                elif len(sets[i]):
                    seen.add((a, b))
            s, at = signatures(sets, bands, frequent.value)
            sigs.append(s)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[at])
            held += len(s)
            if held > 800_000:
                yield flush()
                held = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 1):
            cols = {c: t.column(c).to_pylist() for c in "sdab"}
            s = np.frombuffer(b"".join(cols["s"]), np.uint64)
            d = np.concatenate([np.empty(0, np.int64), *map(_unids, cols["d"])])
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
            start = np.flatnonzero(new)
            lead = np.repeat(d[start], np.diff(np.append(start, len(s))))
            a = np.concatenate([d[~new], np.frombuffer(b"".join(cols["a"]), np.int64)])
            b = np.concatenate([lead[~new], np.frombuffer(b"".join(cols["b"]), np.int64)])
            a, b = forest(a, b)
            for lo in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], names=["a", "b"])

    signed = rows.where("id IS NOT NULL").mapInArrow(sign, "bucket int, s binary, d binary, a binary, b binary")
    shared = scratch.write(signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long"), "shared")

    # every set once: its smallest key stands for it
    heads = scratch.write(sized.where("n > 0 AND id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "heads")
    whose = scratch.write(sized.where("n > 0 AND id IS NOT NULL").join(heads, ["n", "k1", "k2"]).select("id", "rep").distinct(), "whose")
    rep = lambda side: whose.select(F.col("id").alias(side), F.col("rep").alias(f"{side}r"))
    ties = shared.join(rep("a"), "a").join(rep("b"), "b").select(F.col("ar").alias("a"), F.col("br").alias("b"))
    clusters = scratch.write(components(ties.where("a <> b"), scratch, "cluster"), "clusters")

    def cut(clusters: DataFrame) -> DataFrame:
        """Clusters' members, and into how many tiles each cluster is cut."""
        clusters = clusters.union(clusters.select("component", "component").distinct())
        clusters = clusters.join(heads.select(F.col("rep").alias("node"), "n"), "node")
        sizes = clusters.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("ns"))
        tiles = F.greatest(F.col("m") / tile, F.col("ns") / tile_shingles)
        tiles = F.when(tiles <= 2, 1).otherwise(F.ceil(tiles)).cast("int")
        return clusters.join(sizes, "component").select(F.col("node").alias("id"), "component", tiles.alias("tiles"))

    member, seen = scratch.counted(cut(clusters), "member", F.count(F.when(F.col("tiles") > 1, 1)).alias("large"))
    if seen["large"]:
        near = scratch.write(_maybe_near(sketches, member.where("tiles > 1"), scratch, bands, sketch_tile, sketch_bytes), "near")
        parts = scratch.write(components(near, scratch, "part"), "parts")
        member = scratch.write(member.where("tiles = 1").unionByName(cut(parts)), "parted")
    scratch.drop("shared", "clusters", "heads", "sketches", "near", "parts")

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch, "t"), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["component", "tiles", "id", "s"])

    # both sides are dealt by id at every size: the members grow with the input and are never broadcast
    sets = rows.join(member.hint("merge"), "id").select("component", "tiles", "id", "t").mapInArrow(reread, "component long, tiles int, id long, s binary")
    mine = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    pair = lambda o: F.struct(F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b"))
    others = F.when(F.col("tiles") == 1, F.array(pair(F.lit(0)))).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: o != mine), pair))
    units = sets.withColumn("u", F.explode(others)).select("component", "u.a", "u.b", "id", "s")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 3):
            if t.num_rows < 2:
                continue
            ids = t.column("id").to_numpy()
            a, b = linked_forest([np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    links = units.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "id").mapInArrow(verify, "a long, b long")
    # rows that repeat a key with other texts are one document
    again = whose.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b <> z")
    links = links.union(whose.join(again, "id").select(F.col("rep").alias("a"), "b"))
    links = scratch.write(links.where("a <> b"), "links")
    comp = scratch.write(components(links, scratch), "components")
    scratch.drop("member", "parted", "links")
    reached = whose.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("wid"), F.coalesce("component", "rep").alias("c"))
    reached = reached.groupBy("wid").agg(F.min("c").alias("c"))
    out = sized.join(reached, F.col("id") == F.col("wid"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def _maybe_near(sketches: DataFrame, member: DataFrame, scratch: Scratch, bands: Bands, tile: int, tile_bytes: int) -> DataFrame:
    """Links (a, b) that connect, within each cluster of ``member``, all documents whose ``sketches`` (id, n, band, x)
    allow similarity.

    Partners are in the same or a neighbouring size band. A cluster's band is cut into tiles; each meets itself, the
    others of its band and those of the next one, so a task holds the sketches of two tiles.
    """
    sketches = scratch.write(sketches.join(member.select("id", "component").hint("merge"), "id").distinct(), "sketches")
    tiles = F.ceil(F.greatest(F.count("*") / tile, F.sum(F.octet_length("x").cast("long")) / tile_bytes)).cast("int")
    tiles = sketches.groupBy("component", "band").agg(tiles.alias("tiles"))
    tiles = tiles.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles"))
    of = lambda band: F.coalesce(F.try_element_at("tiles", band), F.lit(0))
    each = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), n), lambda o: o < n), f)
    mine = F.pmod(F.xxhash64("id"), of(F.col("band"))).cast("int")
    unit = lambda band, up, a, b, side: F.struct(band.alias("low"), F.lit(up).alias("up"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    own = each(of(F.col("band")), lambda o: unit(F.col("band"), 0, F.least(F.col("mine"), o), F.greatest(F.col("mine"), o), F.col("mine") > o))
    above = each(of(F.col("band") + 1), lambda o: unit(F.col("band"), 1, F.col("mine"), o, F.lit(0)))
    below = each(of(F.col("band") - 1), lambda o: unit(F.col("band") - 1, 1, o, F.col("mine"), F.lit(1)))
    units = sketches.join(tiles, "component").withColumn("mine", mine).withColumn("u", F.explode(F.concat(own, above, below)))
    units = units.select("component", "u.low", "u.up", "u.a", "u.b", "u.side", "id", "n", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 5):
            ids = t.column("id").to_numpy()
            a, b = close_forest(t.column("x").to_pylist(), t.column("n").to_numpy(), t.column("side").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    keys = ("component", "low", "up", "a", "b")
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _ids(d: np.ndarray) -> bytes:
    """Integers as a base and 32-bit gaps to it where they fit."""
    base = int(d.min())
    if int(d.max()) - base < 1 << 32:
        return b"4" + np.int64(base).tobytes() + (d - base).astype(np.uint32).tobytes()
    return b"8" + d.tobytes()


def _unids(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.int64)
    if raw[:1] == b"8":
        return np.frombuffer(raw[1:], np.int64)
    return np.frombuffer(raw[1:9], np.int64)[0] + np.frombuffer(raw[9:], np.uint32).astype(np.int64)
