"""Phrase collocations by compressed position bitmaps, one a word and shard, in the manner of SPAM.

The words of a shard stand at positions; between two pieces of text a position stays empty. A bitmap of a word has a bit
at each of its positions; it is kept as its non-zero bytes, each with its place. A phrase's bitmap has a bit where the
phrase ends. Shifting it by one position and ANDing it with another bitmap gives the longer phrase's bitmap, and an empty
position lets no phrase through, so phrases stay inside their pieces. Popcounts are a shard's counts; their sums over
all shards are exact.

There are three rounds: all words and pairs of words where the texts are read; then, from pairs that are frequent
everywhere, three-word phrases, which shards send as lists of their pairs' numbers with counts, so that a row is made for
each frequent one only; and from these all longer phrases. A phrase that is frequent has only frequent parts, so nothing
is lost; what a shard may extend comes to it by a shuffle, never by a broadcast list. Pairs aren't held back for rare words: on large
corpora nearly all words of a text are frequent, and a round of their own would shuffle all bitmaps for little.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, short_batches
from .words import SpaceWords

#: Rows of the first round: a pair of a shard, or (code -1) the pairs' bitmaps, with n the shard's words, or (-2) a word.
SHARD = "shard long, lang string, code int, phrase string, n long, blob binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("code", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
#: Entries of bitmaps that are extended at once.
BLOCK = 1 << 16


class Bitmaps:
    """Bitmaps of codes 0, 1, ... as sorted keys (code * places + place) and a byte of eight positions each."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, places: int) -> None:
        self.keys, self.bits, self.places = keys, bits, places

    @classmethod
    def of(cls, keys: np.ndarray, bits: np.ndarray, places: int) -> Bitmaps:
        """From entries in any order; those of one code and place are united."""
        if not len(keys):
            return cls(keys, bits, places)
        order = np.argsort(keys)
        keys, bits = keys[order], bits[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return cls(keys[first], np.bitwise_or.reduceat(bits, first), places)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        code = self.keys // self.places
        return code, self.keys - code * self.places

    def packed(self) -> bytes:
        """Distances of keys, plane by plane, and bits, compressed. Every code has a key, so distances fit 32 bits."""
        gaps = np.diff(self.keys, prepend=0).astype("<u4")
        raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + self.bits.tobytes()
        return struct.pack("<qq", len(gaps), self.places) + pa.Codec("zstd", 1).compress(raw, asbytes=True)

    @classmethod
    def unpacked(cls, blob: bytes) -> Bitmaps:
        n, places = struct.unpack_from("<qq", blob)
        raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[16:], decompressed_size=5 * n, asbytes=True), np.uint8)
        gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
        return cls(np.cumsum(gaps, dtype=np.int64), raw[4 * n :], places)


def popcounts(code: np.ndarray, place: np.ndarray, bits: np.ndarray, codes: int, prelude: int) -> np.ndarray:
    """Set bits of each code; those of the prelude belong to the shard before."""
    own = place >= prelude
    return np.bincount(code[own], weights=np.bitwise_count(bits[own]), minlength=codes).astype(np.int64)


class Right:
    """The bitmaps that extend others, found by their place and first word."""

    def __init__(self, code: np.ndarray, place: np.ndarray, bits: np.ndarray, first: np.ndarray | None, places: int) -> None:
        self.places, self.first = places, first
        key = place if first is None else first[code] * places + place
        order = np.argsort(key)
        self.code, self.bits, self.key = code[order], bits[order], key[order]
        # words all begin alike: then the place alone leads to them
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=places + 1))]) if first is None else None

    def _range(self, last: np.ndarray | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.ends is not None:
            return self.ends[place], self.ends[place + 1]
        key = last * self.places + place
        return np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")

    def extended(self, code: np.ndarray, place: np.ndarray, bits: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left code, right code, place, bits) of all non-empty ANDs of left bitmaps, shifted by one position, with
        right ones whose first word is the left one's last."""
        out = []
        for at in range(0, len(code), BLOCK):
            c, p, b = code[at : at + BLOCK], place[at : at + BLOCK], bits[at : at + BLOCK]
            own = None if last is None else last[c]
            for shifted, to in ((b << np.uint8(1), p), (b >> np.uint8(7), p + 1)):
                there = np.flatnonzero(shifted)
                lo, hi = self._range(None if own is None else own[there], to[there])
                n = hi - lo
                ends = np.cumsum(n)
                if not len(ends) or not ends[-1]:
                    continue
                left = np.repeat(there, n)
                right = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
                both = shifted[left] & self.bits[right]
                met = np.flatnonzero(both)
                left = left[met]
                out.append((c[left], self.code[right[met]], to[left], both[met]))
        if not out:
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(right: Right, code: np.ndarray, place: np.ndarray, bits: np.ndarray, last: np.ndarray | None, rights: int) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
    """(left code, right code) of each longer phrase that occurs, and the bitmaps of these phrases."""
    a, b, to, both = right.extended(code, place, bits, last)
    every = Bitmaps.of((a * rights + b) * right.places + to, both, right.places)
    pair, to = every.split()
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, bool)
    pairs = pair[new]
    return pairs // rights, pairs % rights, Bitmaps((np.cumsum(new) - 1) * right.places + to, every.bits, right.places)


class _Stream:
    """The words of one language on their way to shards, with the last few of the shard before as its prelude."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.size = most, [], 0
        self.before: tuple[pa.Array, np.ndarray] | None = None

    def add(self, words: pa.Array, new: np.ndarray) -> None:
        self.parts.append((words, new))
        self.size += len(words)

    def shard(self, size: int) -> tuple[pa.Array, np.ndarray, int]:
        """(words, whether each begins a piece, how many of them are prelude) of the next shard."""
        words, new = pa.concat_arrays([w for w, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        self.parts = [(words[size:], new[size:])] if len(words) > size else []
        words, new = words[:size], new[:size]
        self.size -= len(words)
        ahead = 0
        if self.before is not None:
            ahead = len(self.before[0])
            words, new = pa.concat_arrays([self.before[0], words]), np.concatenate([self.before[1], new])
        self.before = (words[-(self.most - 1) :], new[-(self.most - 1) :])
        return words, new, ahead


def _prelude(most: int) -> int:
    """Places in front of a shard's own: room for most - 1 words, each of which may follow an empty position."""
    return -(-2 * (most - 1) // 8)


def word_bitmaps(words: pa.Array, new: np.ndarray, ahead: int, most: int) -> tuple[pa.Array, Bitmaps]:
    """The distinct words, coded by their order, and their bitmaps."""
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(1 + new.astype(np.int64))
    at += 8 * _prelude(most) - at[ahead]
    places = (int(at[-1]) >> 3) + 2
    bits = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
    return coded.dictionary, Bitmaps.of(code * places + (at >> 3), bits, places)


#: Rows of a batch that a shard sends.
SENT = 100_000


def _rows(shard: int, lang: str, words: pa.Array, n_words: np.ndarray, pairs: pa.Array, n_pairs: np.ndarray, own: int, maps: Bitmaps) -> Iterator[pa.RecordBatch]:
    codes = np.concatenate([np.arange(len(pairs)), np.full(len(words), -2), [-1]]).astype(np.int32)
    # words are cut at ASCII bytes only, so they are whole characters wherever the text is
    phrases = pa.concat_arrays([*(p.cast(pa.binary()).view(pa.string()) for p in (pairs, words)), pa.nulls(1, pa.string())])
    n = np.concatenate([n_pairs, n_words, [own]])
    for at in range(0, len(codes), SENT):
        k = len(codes[at : at + SENT])
        last = at + k == len(codes)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(k, shard)), pa.array([lang] * k, pa.string()), pa.array(codes[at : at + k]), phrases.slice(at, k), pa.array(n[at : at + k]),
            pa.array([None] * (k - last) + [maps.packed()] * last, pa.binary())], schema=_SCHEMA)


def _shards(size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        streams: dict[str, _Stream] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            words, new, ahead = streams[lang].shard(size)
            known, maps = word_bitmaps(words, new, ahead, most)
            code, place = maps.split()
            n_words = popcounts(code, place, maps.bits, len(known), _prelude(most))
            a, b, out = joined(Right(code, place, maps.bits, None, maps.places), code, place, maps.bits, None, len(known))
            pairs = pc.binary_join_element_wise(known.take(pa.array(a)), known.take(pa.array(b)), pa.scalar(b" ", known.type))
            n_pairs = popcounts(*out.split(), out.bits, len(a), _prelude(most))
            number += 1
            return _rows(task + number, lang, known, n_words, pairs, n_pairs, len(words) - ahead, out)

        split = SpaceWords()
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            texts = np.asarray(batch.column(1).cast(pa.binary()).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                stream = streams.setdefault(lang, _Stream(most))
                for words, new in split.blocks(b"\n".join(texts[langs == lang]) + b"\n"):
                    if not len(words):
                        continue
                    stream.add(words, new)
                    while stream.size >= size:
                        yield from flush(lang)
            while sum(s.size for s in streams.values()) > 2 * size:  # many languages
                yield from flush(max(streams, key=lambda k: streams[k].size))
        for lang, stream in streams.items():
            while stream.size:
                yield from flush(lang)

    return run


def _known(blob: pa.Table, known: pa.Table) -> tuple[Bitmaps, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A shard's bitmaps of the phrases that are frequent everywhere: bitmaps, code, place, bits (codes renumbered), and
    the phrases by code."""
    maps = Bitmaps.unpacked(blob["blob"][0].as_py())
    code, place = maps.split()
    old = known["code"].to_numpy().astype(np.int64)
    number = np.full(int(max(code.max(initial=0), old.max(initial=0))) + 1, -1, np.int64)
    number[old] = np.arange(len(old))
    code = number[code]
    kept = code >= 0
    return maps, code[kept], place[kept], maps.bits[kept], known["phrase"].combine_chunks().cast(pa.string())


class _Threes:
    """The three-word phrases of a shard whose pairs are frequent everywhere, by code: their pairs and their bitmaps."""

    def __init__(self, blob: pa.Table, known: pa.Table, most: int) -> None:
        maps, code, place, bits, self.pairs = _known(blob, known)
        both = pc.split_pattern(self.pairs, " ")
        ends = pa.concat_arrays([pc.list_element(both, 0), pc.list_element(both, 1)]).dictionary_encode()
        end = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first, self.last, self.words, self.prelude = end[: len(self.pairs)], end[len(self.pairs) :], ends.dictionary, _prelude(most)
        self.a, self.b, self.maps = joined(Right(code, place, bits, first, maps.places), code, place, bits, self.last, len(self.pairs))

    def counted(self, maps: Bitmaps, codes: int) -> np.ndarray:
        return popcounts(*maps.split(), maps.bits, codes, self.prelude)

    def longer(self, phrases: pa.Array, b: np.ndarray) -> pa.Array:
        """Phrases with the last words of pairs b behind them."""
        return pc.binary_join_element_wise(phrases, self.words.take(pa.array(self.last[b])), " ")


#: Blocks among which a language's three-word phrases are dealt: a block's counts meet in a task.
BLOCKS = 512
COUNTED = "shard long, lang string, block int, a array<long>, b array<long>, n array<long>"
_COUNTED = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("block", pa.int32()), *((c, pa.list_(pa.int64())) for c in "abn")])
_FREQUENT = pa.schema([f for f in _COUNTED if f.name != "block"])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in lists.chunks)])


def _counted(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard's counts of three-word phrases, each as the numbers of its pairs, a row a block."""

    def run(blob: pa.Table, known: pa.Table) -> pa.Table:
        if not len(known):
            return _COUNTED.empty_table()
        threes = _Threes(blob, known, most)
        pair = known["id"].to_numpy()
        a, b, n = pair[threes.a], pair[threes.b], threes.counted(threes.maps, len(threes.a))
        mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        block = (mixed >> np.uint64(32)).astype(np.int64) % BLOCKS
        order = np.lexsort((b, a, block))
        block, lengths = np.unique(block, return_counts=True)
        k = len(block)
        return pa.Table.from_arrays([
            pa.array([blob["shard"][0].as_py()] * k, pa.int64()), pa.array([blob["lang"][0].as_py()] * k, pa.string()), pa.array(block, pa.int32()),
            *(_lists(x[order], lengths) for x in (a, b, n))], schema=_COUNTED)

    return run


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    """The three-word phrases of a block that occur ``least`` times over all shards: those of each shard, and in a row
    without shard all of them with their counts."""

    def run(t: pa.Table) -> pa.Table:
        a, b, n = (_flat(t[c]) for c in "abn")
        row = np.repeat(np.arange(len(t)), pc.list_value_length(t["a"]).to_numpy())
        order = np.lexsort((b, a))
        a, b, row = a[order], b[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        f = np.add.reduceat(n[order], new)
        often = f >= least
        own = np.repeat(often, np.diff(np.append(new, len(a))))
        by = np.argsort(row[own], kind="stable")
        held = np.bincount(row[own], minlength=len(t))
        first = new[often]
        shards = pa.concat_arrays([t["shard"].combine_chunks(), pa.nulls(1, pa.int64())])
        lengths = np.append(held, len(first))
        counts = pa.concat_arrays([pa.nulls(len(t), pa.list_(pa.int64())), _lists(f[often], np.array([len(first)]))])
        both = (_lists(np.concatenate([x[own][by], x[first]]), lengths) for x in (a, b))
        return pa.Table.from_arrays([shards, pa.array([t["lang"][0].as_py()] * len(shards), pa.string()), *both, counts], schema=_FREQUENT).filter(pa.array(lengths > 0))

    return run


def _longer(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard's phrases of four words or more, of frequent three-word phrases that overlap in two words."""

    def run(blob: pa.Table, known: pa.Table) -> pa.Table:
        if not len(known) or len(blob) == 1:
            return _COUNTS.empty_table()
        ids = known["id"].to_numpy()
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, _flat(blob[c]), sorter=order)] for c in "ab")
        blob = blob.filter(pc.is_valid(blob["blob"]))
        threes = _Threes(blob, known, most)
        met = np.flatnonzero(np.isin(threes.a * len(ids) + threes.b, a * len(ids) + b))
        a, b = threes.a[met], threes.b[met]
        number = np.full(len(threes.a), -1, np.int64)
        number[met] = np.arange(len(met))
        code, place = threes.maps.split()
        code, own = number[code], number[code] >= 0
        code, place, bits = code[own], place[own], threes.maps.bits[own]
        right = Right(code, place, bits, a, threes.maps.places)
        phrases, last = threes.longer(threes.pairs.take(pa.array(a)), b), b
        out: list[pa.RecordBatch] = []
        for _ in range(4, most + 1):
            left, to, found = joined(right, code, place, bits, last, len(met))
            if not len(left):
                break
            phrases, last = threes.longer(phrases.take(pa.array(left)), b[to]), b[to]
            n = threes.counted(found, len(left))
            out.append(pa.RecordBatch.from_arrays([pa.array([blob["lang"][0].as_py()] * len(left), pa.string()), phrases, pa.array(n)], schema=_COUNTS))
            (code, place), bits = found.split(), found.bits
        return pa.Table.from_batches(out, _COUNTS)

    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = 100, most: int = 5, shard: int = 1 << 20, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to ``most`` words that occur at least ``least`` times in their language, and
    (lang, n) with all word occurrences. Phrases are space-joined, A-Z lower-cased; a null language is ``und``."""
    if most < 2 or least < 1 or shard < 1:
        raise ValueError("phrases of two words or more, a least count and shards of one or more are needed")
    short_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    often = F.col("f") >= least
    first = scratch.write(source.mapInArrow(_shards(shard, most), SHARD), "first", "zstd")
    total = scratch.write(first.where("code = -1").groupBy("lang").agg(F.sum("n").alias("n")), "total")
    frequent = [scratch.write(first.where("code = -2").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(often), "words")]
    # a pair's counts are summed where its rows meet, a row a shard at most, so that they are shuffled once
    of = Window.partitionBy("lang", "phrase")
    pairs = first.where("code >= 0").select("shard", "lang", "code", "phrase", "n").withColumn("f", F.sum("n").over(of)).where(often).drop("n")
    # a pair's number is its first row's, where all its rows are
    pairs = scratch.write(pairs.withColumn("id", F.monotonically_increasing_id()).withColumn("id", F.min("id").over(of)), "pairs", "zstd")
    two = scratch.write(pairs.select("lang", "phrase", "f", "id").distinct(), "two")
    frequent.append(two.drop("id"))
    if most > 2:
        blobs = first.where("code = -1").select("shard", "lang", "blob")
        known = pairs.select(F.col("shard").alias("of"), "code", "phrase", "id")
        counted = blobs.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_counted(most), COUNTED)
        threes = scratch.write(counted.groupBy("lang", "block").applyInArrow(_frequent(least), "shard long, lang string, a array<long>, b array<long>, n array<long>"), "three", "zstd")
        names = [two.select("lang", F.col("id").alias(c), F.col("phrase").alias(f"of_{c}")) for c in "ab"]
        named = threes.where("shard IS NULL").select("lang", F.expr("inline(arrays_zip(a, b, n))")).join(names[0], ["lang", "a"]).join(names[1], ["lang", "b"])
        frequent.append(scratch.write(named.select("lang", F.expr("concat(of_a, ' ', substring_index(of_b, ' ', -1))").alias("phrase"), F.col("n").alias("f")), "threes"))
        if most > 3:
            own = blobs.unionByName(threes.where("shard IS NOT NULL").drop("n"), allowMissingColumns=True)
            longer = own.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_longer(most), "lang string, phrase string, n long")
            frequent.append(scratch.write(longer.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(often), "longer"))
        scratch.drop("three")
    scratch.drop("first", "pairs")
    every = frequent[0]
    for f in frequent[1:]:
        every = every.unionByName(f)
    return every, total


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, factor: int = 1000, shard: int = 1 << 20, lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of each language that stick together: lang, rank, phrase, a, l, r, n, score (numbers long).

    Candidates are phrases of 2 to ``most`` words that occur a >= ``least`` times. A cut after k words gives the counts l
    and r of both sides and floor(``factor`` * a * n / (l * r)), n all words of the language; the lowest cut counts, the
    first one of equal ones. Products are taken in decimals of 38 digits. A candidate that a longer one contains as often
    is dropped. Ranks go by score and a, descending, then phrase in byte order.

    Whole texts are read, null ones as empty, and a null language is ``und``; repeated rows count each; other columns are
    not looked at; an empty table gives no rows. A task holds a shard of ``shard`` words and a block of text, whatever a
    document's length; a language is as many shards as it needs.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    f, total = phrase_counts(docs, scratch, least, most, shard, lang, text)
    f = f.withColumn("words", F.size(F.split("phrase", " ")))

    def head(k):
        return F.expr(f"substring_index(phrase, ' ', {k})")

    one_less = f.where("words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(head("words - 1"), head("1 - words"))).alias("phrase"))
    found = f.where("words > 1").withColumnRenamed("f", "a").join(one_less.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns({"left": head("k"), "right": head("k - words")})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    cuts = cuts.join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = (wide("a") * wide("n") * F.lit(factor).cast("decimal(10,0)")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under").cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
