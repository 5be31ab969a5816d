"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Equal strings pick the same anchor, the
gram with the smallest hash in them, so strings meet by their anchor's gram, and only anchors whose gram occurs twice
send their surroundings. Where strings meet, their suffixes are sorted deep-shallow: a multikey quicksort on words of
eight bytes down to a shallow depth, then blind tries, built a level at a time for all groups at once, order the groups
that share that prefix. Of equal strings all but the earliest mark their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, Scratch, short_batches, texts_of
from .ngram_join import _ids, _unids
from .shingles import mixed
from .vectors import groups_of

GRAM = 32
#: Multikey quicksort goes this deep; blind tries order what is equal so far.
SHALLOW = 32
#: Bytes that are hashed at once; longer texts come in overlapping segments.
CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: A gram is crowded if it has more anchors than CROWD and more than this share of all bytes' number.
CROWD, CROWD_SHARE = 2048, 3e-8


def gram_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (a power of two) bytes at every position, by doubling."""
    h = _letters()[buf]
    base, k = 0x9E3779B97F4A7C15, 1
    while k < width:
        h = h[: len(h) - k] * np.uint64(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    return mixed(h)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(43).integers(0, 1 << 64, 256, np.uint64)


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, anchor, first, last, hash): the strings that start at first..last of a text share that anchor."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), CHUNK - length + 1):
            part = t[at : at + CHUNK]
            if size + len(part) > CHUNK:
                yield _anchors(held, length)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _anchors(held, length)


def _anchors(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    size = np.asarray([len(p[2]) for p in parts])
    off = np.cumsum(size) - size
    g = gram_hashes(buf, GRAM)
    low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)  # smallest hash, leftmost if equal
    wide, k = length - GRAM + 1, 1
    while 2 * k <= wide:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    if wide > k:
        low = np.minimum(low[: len(low) - (wide - k)], low[wide - k :])
    n = size - length + 1
    part = np.repeat(np.arange(len(parts)), n)
    start = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + off[part]
    a = (low[start] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
    last = np.append(cut[1:], len(a)) - 1
    which = part[cut]
    shift = np.asarray([p[1] for p in parts])[which] - off[which]
    return np.asarray([p[0] for p in parts])[which], a[cut] + shift, start[cut] + shift, start[last] + shift, mixed(~g[a[cut]])  # mixed again, as smallest hashes crowd at 0


def equal_classes(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes at ``start``, suffix-sorted: (order, class of each in that order).

    Strings of a class are equal; strings alone in a class have no equal.
    """
    room = np.concatenate([buf, np.zeros(16, np.uint8)])
    word = np.zeros(len(buf) + 8, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | room[i : i + len(word)]
    order = np.argsort(word[start], kind="stable")
    key = word[start[order]]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    done_order, done_group, base = [], [], 0

    def part(order, group):
        """Set aside groups of one; number the others from 0."""
        nonlocal base
        n = np.bincount(group)
        single = n[group] == 1
        done_order.append(order[single])
        done_group.append(base + np.arange(int(single.sum())))
        base += int(single.sum())
        order, group = order[~single], group[~single]
        return order, np.unique(group, return_inverse=True)[1] if len(group) else group

    # shallow: multikey quicksort by words of eight bytes
    for depth in range(8, SHALLOW, 8):
        order, group = part(order, group)
        if not len(order):
            break
        key = word[start[order] + depth]
        again = np.lexsort((key, group))
        order, group, key = order[again], group[again], key[again]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
    order, group = part(order, group)
    # deep: a level of every group's blind trie at a time; a node skips to where its strings first differ
    whole, rest = divmod(length - SHALLOW, 8)
    while len(order):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lead = np.repeat(start[order[first]], np.diff(np.append(first, len(order))))
        mine = start[order]
        same = np.full(len(order), length, np.int64)
        open_ = np.arange(len(order))
        for w in range(whole + (rest > 0)):
            at = SHALLOW + 8 * w
            x = word[mine[open_] + at] ^ word[lead[open_] + at]
            if w == whole:
                x >>= np.uint64(64 - 8 * rest)
            off = np.flatnonzero(x)
            if len(off):
                high = x[off] >> np.uint64(32)  # halves, as doubles hold those exactly
                bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x[off] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
                width = 8 * rest if w == whole else 64
                same[open_[off]] = at + (width - bits) // 8
                stay = np.ones(len(open_), bool)
                stay[off] = False
                open_ = open_[stay]
        skip = np.minimum.reduceat(same, first)
        full = (skip == length)[group]
        done_order.append(order[full])
        if full.any():
            done_group.append(base + np.unique(group[full], return_inverse=True)[1])
            base = int(done_group[-1].max()) + 1
        else:
            done_group.append(np.empty(0, np.int64))
        order, group, skip = order[~full], group[~full], skip[group[~full]]
        if not len(order):
            break
        branch = buf[start[order] + skip]
        again = np.lexsort((branch, group))
        order, group, branch = order[again], group[again], branch[again]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (branch[1:] != branch[:-1])]))
        order, group = part(order, group)
    return np.concatenate(done_order), np.concatenate(done_group)


def later(buf: np.ndarray, start: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which strings equal one that starts earlier, by document and place in it."""
    order, cls = equal_classes(buf, start, length)
    by = np.lexsort((at[order], doc[order], cls))
    order, cls = order[by], cls[by]
    new = np.concatenate([[True], cls[1:] != cls[:-1]])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(start), bool)
    out[order] = (doc[order] != doc[head]) | (at[order] != at[head])
    return out


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sorted, as runs (doc, first, number)."""
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]))[: len(doc)]
    last = np.append(cut[1:], len(doc))[: len(cut)] - 1
    return doc[cut], at[cut], at[last] - at[cut] + 1


def _deal(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document, the same as ``_part`` gives."""
    return ((((ids ^ (ids >> 17) ^ (ids >> 33)) & 0x7FFFFFFF) * 40503) >> 7) % parts


def _part(ident: Column, parts: int) -> Column:
    x = ident.bitwiseXOR(F.shiftright(ident, 17)).bitwiseXOR(F.shiftright(ident, 33)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.pmod(F.shiftright(x * F.lit(40503), 7), F.lit(parts)).cast("int")


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each stretch of equal values."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[lo]), lo, hi) for lo, hi in zip(cut, [*cut[1:], len(bucket)][: len(cut)], strict=True)]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of an integer and blocks of bytes."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, len(names)))], names=names)


def _batches(rows: list[tuple], names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``most`` bytes, but for single rows."""
    own, size = [], 0
    for r in rows:
        n = sum(map(len, r[1:]))
        if own and size + n > most:
            yield _batch(own, names)
            own, size = [], 0
        own.append(r)
        size += n
    if own:
        yield _batch(own, names)


def _block(columns: list[list[bytes]]) -> list[np.ndarray]:
    """Integers of many blocks, by column."""
    return [np.concatenate([np.empty(0, np.int64), *map(_unids, c)]) for c in columns]


def _by_part(parts: int, d: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Blocks of integers for each part of the documents."""
    own = _deal(d, parts)
    order = np.argsort(own, kind="stable")
    return [(b, *(_ids(x[order[lo:hi]]) for x in (d, *more))) for b, lo, hi in _cuts(own[order])]


def with_blocks(docs: DataFrame, blocks: DataFrame, parts: int, names: list[str]) -> DataFrame:
    """Documents (id, t, carry) and blocks of integers about them, dealt to the same parts: part, names, id, t, carry."""
    empty = F.lit(None).cast("binary")
    left = blocks.select("part", *names, F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("t"), F.lit(None).cast(docs.schema["carry"].dataType).alias("carry"))
    part = F.coalesce(_part(F.col("id"), parts), F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int"))
    right = docs.select(part.alias("part"), *(empty.alias(n) for n in names), "id", "t", "carry")
    return left.union(right).repartition("part").sortWithinPartitions("part")


def _split(t: pa.Table, names: list[str]) -> tuple[list[np.ndarray], pa.Table]:
    """A part's integers, sorted by document, and its documents."""
    about = t.column(names[0]).is_valid()
    blocks, docs = t.filter(about), t.filter(pa.compute.invert(about))
    cols = _block([blocks.column(n).to_pylist() for n in names])
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols], docs


def removed_runs(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Which strings of ``length`` bytes also start earlier, and the number of parts: rows (part, d, first, number), blocks
    of integers. In document d strings start at first, ..., first + number - 1 that do.
    """
    spark = docs.sparkSession
    total = int(docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    buckets = max(64, total // 16_000_000)
    parts = max(64, total // 4_000_000)

    def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def low48(h: np.ndarray) -> bytes:
        return h.view(np.uint16).reshape(-1, 4)[:, :3].tobytes()

    def hash48(raw: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, 3).astype(np.uint64)
        return x[:, 0] | x[:, 1] << np.uint64(16) | x[:, 2] << np.uint64(32)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by bucket of their grams. Of a gram with more than 8 in this task only the number is sent."""
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush():
            h, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            count = np.bincount(np.cumsum(new) - 1)
            many = np.repeat(count > 8, count)
            mh, mc = h[new][count > 8], count[count > 8].astype(np.uint32)
            fd, fp = d[many], p[many]
            h, d, p = h[~many], d[~many], p[~many]
            none = b""
            out = [(b, low48(h[lo:hi]), _ids(d[lo:hi]), _ids(p[lo:hi]), none, none, none, none) for b, lo, hi in _cuts(bucket_of(h, buckets))]
            out += [(b, none, none, none, low48(mh[lo:hi]), mc[lo:hi].tobytes(), none, none) for b, lo, hi in _cuts(bucket_of(mh, buckets))]
            for lo in range(0, len(fd), 200_000):  # known to repeat
                out.append((int(fd[lo]) % buckets, none, none, none, none, none, _ids(fd[lo : lo + 200_000]), _ids(fp[lo : lo + 200_000])))
            held.clear()
            return _batches(out, ["bucket", "h", "d", "p", "mh", "mc", "fd", "fp"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for t, a, _, _, h in anchors([t.encode("utf-8") for t in texts_of(batch, "t")], length):
                held.append((h, ids[t], a))
                n += len(h)
            if n > 1_000_000:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 1):
            c = {k: t.column(k).to_pylist() for k in ("h", "d", "p", "mh", "mc", "fd", "fp")}
            h, m = hash48(c["h"]), hash48(c["mh"])
            d, p, fd, fp = _block([c["d"], c["p"], c["fd"], c["fp"]])
            every, code = np.unique(np.concatenate([h, m]), return_inverse=True)
            weight = np.concatenate([np.ones(len(h)), np.frombuffer(b"".join(c["mc"]), np.uint32)])
            n = np.bincount(code, weights=weight, minlength=len(every))
            twice = n[code[: len(h)]] > 1
            rows = _by_part(parts, np.concatenate([d[twice], fd]), np.concatenate([p[twice], fp]))
            big = np.flatnonzero(n > CROWD)
            k, z = len(rows), len(big)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(r[0] for r in rows), *[None] * z], pa.int32()), *(pa.array([*(r[i] for r in rows), *[None] * z], pa.binary()) for i in (1, 2)),
                 pa.array([*[None] * k, *every[big].astype(np.int64).tolist()], pa.int64()), pa.array([*[None] * k, *n[big].astype(np.int64).tolist()], pa.int64()), pa.array([*[0] * k, *[0] * z], pa.int64())],
                names=["part", "d", "p", "gram", "n", "_"])

    keyed = docs.withColumn("carry", F.lit(0))
    sent = docs.mapInArrow(grams, "bucket int, h binary, d binary, p binary, mh binary, mc binary, fd binary, fp binary")
    flags = scratch.write(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repeats, "part int, d binary, p binary, gram long, n long, _ long"), "flags")
    # bounded: anchors are fewer than bytes, and each gram listed has that share of them
    crowded = np.sort(flags.where(F.col("gram").isNotNull() & (F.col("n") > CROWD_SHARE * total)).select("gram").toArrow().column(0).to_numpy().astype(np.uint64))
    crowd = spark.sparkContext.broadcast(crowded)
    flags = flags.where("part IS NOT NULL")
    flagged = int(flags.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // 4
    buckets2 = max(64, flagged * 140 // 1_500_000)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each repeated anchor's strings, as one piece of text; a crowded gram's strings each on their own. Of equal
        pieces of this task the earliest is sent, the strings of the others are later ones."""
        seen: dict[bytes, tuple[int, int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        size = 0
        names = ["bucket", "d", "at", "n", "key", "text"]

        def flush():
            keys = np.asarray([v[3] for v in seen.values()], np.uint64)
            order = np.argsort(keys, kind="stable")
            pieces, facts = list(seen), list(seen.values())
            seen.clear()
            rows = []
            for b, lo, hi in _cuts(bucket_of(keys[order], buckets2)):
                own = order[lo:hi].tolist()
                cols = [np.asarray([facts[i][c] for i in own], np.int64) for c in range(3)]
                low = (keys[order[lo:hi]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((b, *map(_ids, cols[:2]), cols[2].astype(np.uint8).tobytes(), low.tobytes(), b"".join(pieces[i][1:] for i in own)))
            return _batches(rows, names)

        def local():
            d, at, n = (np.asarray(x, np.int64) for x in zip(*gone, strict=True))
            gone.clear()
            return _batch([(int(d[0]) % buckets2, _ids(d), _ids(at), n.astype(np.uint8).tobytes(), b"", b"")], names)

        def offer(piece: bytes, d: int, at: int, n: int, key: int) -> None:
            nonlocal size
            have = seen.get(piece)
            if have is None:
                seen[piece] = (d, at, n, key)
                size += len(piece) + 350
            elif have[:2] < (d, at):
                gone.append((d, at, n))
            elif have[:2] > (d, at):
                gone.append((have[0], have[1], n))
                seen[piece] = (d, at, n, key)

        for _, t in groups_of(batches, 1):
            (fd, fp), own = _split(t, ["d", "p"])
            ids = own.column("id").to_numpy()
            lo, hi = np.searchsorted(fd, ids), np.searchsorted(fd, ids, side="right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            ids = ids[some].tolist()
            texts = [x.encode("utf-8") for x in own.column("t").take(pa.array(some)).to_pylist()]
            wanted = np.concatenate([fp[lo[i] : hi[i]] + (k << 40) for k, i in enumerate(some.tolist())])
            for tx, a, first, last, h in anchors(texts, length):
                at = np.flatnonzero(np.isin((tx.astype(np.int64) << 40) + a, wanted))
                hot = np.isin(h[at] & np.uint64(0xFFFFFFFFFFFF), crowd.value) if len(crowd.value) else np.zeros(len(at), bool)
                for i, x, y, k, many in zip(tx[at].tolist(), first[at].tolist(), last[at].tolist(), h[at].tolist(), hot.tolist(), strict=True):
                    if many:
                        for s in range(x, y + 1):
                            piece = texts[i][s : s + length]
                            offer(b"1" + piece, ids[i], s, 1, int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest()))
                    else:
                        offer(b"0" + texts[i][x : y + length], ids[i], x, y - x + 1, k)
                if len(gone) > 100_000:
                    yield local()
                if size > 40_000_000:
                    yield from flush()
                    size = 0
        if gone:
            yield local()
        if seen:
            yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 1):
            c = {k: t.column(k).to_pylist() for k in ("d", "at", "n", "key", "text")}
            ready = [not x for x in c["text"]]
            take = lambda k, want: [x for x, r in zip(c[k], ready, strict=True) if r is want]
            small = lambda want: np.frombuffer(b"".join(take("n", want)), np.uint8).astype(np.int64)
            out = [(*_block([take("d", True), take("at", True)]), small(True))]
            d, at = _block([take("d", False), take("at", False)])
            n, key, raw = small(False), np.frombuffer(b"".join(take("key", False)), np.uint32), b"".join(take("text", False))
            off = np.cumsum(n + length - 1) - (n + length - 1)
            # equal pieces: all strings of the later ones are later strings
            order = np.lexsort((at, d))
            seen: dict[bytes, int] = {}
            new, again = [], []
            for i, lo, hi in zip(order.tolist(), off[order].tolist(), (off + n + length - 1)[order].tolist(), strict=True):
                j = seen.setdefault(raw[lo:hi], i)
                if j == i:
                    new.append(i)
                elif d[i] != d[j] or at[i] != at[j]:
                    again.append(i)
            del seen
            out.append((d[again], at[again], n[again]))
            # different pieces around one gram: their strings are suffix-sorted
            some = np.asarray(new, np.int64)
            _, code, many = np.unique(key[some], return_inverse=True, return_counts=True)
            some = some[many[code] > 1]
            if len(some):
                m = n[some]
                step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                doc, pos = np.repeat(d[some], m), np.repeat(at[some], m) + step
                hit = later(np.frombuffer(raw, np.uint8), np.repeat(off[some], m) + step, doc, pos, length)
                out.append(_runs(doc[hit], pos[hit]))
            d, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield from _batches(_by_part(parts, d, at, n), ["part", "d", "first", "number"])

    pieces = with_blocks(keyed, flags, parts, ["d", "p"]).mapInArrow(surroundings, "bucket int, d binary, at binary, n binary, key binary, text binary")
    runs = scratch.write(pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "part int, d binary, first binary, number binary"), "runs")
    scratch.drop("flags")
    return runs, parts


def removed_spans(first: np.ndarray, number: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [lo, hi) covered by the strings."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(first.tolist(), (first + number - 1 + length).tolist(), strict=True)):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return spans


#: What a cut leaves of characters: their last bytes at a piece's start, their first ones at its end.
SPLIT_START, SPLIT_END = re.compile(rb"[\x80-\xbf]+"), re.compile(rb"(?:[\xc0-\xff]|[\xe0-\xff][\x80-\xbf]|[\xf0-\xff][\x80-\xbf]{2})\Z")


def whole_characters(piece: bytes, after: bool, before: bool) -> bytes:
    """A piece of UTF-8 without the characters that a cut ``after`` which or ``before`` which it stands has split."""
    if after and (m := SPLIT_START.match(piece)):
        piece = piece[m.end():]
    if before and (m := SPLIT_END.search(piece, max(0, len(piece) - 3))):
        piece = piece[: m.start()]
    return piece


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Per row of ``docs``: key (an integer), n_bytes, n_removed, spans (array of struct<lo, hi>, byte offsets), kept (binary).

    Texts are taken whole as UTF-8 bytes, null as empty. Each byte goes that is covered by a string of ``length`` bytes
    which also starts earlier: in a row with a smaller key, or earlier in the same text. Strings never cross texts,
    overlaps count, and all are judged on the input. ``kept`` joins the bytes that stay; cutting can split a character,
    whose rest goes from ``kept`` too if ``whole``.
    Rows with null keys keep all and remove nothing from others; rows that repeat a key are not earlier than each
    other. Shorter texts stay whole, an empty table gives no rows, other columns are left out
    but for those named in ``carry``, which come as one struct of that name.

    No gram, however frequent, meets in one task: its strings are dealt by their own hashes, one of a kind per task.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "suffix-dedup")
    filler = "_" * (1 + max(map(len, carry), default=0))  # keeps the struct from being empty, and is nobody's name
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("t"), F.struct(F.lit(0).alias(filler), *(docs[c] for c in carry)).alias("carry"))
    runs, parts = removed_runs(rows.select("id", "t").where("id IS NOT NULL AND t IS NOT NULL"), length, scratch)
    names = ["d", "first", "number"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups_of(batches, 1):
            (d, first, number), own = _split(table, names)
            ids = own.column("id").to_pylist()
            known = np.asarray([i is not None for i in ids], bool)
            plain = np.asarray([i or 0 for i in ids], np.int64)
            los, his = np.searchsorted(d, plain), np.where(known, np.searchsorted(d, plain, side="right"), 0)
            gone, kept, spans_of, sizes = [], [], [], []
            for t, lo, hi in zip(own.column("t").to_pylist(), los.tolist(), his.tolist(), strict=True):
                t = (t or "").encode("utf-8")
                # a repeated key may have a shorter text
                spans = [(a, min(b, len(t))) for a, b in removed_spans(first[lo:hi], number[lo:hi], length) if a < len(t)] if hi > lo else []
                edges = [0, *(e for s in spans for e in s), len(t)]
                pieces = [t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                sizes.append(len(t))
                gone.append(len(t) - sum(map(len, pieces)))
                if whole:
                    pieces = [whole_characters(p, i > 0, i < len(spans)) for i, p in enumerate(pieces)]
                kept.append(b"".join(pieces))
                spans_of.append([{"lo": a, "hi": b} for a, b in spans])
            carried = own.column("carry").combine_chunks()
            for lo in range(0, len(ids), BATCH_ROWS):
                k = slice(lo, lo + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[k], pa.int64()), pa.array(sizes[k], pa.int64()), pa.array(gone[k], pa.int64()), pa.array(spans_of[k], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept[k], pa.binary()), carried.slice(lo, BATCH_ROWS)],
                    names=["id", "n_bytes", "n_removed", "spans", "kept", "carry"])

    joined = with_blocks(rows, runs, parts, names)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "n_bytes", "n_removed")])
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi")])
    schema = schema.add("spans", T.ArrayType(span)).add("kept", T.BinaryType()).add(joined.schema["carry"])
    out = joined.mapInArrow(cut, schema)
    return (out if carry else out.drop("carry")).withColumnRenamed("id", key)
