"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts_of
from .token_counts import PLAIN_MERGES, plain_specials, understood, vocabulary

WINDOW = 2048
#: How texts are normalised before words are taken.
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: Distinct words whose ids a worker keeps; beyond it the memory is emptied and refilled.
KEPT_WORDS = 600_000


class _Places(dict):
    """Word -> place in the pool; a new word gets the next place and waits to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordIds:
    """Ids of texts under a word-level BPE: each distinct word is encoded once, by the library, and kept. Words are cut by
    the file's own pattern; files with other settings than it understands are refused."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        understood(path, spec, {"normalizer": NORMALISED, "truncation": None, "padding": None})
        cut, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{"type": None}]
        understood(path, cut, {"type": "Split", "behavior": "Removed", "invert": True})
        understood(path, {"after": rest}, {"after": [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
        understood(path, spec["model"], PLAIN_MERGES)
        self.words = regex.compile(cut["pattern"]["Regex"])
        self.lib = Tokenizer.from_file(path)
        names = plain_specials(path, spec["added_tokens"])
        self.specials = {name: self.lib.token_to_id(name) for name in names}
        self.split = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._empty()

    def _empty(self) -> None:
        self.at = _Places()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        """Encode words that are new, many at a time: the library cuts at the blanks between them again."""
        words = self.at.new
        self.at.new = []
        n = len(self.at) - len(words)
        while n + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            e = self.lib.encode(" ".join(part), add_special_tokens=False)
            which = np.asarray(e.word_ids, np.int64)
            if len(which) == 0 or which[-1] != len(part) - 1:  # a word the library cuts otherwise: one by one
                ids = [self.lib.encode(w, add_special_tokens=False).ids for w in part]
                lens = np.asarray(list(map(len, ids)), np.int64)
                flat = np.asarray([x for i in ids for x in i], np.uint32)
            else:
                lens = np.bincount(which, minlength=len(part)).astype(np.int64)
                flat = np.asarray(e.ids, np.uint32)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.length[n : n + len(part)] = lens
            self.start[n : n + len(part)] = self.used + np.cumsum(lens) - lens
            self.used += len(flat)
            n += len(part)

    def parts(self, text: str) -> list[str | int]:
        """Plain stretches of a text and the ids of special tokens between them."""
        if self.split is None or not any(s in text for s in self.specials):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.split.finditer(text):
            out += [text[at : m.start()], self.specials[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of many texts; words that are new to the batch are learnt together."""
        if len(self.at) > KEPT_WORDS:
            self._empty()
        look = self.at.__getitem__
        rows: list[list[np.ndarray]] = []
        for text in texts:
            row = []
            for part in self.parts(text):
                if isinstance(part, int):
                    row.append(part)
                else:
                    words = self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                    row.append(np.fromiter(map(look, words), np.int64, len(words)))
            rows.append(row)
        if self.at.new:
            self._learn()
        return [np.concatenate([np.asarray([p], np.uint32) if isinstance(p, int) else self._flat(p) for p in row]) for row in rows]

    def _flat(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return np.empty(0, np.uint32)
        lens = self.length[w]
        ends = np.cumsum(lens)
        return self.pool[np.repeat(self.start[w] - ends + lens, lens) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class SumOfSquares:
    """Online packing into windows of ``size``: an item goes where the sum of squared counts of windows at each
    partial fill level grows least. ``level[h]`` is the number of open windows filled to h; ``open[h]`` names them.
    Moving a window from level h to h + w changes the sum by 2 * (level[h + w] - level[h]) + 2, less what full or
    empty levels, which don't count, leave out."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows: list[list[int]] = []
        self.fill: list[int] = []

    def put(self, item: int, width: int) -> None:
        size, level = self.size, self.level
        used = np.flatnonzero(level[1 : size - width + 1]) + 1  # open windows with room
        best, at = 2 * level[width] + 1 if width < size else 0, 0  # a new window
        if len(used):
            grow = 2 * (level[used + width] - level[used]) + 2
            if used[-1] == size - width:
                grow[-1] = 1 - 2 * level[size - width]  # a window that becomes full leaves its level and enters none
            i = int(len(grow) - 1 - np.argmin(grow[::-1]))  # ties: the fuller window
            if grow[i] <= best:
                best, at = grow[i], int(used[i])
        if at:
            w = self.open[at].pop()
            level[at] -= 1
        else:
            w = len(self.windows)
            self.windows.append([])
            self.fill.append(0)
        self.windows[w].append(item)
        self.fill[w] = at + width
        if at + width < size:
            level[at + width] += 1
            self.open[at + width].append(w)


def place(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for one shard's documents, in order.

    A document's first full windows stand alone and its rest goes to sum-of-squares packing. When the shard ends,
    windows still open are filled up with cuts of the emptiest ones, so one window at most stays partial; that one
    is cut at the powers of two of its fill, as sequences of such lengths need no padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    packer, rest = SumOfSquares(size), []
    for d, n in enumerate(lengths.tolist()):
        whole, over = divmod(n, size)
        for k in range(whole):
            pieces.append((d, k * size, size, seq, 0))
            seq += 1
        if over:
            rest.append((d, n - over, over))
            packer.put(len(rest) - 1, over)
    partial = []
    for items, fill in zip(packer.windows, packer.fill, strict=True):
        if fill < size:
            partial.append((fill, [rest[i] for i in items]))
            continue
        at = 0
        for i in items:
            d, s, w = rest[i]
            pieces.append((d, s, w, seq, at))
            at += w
        seq += 1
    partial.sort(key=lambda p: -p[0])
    lo, hi, tail = 0, len(partial) - 1, 0
    spare: list[tuple[int, int, int]] = []
    while lo <= hi:
        fill, items = partial[lo]
        lo += 1
        at = 0
        for d, s, w in items:
            pieces.append((d, s, w, seq, at))
            at += w
        while at < size and (spare or lo <= hi):
            if not spare:
                spare = list(partial[hi][1])
                hi -= 1
            d, s, w = spare.pop()
            cut = min(w, size - at)
            pieces.append((d, s, cut, seq, at))
            at += cut
            if cut < w:
                spare.append((d, s + cut, w - cut))
        if at < size:
            tail = at
        seq += 1
    if spare:  # what the last donor had beyond the last gap
        at = 0
        for d, s, w in spare:
            pieces.append((d, s, w, seq, at))
            at += w
        tail, seq = at, seq + 1
    if tail and tail & (tail - 1):
        last = [p for p in pieces if p[3] == seq - 1]
        pieces = [p for p in pieces if p[3] != seq - 1]
        sizes = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        seq, at = seq - 1, 0
        for d, s, w, _, _ in last:
            while w:
                cut = min(w, sizes[0] - at)
                pieces.append((d, s, cut, seq, at))
                s, w, at = s + cut, w - cut, at + cut
                if at == sizes[0]:
                    sizes.pop(0)
                    seq, at = seq + 1, 0
    return pieces


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shard_docs: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``window`` tokens, as rows per piece.

    A document's ids are those of the named tokenizer without added special tokens, then ``end_id``; null texts count
    as empty and give the end id alone. Rows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id
    lies in one piece; pieces of a sequence follow each other from offset 0. Input rows are packed where they are read,
    in shards of ``shard_docs`` rows, so there is no shuffle and memory doesn't grow with the input; repeated rows are
    packed each, null keys too; an empty table gives no rows. Reruns over the same splits give the same packing.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = word_ids(vocabulary(tokenizer))
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            out = place(np.asarray(list(map(len, held)), np.int64), window)
            top = max((p[3] for p in out), default=-1)
            raw = [memoryview(h.astype("<u4").tobytes()) for h in held]
            made = pa.RecordBatch.from_arrays(
                [pa.array([keys[p[0]] for p in out], key_kind), *(pa.array([p[i] for p in out], pa.int64()) for i in (1, 2)),
                 pa.array([zlib.crc32(raw[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in out], pa.int64()),
                 pa.array([len(held[p[0]]) for p in out], pa.int64()), pa.array([base + p[3] for p in out], pa.int64()), pa.array([p[4] for p in out], pa.int64())],
                names=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += top + 1
            keys.clear()
            held.clear()
            return made

        key_kind = None
        tokens = 0
        for batch in batches:
            key_kind = batch.schema.field("k").type
            names = batch.column(0).to_pylist()
            for k, ids in zip(names, ids_of.batch(texts_of(batch, "t")), strict=True):
                keys.append(k)
                held.append(np.append(ids, np.uint32(end_id)))
                tokens += len(held[-1])
                if len(held) >= shard_docs or tokens > 16_000_000:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, padded (tokens of padding; lengths that are powers of two need none)."""
    seqs = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(F.lit(window) - F.col("n"))
    return seqs.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(pad), F.lit(0)).alias("padded"))
