"""Token counts by prefix dynamic programming.

The byte-pair encoding of every prefix of a string ends in exactly one token: the one that is a suffix of the
prefix and compatible with the last token of what stands before it, where two tokens are compatible if encoding
their concatenation gives back just the two. So ``count[p] = count[p - len(token)] + 1``, and one pass over a string
stores the exact count at every prefix. Pre-tokenisation cuts texts into pieces that never merge; tables are kept per
distinct piece, and a text's table is the running sum of its pieces' counts.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import short_batches, texts_of, with_columns

#: Fixed value: the byte-level pre-tokeniser's pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct pieces whose counts a worker keeps; beyond it the memory is emptied and refilled.
KEPT_PIECES = 800_000


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Settings of a vocabulary's merges that change what they give, and the values that are understood here.
PLAIN_MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def understood(path: str, found: dict, want: dict) -> None:
    """Refuse a tokenizer file whose settings would be read wrongly."""
    odd = {k: found.get(k) for k, v in want.items() if found.get(k, v) != v}
    if odd:
        raise ValueError(f"{path}: tokenizer settings that are not supported: {odd}")


def plain_specials(path: str, added: list[dict]) -> list[str]:
    """Special strings, longest first, as the library finds them: anywhere, exactly as written."""
    for t in added:
        understood(path, t, {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False})
    return sorted((t["content"] for t in added), key=len, reverse=True)


class PrefixCounter:
    """Exact token counts at all prefixes, for a byte-level BPE of the ``tokenizers`` library. Files with other settings
    than it understands are refused."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        understood(path, spec, {"normalizer": None, "truncation": None, "padding": None})
        understood(path, spec["pre_tokenizer"] or {"type": None}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
        understood(path, spec["model"], {**PLAIN_MERGES, "end_of_word_suffix": None})
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = plain_specials(path, spec["added_tokens"])
        self.tokens = {raw(t) for t in spec["model"]["vocab"]}
        self.longest = max(map(len, self.tokens))
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((raw(a), raw(b)), rank)
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = _Counts(self)

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a short string, by applying merges in rank order."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def table(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, by bytes; entry 0 is 0."""
        n = len(piece)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        tokens, pairs, longest = self.tokens, self.pairs, self.longest
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in tokens:
                    before = last[start]
                    if start:
                        ok = pairs.get((before, token))
                        if ok is None:
                            ok = self.compatible(before, token)
                        if not ok:
                            continue
                    last[end], count[end] = token, count[start] + 1
                    break
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        counts = self.counts
        if self.split is None or not any(s in text for s in self.specials):
            return sum(map(counts.__getitem__, PIECES.findall(text)))
        at = total = 0
        for m in self.split.finditer(text):
            total += 1 + sum(map(counts.__getitem__, PIECES.findall(text[at : m.start()])))
            at = m.end()
        return total + sum(map(counts.__getitem__, PIECES.findall(text[at:])))

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """(character ends of the pieces, token counts up to there), both starting with 0."""
        ends, sums, pos = [0], [0], 0
        for m in [*(self.split.finditer(text) if self.split else ()), None]:
            stop = m.start() if m else len(text)
            pieces = PIECES.findall(text[pos:stop])
            ends += [pos + e for e in accumulate(map(len, pieces))]
            base = sums[-1]
            sums += [base + c for c in accumulate(self.counts[p] for p in pieces)]
            if m:
                ends.append(m.end())
                sums.append(sums[-1] + 1)
                pos = m.end()
        return ends, sums

    def at_prefix(self, text: str, length: int, known: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of ``text[:length]`` without encoding it again.

        A cut inside a piece needs that piece's table only; where the cut can change how the last piece was split
        (white space, contractions, special tokens) the piece before it is split anew as well.
        """
        ends, sums = known or self.boundaries(text)
        i = bisect_right(ends, min(length, len(text))) - 1
        if ends[i] == length or length >= len(text):
            if i == 0 or not text[ends[i - 1] : ends[i]].isspace():
                return sums[i]
        back = i
        while back and (text[ends[back - 1] : ends[back]].isspace()):
            back -= 1
        return sums[back] + self.count(text[ends[back] : length])


class _Counts(dict):
    def __init__(self, counter: PrefixCounter) -> None:
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT_PIECES:
            self.clear()
        n = self[piece] = self.counter.table(piece.encode("utf-8"))[-1]
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """A worker's counter, with its memory of pieces."""
    return PrefixCounter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Texts are counted whole; null counts as empty (0 bytes, 0 tokens). Other columns are left out, repeated rows and
    repeated or null keys give a row each. No shuffle: each task counts the rows it reads. ``tokenizer`` names a
    byte-level BPE file of the public tokenizers; it is resolved where the task runs.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary(tokenizer))
        for batch in batches:
            texts = texts_of(batch, "t")
            n = [c.count(t) for t in texts]
            yield with_columns(batch, ["k"], {"n_bytes": pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)


def prefix_tables(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ends array<int> (characters) and counts array<int>, the stored prefix table.

    ``PrefixCounter.at_prefix`` answers any cut from them. Null and empty texts give ([0], [0]).
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary(tokenizer))
        for batch in batches:
            both = [c.boundaries(t) for t in texts_of(batch, "t")]
            yield with_columns(batch, ["k"], {"ends": pa.array([b[0] for b in both], pa.list_(pa.int32())), "counts": pa.array([b[1] for b in both], pa.list_(pa.int32()))})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ends array<int>, counts array<int>")
    return out.withColumnRenamed("k", key)


def budget_cut(docs: DataFrame, budget: int, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, cut (characters of the longest stored prefix within ``budget`` tokens) and its n_tokens."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary(tokenizer))
        for batch in batches:
            cut, n = [], []
            for t in texts_of(batch, "t"):
                ends, sums = c.boundaries(t)
                i = bisect_right(sums, budget) - 1
                cut.append(ends[i])
                n.append(sums[i])
            yield with_columns(batch, ["k"], {"cut": pa.array(cut, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, cut long, n_tokens long")
    return out.withColumnRenamed("k", key)
