"""Word-shingle sets of whole texts, hashed to 64 bits with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed at once (a longer document is hashed alone).
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit word over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: whether it separates words, its random word (A-Z as a-z); and five odd factors."""
    code = np.arange(256)
    sep = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    rng = np.random.default_rng(41)
    letter = rng.integers(0, 1 << 64, 256, np.uint64)[lower]
    return sep, letter, rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    sep, letter, _ = _tables()
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~sep[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    p, inverse = powers(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(letter[buf] * p[: len(buf)])])
    h = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(start, first))


def shingle_sets(texts: list[str], words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. With fewer words the whole sequence is one shingle; no words: none.

    Words are runs of bytes other than blanks and tabs to carriage returns, A-Z lower-cased. Equal shingles have equal
    hashes; different ones share a 64-bit hash with negligible probability.
    """
    held: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is not None:
            held.append(t.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
        if held and (t is None or size >= CHUNK):
            yield from _sets(held, words)
            held, size = [], 0


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    h, count = word_hashes(texts)
    factors = _tables()[2]
    n = len(h)
    if n >= words:
        many = mixed(sum(h[k : n - words + 1 + k] * factors[k] for k in range(words)))
    at = 0
    for c in count.tolist():
        if c >= words:
            yield np.unique(many[at : at + c - words + 1])
        elif c:
            yield mixed(np.asarray([(h[at : at + c] * factors[:c]).sum(dtype=np.uint64) + np.uint64(c)]))
        else:
            yield np.empty(0, np.uint64)
        at += c
