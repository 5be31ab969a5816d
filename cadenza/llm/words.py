"""Words of UTF-8 bytes by numpy: every separator is ASCII, so bytes can be classed one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at once.
BLOCK = 1 << 22


def lowered() -> np.ndarray:
    """By byte: A-Z as a-z, others as they are."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to


def words_at(buf: np.ndarray, is_word: np.ndarray, lower: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, starts, ends) of the maximal runs of word bytes."""
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lower[buf[is_word]])]), start, end


class SpaceWords:
    """Words between blanks and tabs, in pieces that punctuation and line ends part."""

    def __init__(self) -> None:
        kind = np.zeros(256, np.uint8)
        kind[[0x20, 0x09]] = 1
        kind[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
        self.kind, self.lower = kind, lowered()

    def blocks(self, text: bytes) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(words, whether each begins a piece), a block of text after the other; the text's first word begins one."""
        buf = np.frombuffer(text, np.uint8)
        at, broken = 0, True
        while at < len(buf):
            end = min(at + BLOCK, len(buf))
            kind = self.kind[buf[at:end]]
            if end < len(buf) and not kind[-1]:  # not inside a word
                cut = np.flatnonzero(kind)
                if len(cut):
                    end = at + int(cut[-1]) + 1
                    kind = kind[: end - at]
                else:  # a word longer than a block
                    while end < len(buf):
                        more = np.flatnonzero(self.kind[buf[end : end + BLOCK]])
                        end = end + int(more[0]) + 1 if len(more) else min(end + BLOCK, len(buf))
                        if len(more):
                            break
                    kind = self.kind[buf[at:end]]
            words, start, stop = words_at(buf[at:end], kind == 0, self.lower)
            breaks = np.concatenate([[0], np.cumsum(kind == 2)])
            if len(start):
                before = breaks[start]
                new = np.diff(before, prepend=0) > 0
                new[0] |= broken
                broken = bool(breaks[-1] > breaks[stop[-1]])
                yield words, new
            else:
                broken |= bool(breaks[-1])
            at = end
