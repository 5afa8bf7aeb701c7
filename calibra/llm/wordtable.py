"""Words of whole batches of texts at a time, and a table of what is known of each word, in flat arrays.

A Python dictionary of words costs some 200 bytes a word and several cache misses a look. Here a word is found by its
64-bit hash, its length and its first and last byte, for all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from calibra.llm.common import CHUNK_BYTES, hash_words


class Chunk(NamedTuple):
    """Words of the texts from `row` on. counts: words of each text; data: their bytes; start, end: the words' places in it; h: their hashes; more: the last text goes on in the next chunk."""

    row: int
    counts: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    more: bool


def chunks(column: pa.Array, numbers: np.ndarray, starts: int = -1) -> Iterator[Chunk]:
    """The words of a column of texts in chunks of about CHUNK_BYTES. numbers: see common.hash_words; a word also starts at each byte `starts`. A longer text is cut between words."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, row = np.frombuffer(column.buffers()[2] or b"", np.uint8), 0

    def made(row: int, lo: int, hi: int, bounds: np.ndarray, more: bool = False) -> Chunk:
        part = data[lo:hi]
        breaks = bounds if starts < 0 else np.union1d(bounds, np.flatnonzero(part == starts))
        h, start, end = hash_words(part, numbers, breaks)
        return Chunk(row, np.diff(np.searchsorted(start, bounds)), part, start, end, h, more)

    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[to])
        if to > row + 1 or hi - lo <= 2 * CHUNK_BYTES:
            yield made(row, lo, hi, offsets[row : to + 1] - lo)
        else:
            while lo < hi:
                end = min(hi, lo + CHUNK_BYTES)
                while end < hi and numbers[data[end]]:
                    gaps = np.flatnonzero(numbers[data[end : end + CHUNK_BYTES]] == 0)
                    end = min(hi, end + (int(gaps[0]) if len(gaps) else CHUNK_BYTES))
                yield made(row, lo, end, np.array([0, end - lo]), end < hi)
                lo = end
        row = to


def hashed_words(column: pa.Array, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, counts, hashes): the hashes of all words of the texts from a row on, and how many words each text has; null has none."""
    parts: list[np.ndarray] = []
    for c in chunks(column, numbers):
        parts.append(c.h)
        if not c.more:
            yield c.row, c.counts if len(parts) == 1 else np.array([sum(map(len, parts))]), parts[0] if len(parts) == 1 else np.concatenate(parts)
            parts = []


def text_hashes(text: str | None, numbers: np.ndarray) -> np.ndarray:
    """The hashes of the words of one text."""
    return np.concatenate([np.empty(0, np.uint64), *(h for _, _, h in hashed_words(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()), numbers))])


class WordTable:
    """Numbers of words. make(word) gives those of a new one as (little-endian 32-bit numbers, flag); with together, make(words) a list of these for a chunk's new ones.

    Open addressing over 2^bits slots. A table that is half full is emptied before the next chunk, so its size is bounded.
    """

    def __init__(self, make: Callable, bits: int = 20, together: bool = False):
        self.make, self.bits = make if together else lambda words: list(map(make, words)), bits
        self.empty()

    def empty(self) -> None:
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.first, self.size, self.flag, self.tag = (np.zeros(1 << 12, k) for k in (np.int64, np.int32, bool, np.uint32))
        self.pool, self.words, self.used = np.zeros(1 << 14, np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its word's number, or -1; and the slot where the search ended."""
        mask, slot, found = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64), np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            have = self.keys[slot[todo]]
            hit = have == h[todo]
            found[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (have != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return found, slot

    def _add(self, c: Chunk, h: np.ndarray, tags: np.ndarray, where: np.ndarray) -> None:
        data = c.data.tobytes()
        made = self.make([data[s:e] for s, e in zip(c.start[where].tolist(), c.end[where].tolist())])
        raw = np.frombuffer(b"".join([x for x, _ in made]), "<u4")
        sizes = np.array([len(x) // 4 for x, _ in made], np.int32)
        n, to = self.words, self.words + len(made)
        while to > len(self.first):
            self.first, self.size, self.flag, self.tag = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.flag, self.tag))
        while self.used + len(raw) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.first[n:to], self.size[n:to], self.flag[n:to], self.tag[n:to] = self.used + np.cumsum(sizes) - sizes, sizes, [x for _, x in made], tags[where]
        self.pool[self.used : self.used + len(raw)] = raw
        self.words, self.used = to, self.used + len(raw)
        new, number = h[where], np.arange(n, to, dtype=np.int32)
        while len(new):
            _, slot = self._find(new)
            ours = np.unique(slot, return_index=True)[1]  # of those that meet in a slot one gets it
            self.keys[slot[ours]], self.at[slot[ours]] = new[ours], number[ours]
            left = np.ones(len(new), bool)
            left[ours] = False
            new, number = new[left], number[left]

    def look(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words of the chunk, one behind the other; how many each word has), and flags by word: see flags()."""
        if self.words > 1 << (self.bits - 1) or self.used > 1 << (self.bits + 2):
            self.empty()
        h = np.maximum(c.h, np.uint64(1))
        long = c.end - c.start
        tags = (np.minimum(long, 0xFFFF).astype(np.uint32) << np.uint32(16)) | (c.data[c.start].astype(np.uint32) << np.uint32(8)) | c.data[c.end - 1] if len(h) else np.empty(0, np.uint32)
        found, _ = self._find(h)
        wrong = (found >= 0) & (self.tag[np.maximum(found, 0)] != tags)
        if wrong.any():  # another word of the same hash: a hash of its own tells them apart
            h = np.where(wrong, h ^ (tags.astype(np.uint64) << np.uint64(20)) ^ np.uint64(0x9E37), h)
            found = np.where(wrong, self._find(h)[0], found)
        if len(missing := np.flatnonzero(found < 0)):
            self._add(c, h, tags, missing[np.unique(h[missing], return_index=True)[1]])
            found[missing] = self._find(h[missing])[0]
        self.found = found
        sizes = self.size[found].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.first[found] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    def flags(self) -> np.ndarray:
        """The flags of the words of the chunk that was looked up last."""
        return self.flag[self.found]


def by_text(c: Chunk, sizes: np.ndarray) -> np.ndarray:
    """How many numbers each text of the chunk has."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate([[0], np.cumsum(c.counts)])
    return ends[words[1:]] - ends[words[:-1]]
