"""Merges of a BPE model, for many words at a time, in flat arrays."""

from __future__ import annotations

import numpy as np

#: Characters of the longest word, and words folded at a time.
LONGEST, WORDS = 32, 20_000
#: Words of up to so many characters are folded together.
_GROUPS = (12, LONGEST)
_FACTOR, _EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)
#: A pair's cost is its piece's rank, by score, and its place: 6 bits.
_PLACE, _NEVER = 6, (1 << 25) - 1


class Merges:
    """Symbols are numbers: of the model's pieces, of characters that stand in pieces but are none, and 0 of any other character.

    Each round merges the best pair of every word, the leftmost of equals, until no word has one.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        loose = sorted({c for x in ids for c in x} - ids.keys())
        symbols = {x: k for k, x in enumerate([*ids, *loose], 1)}
        ranks = np.unique(np.array([-scores[x] for x in ids]), return_inverse=True)[1]
        self.ids = np.array([-1, *ids.values(), *[-1] * len(loose)], np.int64)
        self.ranks = np.concatenate([[_NEVER], ranks, np.full(len(loose), _NEVER)]).astype(np.int32)
        self.chars = np.zeros(0x110000, np.int32)
        for x, k in symbols.items():
            if len(x) == 1:
                self.chars[ord(x)] = k
        pairs = [(a, b, k) for x, k in symbols.items() for i in range(1, len(x)) if (a := symbols.get(x[:i])) and (b := symbols.get(x[i:]))]
        self.width = np.uint64(len(symbols) + 1)
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.joined = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32)
        left, right, to = np.array(pairs or np.empty((0, 3)), np.uint64).T
        keys = left * self.width + right
        slots = ((keys * _FACTOR) >> self.shift).astype(np.int64)
        while len(keys):
            ours = np.zeros(len(keys), bool)
            ours[np.unique(slots, return_index=True)[1]] = True  # of those that meet in a slot one gets it
            ours &= self.keys[slots] == _EMPTY
            self.keys[slots[ours]], self.joined[slots[ours]] = keys[ours], to[ours]
            keys, to, slots = keys[~ours], to[~ours], (slots[~ours] + 1) & self.mask

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or 0."""
        key = left.astype(np.uint64) * self.width + right.astype(np.uint64)
        slot = ((key * _FACTOR) >> self.shift).astype(np.int64)
        have = self.keys[slot]
        hit = have == key
        out = np.where(hit, self.joined[slot], 0)
        todo = np.flatnonzero(~hit & (have != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            have = self.keys[slot[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.joined[slot[todo[hit]]]
            todo = todo[~hit & (have != _EMPTY)]
        return out

    def _merge(self, symbols: np.ndarray) -> None:
        """Merges the words that stand in the columns, between a row of 0 above and one below. What a merge takes in becomes -1."""
        rows, n = symbols.shape
        flat = symbols.reshape(-1)
        after, before = np.arange(len(flat)) + n, np.arange(len(flat)) - n
        cost, joined = np.full(len(flat), _NEVER << _PLACE, np.int32), np.zeros(len(flat), np.int32)

        def weigh(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            joined[at] = made = self._join(left, right)
            cost[at] = (self.ranks[made] << _PLACE) + at // n

        at = np.flatnonzero((flat[:-n] > 0) & (flat[n:] > 0))
        weigh(at, flat[at], flat[at + n])
        by_row = cost.reshape(rows, n)
        while True:
            best = by_row.min(axis=0)
            words = np.flatnonzero(best < _NEVER << _PLACE)
            if not len(words):
                return
            at = (best[words] & ((1 << _PLACE) - 1)).astype(np.int64) * n + words
            gone, made = after[at], joined[at]
            flat[at], flat[gone], cost[gone] = made, -1, _NEVER << _PLACE
            following, previous = after[gone], before[at]
            after[at], before[following] = following, at
            weigh(np.concatenate([at, previous]), np.concatenate([made, flat[previous]]), np.concatenate([flat[following], made]))

    def fold(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit numbers; None of a word that is too long or keeps a character that is no piece."""
        out: list[bytes | None] = []
        for k in range(0, len(words), WORDS):
            out += self._fold(words[k : k + WORDS])
        return out

    def _fold(self, words: list[str]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.chars[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts, least = np.cumsum(sizes) - sizes, 0
        for most in _GROUPS:
            which = np.flatnonzero((sizes > least) & (sizes <= most))
            least = most
            if not len(which):
                continue
            n, longest = sizes[which], int(sizes[which].max())
            column = np.repeat(np.arange(len(which)), n)
            row = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
            symbols = np.zeros((longest + 2, len(which)), np.int32)
            symbols[row + 1, column] = codes[np.repeat(starts[which], n) + row]
            self._merge(symbols)
            by_word = symbols[1:-1].T
            live = (by_word >= 0) & (np.arange(longest) < n[:, None])
            ids, counts = self.ids[by_word[live]], live.sum(axis=1)
            ends = np.cumsum(counts)
            odd = np.zeros(len(which), bool)
            odd[np.searchsorted(ends, np.flatnonzero(ids < 0), side="right")] = True
            raw, ends = ids.astype("<u4").tobytes(), 4 * ends
            for word, lo, hi, skip in zip(which.tolist(), (ends - 4 * counts).tolist(), ends.tolist(), odd.tolist()):
                if not skip:
                    out[word] = raw[lo:hi]
        return out
