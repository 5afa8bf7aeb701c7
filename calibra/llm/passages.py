"""Near-duplicate passages across documents, found through compact windows.

Tokens are hashes of 5-word shingles. For each of HASHES min-hash functions a document's tokens form a Cartesian tree,
and each node whose subtree has at least the least passage's length is a compact window (l, c, r): every subsequence
that holds c and lies within l..r has the min-hash of c. Windows whose min-hash stands in the same run of RUN words
share a signature. Windows of equal signature meet: the first by doc_id represents the rest, first among the documents
of a block (before the shuffle), then among blocks. That first document may hold less of a passage than two others
share, so documents meet once more: wherever a document's window has a signature that another document holds too, runs
of so many words around the anchor that two passages which share one are similar enough by that alone are keys, and
their holders link to the first of them. Of these runs those with a locally least hash are taken, so that any stretch of
the least passage's words has one. The intervals of a pair are joined over both meetings, and a pair that enough
functions or a run agree on is verified on both documents' tokens.

A run of the least passage's words that a document holds again is left out where it is repeated, so a line that is
repeated a thousand times gives one passage and not one for each place it could be shifted to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import BROADCAST_ROWS, SPACED, cut, frugal, mix, release, run_hashes
from calibra.llm.wordtable import hashed_words, text_hashes

WIDTH = 5
JACCARD = 0.8
MIN_WORDS = 50
HASHES, ENOUGH = 8, 2
RUN = 12
#: Words to either side of an anchor that one window is followed for; longer passages have further anchors, in repeated lines too.
SIDE = 4095
#: Words whose windows are looked for at a time, and whose first holders represent the rest; a document longer than SEGMENT is cut into segments that overlap by OVERLAP.
BLOCK, SEGMENT, OVERLAP = 400_000, 1 << 16, 1024
#: Ranges of keys to a shuffle partition, of which a task holds one at a time, and rows of links that go to one of them together.
PARTS, SLICE = 4, 1024
#: Positions to a stretch: a pair's windows are joined by stretches, which bounds what is compared at a time.
STRETCH = 4096
#: Links that one task follows for one document; of a document that represents more the text goes to several tasks.
ASKED = 20_000
#: Rows of a run, or of a context of parted runs, that a task holds at a time; those of one that has more are dealt out and sorted by Spark.
GROUP = 50_000
#: Rounds in which runs, and keys of such contexts, are sorted: each shuffles its share of them, and frees it before the next.
ROUNDS = 2
#: Places of equal tokens of two passages that are compared at a time.
MATCHES = 20_000
#: Documents that are looked up by a list of their ids, which goes to every task; texts of more are dealt out and joined.
LISTED = 50_000
#: Bits of a row's key that tell texts of one id apart, and the ids that leave room for them.
TEXT_BITS = 23
MOST_ID = 1 << (62 - TEXT_BITS)


def shared_tokens(least: int, jaccard: float) -> int:
    """How many tokens two passages of `least` tokens must share to be similar enough."""
    return max(1, math.ceil(2 * least * jaccard / (1 + jaccard) - 1e-9))


def compact_windows(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), ends included, of the nodes with subtrees of at least `least` in the Cartesian trees of the stretches of x between zeros.

    Of equal values that tie for a subtree's minimum so many are given that each run of `least` places holds one.
    """
    none = np.empty(0, np.int64)
    if len(x) < least:
        return none, none, none
    gaps = np.flatnonzero(x == 0)
    longest = int(np.diff(np.concatenate([[-1], gaps, [len(x)]])).max()) - 1
    if longest < least:
        return none, none, none
    table, size = [x], 1
    while size * 2 <= longest:  # no window is longer
        low = table[-1]
        table.append(np.minimum(low[:-size], low[size:]))
        size *= 2
    j = least.bit_length() - 1
    low = np.minimum(table[j][: len(x) - least + 1], table[j][least - (1 << j) : len(x) - (1 << j) + 1])
    starts = np.flatnonzero((low > 0) & np.concatenate([[True], low[1:] != low[:-1]]))
    if not len(starts):
        return none, none, none
    c, v = starts.copy(), low[starts]  # the first place of the minimum: what lies before it is greater
    for k in range(j, -1, -1):
        to = c + (1 << k)
        c = np.where((to <= len(x)) & (table[k][np.minimum(c, len(table[k]) - 1)] > v), to, c)
    # where the minimum stays the same for longer than its place is in reach, an equal one takes over: the farthest in reach
    last, found = np.concatenate([starts[1:], [len(low)]]), [c]
    ends = np.flatnonzero((low == 0) & np.concatenate([[True], low[:-1] > 0]))
    last = np.minimum(last, np.concatenate([ends, [len(low)]])[np.searchsorted(ends, starts, side="right")])
    while (on := c + 1 < last).any():
        c, last = c[on], last[on]
        c = c + least - np.concatenate([x[s[:, None] + 1 + np.arange(least)[::-1]].argmin(axis=1) for s in np.array_split(c, len(c) // 20_000 + 1)])
        found.append(c)
    c = np.sort(np.concatenate(found))
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    v, left, right = x[c], c.copy(), c + 1
    for j in range(len(table) - 1, -1, -1):
        step, low = 1 << j, table[j]
        to = left - step
        left = np.where((to >= 0) & (low[np.maximum(to, 0)] >= v), to, left)
        fits = right + step <= len(x)
        right = np.where(fits & (low[np.minimum(right, len(low) - 1)] >= v), right + step, right)
    return left, c, right - 1


def _repeated(h: np.ndarray, sizes: np.ndarray, min_words: int) -> np.ndarray:
    """Whether a word lies only in runs of min_words words that its document (they stand one behind the other) holds before."""
    n, out = len(h) - min_words + 1, np.zeros(len(h), bool)
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    runs = run_hashes(h, min_words) ^ mix(doc[:n] + np.uint64(1))
    inside = doc[:n] == doc[min_words - 1 :]
    ordered = np.sort(runs[inside])
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return out
    at = np.flatnonzero(inside & np.isin(runs, again))
    later = np.ones(len(at), bool)
    later[np.unique(runs[at], return_index=True)[1]] = False
    fresh = inside.copy()
    fresh[at[later]] = False
    edge = np.zeros(len(h) + 1, np.int64)  # words of a run that stands for the first time
    edge[:n] += fresh
    edge[min_words:] -= fresh[: len(edge) - min_words]
    twice = np.zeros(len(h) + 1, np.int64)
    np.add.at(twice, at[later], 1)
    np.add.at(twice, at[later] + min_words, -1)
    return (np.cumsum(edge)[:-1] == 0) & (np.cumsum(twice)[:-1] > 0)


def _block_rows(ids: list[int], hashes: list[np.ndarray], places: list[int], least: int, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(part, firsts, same, linked) of a block; packed: anchor << 28 | function << 24 | words before << 12 | words after.

    Each is columns of 64-bit numbers, one behind the other, of rows sorted by key; parts are ranges of keys. firsts: (key,
    doc, packed) of a key's first row, packed negated (~) if another document of the block has the key. same: (key, doc,
    packed, rep_packed) of further rows of that document. linked: (key, doc, packed, rep, rep_packed) of the other ones,
    which any part may have.
    """
    order = sorted(range(len(ids)), key=lambda k: (ids[k], places[k]))
    found, n, some = [], 0, []
    for k in order:  # as many documents at a time as keep what is worked on small
        some.append(k)
        n += len(hashes[k])
        if n >= SEGMENT:
            found.append(_windows_of([ids[k] for k in some], [hashes[k] for k in some], [places[k] for k in some], least))
            some, n = [], 0
    if some:
        found.append(_windows_of([ids[k] for k in some], [hashes[k] for k in some], [places[k] for k in some], least))
    key, doc, pack = (np.concatenate(z) for z in zip(*found))
    if not len(key):
        return
    order = np.argsort(key, kind="stable")  # within a key rows stay in order of document and place
    key, doc, pack = key[order], doc[order], pack[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rep = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    linked = doc != doc[rep]
    several = np.logical_or.reduceat(linked, np.flatnonzero(new))
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    out = [[], [], []]
    for cols, to in (((key[new], doc[new], np.where(several, ~pack[new], pack[new])), out[0]), ((*(x[~new & ~linked] for x in (key, doc, pack, pack[rep])),), out[1])):
        edges = [0, *np.searchsorted(cols[0], bounds).tolist(), len(cols[0])]
        to += [np.concatenate([x[lo:hi].view(np.int64) for x in cols]).tobytes() if hi > lo else b"" for lo, hi in zip(edges, edges[1:])]
    out[2], cols, start = [[] for _ in range(parts)], [x[linked].view(np.int64) for x in (key, doc, pack, doc[rep], pack[rep])], int(key[0]) % parts
    for k, lo in enumerate(range(0, len(cols[0]), SLICE)):
        out[2][(start + k) % parts].append(np.concatenate([x[lo : lo + SLICE] for x in cols]).tobytes())
    for part, (firsts, same, others) in enumerate(zip(*out)):
        if firsts or same or others:
            yield part, firsts, same, others[0] if others else b""
        for x in others[1:]:
            yield part, b"", b"", x


def _windows_of(ids: list[int], hashes: list[np.ndarray], places: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, packed) of the compact windows of some documents."""
    h, sizes = np.concatenate(hashes), np.array([len(h) for h in hashes])
    ends = np.cumsum(sizes)
    off, of_doc, first = ends - sizes, np.array(ids, np.int64), np.array(places, np.int64)
    x = np.zeros(len(h), np.uint64)
    x[: len(h) - WIDTH + 1] = np.maximum(run_hashes(h, WIDTH), np.uint64(1))
    for k in range(1, WIDTH):
        x[ends - k] = 0  # no shingle goes over a document's end
    left_out = _repeated(h, sizes, least + WIDTH - 1)
    x[left_out] = 0
    run = run_hashes(h, RUN)
    keys, docs, packed = [], [], []
    for f in range(HASHES):
        y = ((x * np.uint64((2 * f + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32)
        y = np.where(x > 0, y | np.uint32(1), np.uint32(0))
        l, c, r = compact_windows(y, least)
        d = np.searchsorted(off, c, side="right") - 1
        a = np.minimum(c, ends[d] - RUN)  # the run that holds the shingle
        keys.append(mix(run[a] + np.uint64(f + 1)))
        docs.append(of_doc[d])
        before, after = np.minimum(a - l, SIDE), np.minimum(r + WIDTH - 1 - a, SIDE)
        packed.append(((a - off[d] + first[d]) << 28) | (f << 24) | (before << 12) | after)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(packed)


ROWS = "part int, firsts binary, same binary, linked binary"


@frugal
def _windows(least: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> Iterator[pa.RecordBatch]:
        if ids and (found := list(_block_rows(ids, hashes, places, least, parts))):
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary() if k else pa.int32()) for k, z in enumerate(zip(*found))], names=["part", "firsts", "same", "linked"])

    ids, hashes, places, n = [], [], [], 0
    for b in batches:
        doc = b.column(0).to_pylist()
        for row, counts, found in hashed_words(b.column(1), SPACED):
            for i, h in zip(doc[row : row + len(counts)], np.split(found, np.cumsum(counts)[:-1])):
                for k in range(0, max(1, len(h) - OVERLAP), SEGMENT):
                    part = h[k : k + SEGMENT + OVERLAP]
                    if len(part) < least + WIDTH - 1:
                        continue
                    ids.append(i)
                    hashes.append(part)
                    places.append(k)
                    n += len(part)
                    if n >= BLOCK:
                        yield from flush()
                        ids, hashes, places, n = [], [], [], 0
    yield from flush()


MET = "key long, doc long, packed long, rep long, rep_packed long"


@frugal
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _block_rows come sorted by part; links of a block pass, and the blocks' first rows link to the key's first.

    Rows of the first document itself pass too (doc = rep) if another document has the key.
    """
    names = ["key", "doc", "packed", "rep", "rep_packed"]

    def made(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    def met(firsts: list[np.ndarray], same: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc, pack = (np.concatenate(z) for z in zip(*firsts))
        order = np.argsort(key)
        twice = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
        at = order[twice[1:] | twice[:-1] | (pack[order] < 0)]  # all others stand alone
        if not len(at):
            return
        key, doc, pack = key[at], doc[at], pack[at]
        held, pack = pack < 0, np.where(pack < 0, ~pack, pack)
        order = np.lexsort((pack, doc, key))
        key, doc, pack, held = key[order], doc[order], pack[order], held[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        to, to_pack = doc[starts][group], pack[starts][group]
        several = np.logical_or.reduceat(held | (doc != to), starts)
        keep = several[group]
        yield from made([x[keep] for x in (key, doc, pack, to, to_pack)])
        if same and (keys := key[starts][several]).size:
            key, doc, pack, to_pack = (np.concatenate(z) for z in zip(*same))
            keep = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            yield from made([x[keep] for x in (key, doc, pack, doc, to_pack)])

    now, firsts, same = None, [], []
    for b in batches:
        for part, *blobs in zip(*(c.to_pylist() for c in b.columns)):
            if part != now:
                if firsts:
                    yield from met(firsts, same)
                now, firsts, same = part, [], []
            for blob, n, to in zip(blobs, (3, 4, 5), (firsts, same, None)):
                if blob:
                    cols = list(np.frombuffer(blob, np.int64).reshape(n, -1))
                    if to is None:
                        yield from made(cols)
                    else:
                        to.append(cols)
    if firsts:
        yield from met(firsts, same)


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """The places of which one stands for each run of width neighbours: the first of its least."""
    if len(x) < width:
        return np.empty(0, np.int64)
    if width == 1:
        return np.arange(len(x))
    low, size = x, 1
    while size * 2 <= width:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    low = np.minimum(low[: len(x) - width + 1], low[width - size : len(x) - size + 1])
    taken, after = np.zeros(len(x), bool), np.full(len(low), -1)
    for k in range(width):
        here = (after < 0) & (x[k : k + len(low)] == low)
        after[here] = k
    taken[np.arange(len(low)) + after] = True
    return np.flatnonzero(taken)


@frugal
def _wholes(core: int, slack: int, again: bool, turn: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (doc, text last): a document's text, then ranges of words; (key, doc, at) of runs of core words that start there.

    Any slack neighbouring runs have one that is given; of a turn, those that are due in that one of ROUNDS. A run that the
    document holds again is given once, or each time if again; then with the words before and after it, with 32 bits each of the runs of WIDTH words that lie beside it and
    one word off, behind it and ahead of it (0: there is none), and with a hash of its root. Ranges with a root are
    passages that were linked (root, by: the other document, and how far its place is on); a run's root is the least place
    that it is linked to, or its own.
    """
    now, words, asked, linked, out, n = None, None, [], [], [], 0

    def keys() -> Iterator[pa.RecordBatch]:
        nonlocal out, n
        if asked and words is not None and len(words) >= core:
            run = run_hashes(words, core)
            edge = np.zeros(len(run) + 1, np.int64)
            for lo, hi in asked:
                lo, hi = np.clip(lo, 0, len(run)), np.clip(hi + 1, 0, len(run))
                np.add.at(edge, lo[hi > lo], 1)
                np.add.at(edge, hi[hi > lo], -1)
            at = least_of_each(run, min(slack, len(run)))
            at = at[np.cumsum(edge)[at] > 0]
            if turn is not None:
                at = at[run[at] % np.uint64(ROUNDS) == turn]
            if not again:
                at = at[np.sort(np.unique(run[at], return_index=True)[1])]
            rows = (run[at].view(np.int64), np.full(len(at), now, np.int64), at)
            if again:
                side = lambda x, to: np.where((to >= 0) & (to < len(x)), x[np.clip(to, 0, len(x) - 1)], np.uint64(0)).view(np.int64)
                near = np.maximum(run_hashes(words, WIDTH) >> np.uint64(32), np.uint64(1))
                both = lambda x, y: (side(near, x) << 32) | side(near, y)
                rows += (side(words, at - 1), side(words, at + core), both(at + core, at + core + 1), both(at - WIDTH, at - WIDTH - 1), roots(len(run), at))
            out.append(rows)
            n += len(at)
        if n >= BLOCK:
            yield batch()
            out, n = [], 0

    def roots(size: int, of: np.ndarray) -> np.ndarray:
        doc, at = np.full(size, now, np.int64), np.arange(size)
        for root, by, lo, hi in sorted(linked, reverse=True):  # the least comes last and stays
            lo, hi = max(0, lo), max(0, hi - core + 1)
            doc[lo:hi], at[lo:hi] = root, np.arange(lo, min(hi, size)) + by
        return mix(mix(doc[of].view(np.uint64)) + at[of].view(np.uint64)).view(np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["key", "doc", "at", "before", "after", "behind", "ahead", "root"][: 8 if again else 3])

    for b in batches:
        doc = b.column(0).to_numpy()
        lo, hi = (b.column(k).fill_null(-1).to_numpy() for k in (2, 3))
        asks = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        root, by = (b.column(k).fill_null(0).to_numpy() for k in (4, 5)) if again else (None, None)
        links = b.column(4).is_valid().to_numpy(zero_copy_only=False) if again else np.zeros(len(doc), bool)
        for row, counts, found in hashed_words(b.column(1), SPACED):
            ends, to = np.cumsum(counts), row + len(counts)
            starts = np.flatnonzero(np.concatenate([[True], doc[row + 1 : to] != doc[row : to - 1]])) + row
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), to]):
                if doc[s] != now:
                    yield from keys()
                    now, words, asked, linked = doc[s], None if asks[s] else found[ends[s - row] - counts[s - row] : ends[s - row]].copy(), [], []
                if (own := asks[s:e] & ~links[s:e]).any():
                    asked.append((lo[s:e][own], hi[s:e][own]))
                if (own := links[s:e]).any():
                    linked += zip(*(x[s:e][own].tolist() for x in (root, by, lo, hi)))
    yield from keys()
    if out:
        yield batch()


@frugal
def _meet_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, doc, at); those of other documents link to the key's first."""
    last, last_doc, last_at = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, doc, at = (b.column(k).to_numpy() for k in range(3))
        new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        to = np.where(first >= 0, doc[np.maximum(first, 0)], last_doc)
        to_at = np.where(first >= 0, at[np.maximum(first, 0)], last_at)
        last, last_doc, last_at = key[-1], to[-1], to_at[-1]
        keep = doc != to
        yield pa.RecordBatch.from_arrays([pa.array(z[keep]) for z in (doc, at, to, to_at)], names=["doc", "at", "rep", "rep_at"])


def parted_words(least: int, jaccard: float) -> int:
    """How many words two passages must share to be similar enough by that alone, if they stand in two runs with one word changed, put in or left out between them."""
    n = 2 * WIDTH
    while n - 2 * (WIDTH - 1) < jaccard * (2 * max(least, n + 2 - WIDTH) - n + 2 * (WIDTH - 1)) - 1e-9:
        n += 1
    return n


def parted_sides(words: np.ndarray, places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, keys) of two runs of `total` words together that are one behind the other or have one word between them.

    places: 4 * at + side (0: the longer run is the first and ends there, 2: it is the second and starts there) + words
    between. keys: one for each length of the longer run, from half of `total` on; 0 where the words don't suffice. Equal
    keys have runs of equal words and lengths. All keys of a place hold its context, so places of equal keys have equal
    contexts.
    """
    n, u, base, least = len(words), np.uint64, 0x9E3779B97F4A7C15, (total + 1) // 2
    up = np.multiply.accumulate(np.concatenate([[u(1)], np.full(n, u(base))]))
    down = np.multiply.accumulate(np.concatenate([[u(1)], np.full(n, u(pow(base, -1, 1 << 64)))]))
    sums = np.concatenate([[u(0)], np.cumsum(words * up[:n], dtype=np.uint64)])
    run = lambda lo, size: mix((sums[lo + size] - sums[lo]) * down[lo] + np.asarray(size).astype(np.uint64))
    at, first, gap = places // 4, places % 4 < 2, places % 2
    inside = np.where(first, (at >= least) & (at + gap + WIDTH <= n), (at + least <= n) & (at - gap >= WIDTH))
    places, at, first, gap = (x[inside] for x in (places, at, first, gap))
    kind, longer = np.where(first, u(1), u(2)), np.arange(least, total - WIDTH + 1)
    context = mix(mix(run(at - least * first, least) + kind) + run(np.where(first, at + gap, at - gap - WIDTH), WIDTH))
    size, kind, at, first, gap = longer[None, :], kind[:, None], at[:, None], first[:, None], gap[:, None]
    lo, other = at - size * first, np.where(first, at + gap, at - gap - total + size)
    fits = (lo >= 0) & (lo + size <= n) & (other >= 0) & (other + total - size <= n)
    size = np.broadcast_to(size, fits.shape)
    keys = np.zeros(fits.shape, np.uint64)
    keys[fits] = np.maximum(mix(mix(run(lo[fits], size[fits]) + np.broadcast_to(kind, fits.shape)[fits]) + run(other[fits], total - size[fits])), u(1))
    return context, places, keys


def parted_keys(words: np.ndarray, ends: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], total: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of parted_sides, one behind the other; place: where the longer run starts. Each of `turns` gives the keys of its own lengths.

    ends, starts: the words before which the longer run ends and with which it starts (of each: without a word between, and with one).
    """
    _, places, keys = parted_sides(words, np.concatenate([4 * np.asarray(x) + k for k, x in enumerate((*ends, *starts))]), total)
    row, k = np.nonzero(keys)
    row, k = row[k % turns == turn], k[k % turns == turn]
    return keys[row, k], _longer_starts(places[row], k, total)


def _longer_starts(places: np.ndarray, k: np.ndarray, total: int) -> np.ndarray:
    """Where the longer run of a place's key number k starts."""
    return places // 4 - np.where(places % 4 < 2, (total + 1) // 2 + k, 0)


@frugal
def _parted(total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (doc, text last): a document's text, then places as parted_sides takes them; what that gives of each, the keys as bytes."""
    now, words, places, out, n = None, None, [], [], 0

    def sides() -> None:
        nonlocal n
        if places and words is not None:
            context, at, keys = parted_sides(words, np.unique(np.concatenate(places)), total)
            out.append((context.view(np.int64), np.full(len(at), now, np.int64), at, keys))
            n += keys.size

    def batch() -> pa.RecordBatch:
        *rows, keys = (np.concatenate(z) for z in zip(*out))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * keys.shape[1]), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), raw.cast(pa.binary())], names=["context", "doc", "place", "keys"])

    for b in batches:
        doc, at = b.column(0).to_numpy(), b.column(2).fill_null(-1).to_numpy()
        asks = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        for row, counts, found in hashed_words(b.column(1), SPACED):
            ends, to = np.cumsum(counts), row + len(counts)
            starts = np.flatnonzero(np.concatenate([[True], doc[row + 1 : to] != doc[row : to - 1]])) + row
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), to]):
                if doc[s] != now:
                    sides()
                    if n >= BLOCK:
                        yield batch()
                        out, n = [], 0
                    now, words, places = doc[s], None if asks[s] else found[ends[s - row] - counts[s - row] : ends[s - row]].copy(), []
                if (own := asks[s:e]).any():
                    places.append(at[s:e][own])
    sides()
    if out:
        yield batch()


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(False, columns) of rows that come sorted by the first column, so that no group is parted; but a group of over GROUP rows comes in parts, (True, columns). Columns are numbers, or rows of numbers where they are bytes."""
    rest, parted = None, None  # the rows of the last group so far; the last group, if parts of it were given
    for b in batches:
        if not b.num_rows:
            continue
        cols = [_numbers(x) for x in b.columns]
        if rest is not None:
            cols = [np.concatenate(z) for z in zip(rest, cols)]
        key, last = cols[0], cols[0][-1]
        begins, goes_on = int(np.searchsorted(key, last)), 0
        if parted is not None and parted != last:
            if goes_on := int(np.searchsorted(key, parted, side="right")):
                yield True, [x[:goes_on] for x in cols]
            parted = None
        if goes_on < begins:
            yield False, [x[goes_on:begins] for x in cols]
        rest = [x[begins:] for x in cols]
        if parted is not None or len(rest[0]) > GROUP:
            yield True, rest
            rest, parted = [x[:0] for x in rest], last
    if rest is not None and len(rest[0]):
        yield False, rest


def _numbers(column: pa.Array) -> np.ndarray:
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(column), -1)


PLACES = "key long, doc long, at long, rep long, rep_at long"


@frugal
def _meet_parted(total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _parted come sorted by (context, doc, place). Holders of a key in other documents link to its first: (doc, at, rep, rep_at), at the shortest and the longest run that two places share. Of contexts with very many places (key, doc, at) are given instead."""
    for many, (context, doc, place, keys) in _in_groups(batches):
        if not many:  # a context that stands once links nothing
            same = np.concatenate([[False], context[1:] == context[:-1], [False]])
            alone = ~(same[1:] | same[:-1])
            doc, place, keys = doc[~alone], place[~alone], keys[~alone]
        row, k = np.nonzero(keys)
        order = np.argsort(keys[row, k], kind="stable")  # within a key rows stay in order
        row, k = row[order], k[order]
        key, of = keys[row, k], doc[row]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        again = ~new & np.concatenate([[False], of[1:] == of[:-1]])[: len(key)]  # of a document's places of a key the first counts
        at = _longer_starts(place[row], k, total)
        if many:
            key, of, at = (x[~again] for x in (key.view(np.int64), of, at))
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(at), none, none], names=["key", "doc", "at", "rep", "rep_at"])
            continue
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)
        keep = np.flatnonzero(~again & (of != of[first]))
        pair = row[keep] * len(doc) + row[first[keep]]
        order = np.lexsort((k[keep], pair))
        keep, pair = keep[order], pair[order]
        edge = np.concatenate([[True], pair[1:] != pair[:-1], [True]])
        keep = keep[(edge[1:] | edge[:-1])[: len(keep)]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keep), pa.int64()), *(pa.array(x) for x in (of[keep], at[keep], of[first[keep]], at[first[keep]]))], names=["key", "doc", "at", "rep", "rep_at"])


@frugal
def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (doc, text last): a document's text, then what is asked of it; answers with tokens as 32-bit numbers."""
    now, words, tokens = None, None, None
    for b in batches:
        out, doc = [], b.column(0).to_numpy()
        asks = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        link, side, start, end, shift = (b.column(k).fill_null(0).to_numpy() for k in range(2, 7))
        for row, counts, found in hashed_words(b.column(1), SPACED):
            ends = np.cumsum(counts)
            for k in range(row, row + len(counts)):
                if not asks[k]:
                    if doc[k] != now:
                        now, words, tokens = doc[k], found[ends[k - row] - counts[k - row] : ends[k - row]], None
                elif doc[k] == now:
                    if tokens is None:
                        tokens = (run_hashes(words, WIDTH) >> np.uint64(32)).astype("<u4")
                    lo = max(0, int(start[k]))
                    out.append((link[k], side[k], now, lo, shift[k], tokens[lo : max(lo, int(end[k]))].tobytes()))
            words = None if words is None else words.copy()
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["link", "side", "doc", "start", "shift", "tokens"])


def alike(a: np.ndarray, b: np.ndarray, least: int = 0) -> float:
    """Jaccard similarity of two sets of tokens. Passages shorter than `least` are filled up with tokens that the other doesn't have."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / max(1, len(x | y) + max(0, least - len(a)) + max(0, least - len(b)))


def common_blocks(a: np.ndarray, b: np.ndarray, least: int = 0) -> list[tuple[int, int, int]]:
    """Longest common blocks (a, b, n) as difflib's SequenceMatcher gives them; none if fewer than `least` tokens of a stand in b."""
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b, a, side, order) for side in ("left", "right"))
    many = hi - lo
    if np.count_nonzero(many) < least:
        return []
    if many.sum() > MATCHES:  # tokens that stand again and again
        return [(x.a, x.b, x.size) for x in SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks() if x.size]
    i = np.repeat(np.arange(len(a)), many)
    k = order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(i))]
    by = np.lexsort((i, i - k))
    i, k = i[by], k[by]
    edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (k[1:] != k[:-1] + 1), [True]]))
    runs = list(zip(i[edge[:-1]].tolist(), k[edge[:-1]].tolist(), np.diff(edge).tolist())) if len(i) else []
    found, todo = [], [(0, len(a), 0, len(b), runs)]
    while todo:  # the longest in a rectangle, of equal ones the first in a, then in b; then what lies before and behind it
        a0, a1, b0, b1, runs = todo.pop()
        inside, best = [], (0, 0, 0)
        for x, y, n in runs:
            if (skip := max(a0 - x, b0 - y, 0)) < n and (n := min(n, a1 - x, b1 - y) - skip) > 0:
                inside.append((x + skip, y + skip, n))
                best = min(best, (-n, x + skip, y + skip))
        if inside:
            n, x, y = -best[0], *best[1:]
            found.append((x, y, n))
            todo += [(a0, x, b0, y, inside), (x + n, a1, y + n, b1, inside)]
    out = []
    for x, y, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((x, y, n))
    return out


def _filled(start: int, end: int, least: int, size: int) -> tuple[int, int]:
    """A span of at least `least`, if size allows it: to the end first, then to the start."""
    end = min(size, max(end, start + least))
    return max(0, min(start, end - least)), end


def _merged(blocks: list[tuple[int, int, int]], jaccard: float) -> list[tuple[int, int, int, int]]:
    """Neighbouring blocks (a, b, n) as spans (a, a_end, b, b_end), joined while shared tokens make up the similarity."""
    spans: list[tuple[int, int, int, int, int]] = []
    for a, b, n in blocks:
        if spans:
            a0, a1, b0, b1, m = spans[-1]
            if a >= a1 and b >= b1 and (m + n) / (a + n - a0 + b + n - b0 - m - n) >= jaccard:
                spans[-1] = (a0, a + n, b0, b + n, m + n)
                continue
        spans.append((a, a + n, b, b + n, n))
    return [s[:4] for s in spans]


def verify(a: np.ndarray, a_at: int, b: np.ndarray, b_at: int, shift: int, least: int, jaccard: float) -> list[tuple[int, int, int, int, float]]:
    """Spans of tokens (a, a_end, b, b_end, similarity) of at least `least` tokens that are similar enough.

    a_at, b_at: positions of the first tokens; shift: a's position less b's where they were found to meet. Tokens are
    compared at that shift; if too few are the same in a row, by longest common blocks, which allow for words put in or
    left out. Where fewer than `least` tokens are the same in a row, but enough for passages of that length, the span
    goes on over tokens that differ.
    """
    lo, hi, enough = max(a_at, b_at + shift), min(a_at + len(a), b_at + len(b) + shift), shared_tokens(least, jaccard)
    found: list[tuple[int, int, int, int]] = []
    whole: list[tuple[int, int, int, int]] = []
    if hi > lo:
        same = a[lo - a_at : hi - a_at] == b[lo - shift - b_at : hi - shift - b_at]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        blocks = [(int(s) + lo - a_at, int(s) + lo - shift - b_at, int(e - s)) for s, e in edge.reshape(-1, 2)]
        found = _merged(blocks, jaccard)
        whole = [(x, x + n, y, y + n) for x, y, n in blocks if n >= enough]
    if not any(a1 - a0 >= enough for a0, a1, _, _ in found) and sum(a1 - a0 for a0, a1, _, _ in found) >= least // 4:
        # a span of `enough` needs so many tokens in its blocks
        found = _merged(common_blocks(a, b, shared_tokens(enough, jaccard)), jaccard)
    out = []
    for a0, a1, b0, b1 in found:
        if min(a1 - a0, b1 - b0) >= enough and (s := alike(a[a0:a1], b[b0:b1], least)) >= jaccard:
            out.append((a0, a1, b0, b1, s))
    # words that are the same count by themselves where the span they were joined to isn't similar enough
    for a0, a1, b0, b1 in whole:
        if not any(x[0] <= a0 and a1 <= x[1] for x in out):
            out.append((a0, a1, b0, b1, alike(a[a0:a1], b[b0:b1], least)))
    full = [(*_filled(a0, a1, least, len(a)), *_filled(b0, b1, least, len(b)), s) for a0, a1, b0, b1, s in out]
    return [(a0 + a_at, a1 + a_at, b0 + b_at, b1 + b_at, s) for a0, a1, b0, b1, s in full if s >= jaccard and min(a1 - a0, b1 - b0) >= least]


@frugal
def _verify(least: int, jaccard: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (link, side)."""
    before = None
    for batch in batches:
        out = []
        for link, side, doc, start, shift, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            if side == 0:
                before = (link, doc, start, tokens)
            elif before and before[0] == link:
                for x in verify(np.frombuffer(before[3], "<u4"), before[2], np.frombuffer(tokens, "<u4"), start, shift, least, jaccard):
                    out.append((before[1], x[0], x[1] + WIDTH - 1, doc, x[2], x[3] + WIDTH - 1, x[4]))
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "jaccard"])


SPANS = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, jaccard double"


def _whole_pairs(rows: DataFrame, held: DataFrame, core: int, min_words: int) -> DataFrame:
    """(doc, rep, shift, stretch, start, end): the runs of core words around held anchors that a document shares with the first that has them."""
    at, before, after = F.shiftright("packed", 28), F.shiftright("packed", 12).bitwiseAND(F.lit(4095)), F.col("packed").bitwiseAND(F.lit(4095))
    slack = min_words - core
    lo = at - F.least(before, F.lit(min_words - WIDTH))
    hi = at + F.least(after - (core - 1), F.lit(RUN - WIDTH + slack))  # a passage starts so far behind its anchor's run at most
    asked = held.select("doc", F.lit(None).cast("string").alias("text"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))  # what others link to is held in rows of its own
    texts = rows.select("doc", "text", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    keys = texts.unionByName(asked).repartition("doc").sortWithinPartitions("doc", F.col("lo").asc_nulls_first(), "text").mapInArrow(partial(_wholes, core, slack + 1, False, None), "key long, doc long, at long")
    met = keys.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_meet_whole, "doc long, at long, rep long, rep_at long")
    return met.select("doc", "rep", (F.col("at") - F.col("rep_at")).alias("shift"), F.floor(F.col("at") / STRETCH).alias("stretch"), (F.col("at") - slack).alias("start"), (F.col("at") + min_words).alias("end"))


def _pairs(rows: DataFrame, least: int, core: int, min_words: int, enough: int) -> tuple[DataFrame, DataFrame]:
    """(doc, rep, shift, start, end, link): stretches of tokens on which enough hash functions, or core words in a row, let two documents meet, doc over rep; and what was held."""
    dealt = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = rows.mapInArrow(partial(_windows, least, dealt * PARTS), ROWS)
    held = cut(windows.repartitionById(dealt, F.pmod("part", F.lit(dealt)).cast("int")).sortWithinPartitions("part").mapInArrow(_meet, MET), small=True)
    release(rows.sparkSession)  # the windows' shuffle is the largest here, and done with
    whole, slack = _whole_pairs(rows, held, core, min_words), min_words - core
    met = held.where("doc <> rep")
    later = F.col("doc") > F.col("rep")
    met = met.select(*(F.when(later, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("doc", "rep", "doc"), ("packed", "rep_packed", "packed"), ("rep", "doc", "rep"), ("rep_packed", "packed", "rep_packed"))))
    at = lambda p: F.shiftright(p, 28)
    before = lambda p: F.shiftright(p, 12).bitwiseAND(F.lit(4095))
    after = lambda p: F.col(p).bitwiseAND(F.lit(4095))
    near = (
        met.withColumn("shift", at("packed") - at("rep_packed")).withColumn("stretch", F.floor(at("packed") / STRETCH))
        .withColumn("start", at("packed") - F.least(before("packed"), before("rep_packed")) - slack).withColumn("end", at("packed") + F.least(after("packed"), after("rep_packed")) + 1 + slack)
        .withColumn("functions", F.call_function("shiftleft", F.lit(1), F.shiftright("packed", 24).bitwiseAND(F.lit(15)).cast("int")))
    )
    both = near.select("doc", "rep", "shift", "stretch", "start", "end", "functions").unionByName(whole.withColumn("functions", F.lit((1 << enough) - 1)))
    return cut(
        both.groupBy("doc", "rep", "shift", "stretch")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bit_or("functions").alias("functions"))
        .where((F.bit_count("functions") >= enough) & (F.col("end") - F.col("start") >= core + 2 * slack))
        .select("doc", "rep", "shift", "start", (F.col("end") - (WIDTH - 1)).alias("end"), F.xxhash64("doc", "rep", "shift", "stretch").alias("link")),
        small=True,
    ), held


def _unlinked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc, at, rep, rep_at, ...) of which neither place lies in a passage linked to the other document, nor both in passages linked to one place of a third."""
    sides = (F.struct(F.col("doc_id").alias("doc"), F.col("other_id").alias("rep"), F.col("start_word").alias("first"), F.col("end_word").alias("last")), F.struct(F.col("other_id").alias("doc"), F.col("doc_id").alias("rep"), F.col("other_start").alias("first"), F.col("other_end").alias("last")))
    spans = found.select(F.explode(F.array(*sides)).alias("x")).groupBy("x.doc", "x.rep").agg(F.collect_set(F.struct("x.first", "x.last")).alias("spans"))
    inside = F.coalesce(F.exists("spans", lambda s: (F.col("at") >= s.first) & (F.col("at") < s.last)), F.lit(False))
    rest = cut(pairs.join(spans, ["doc", "rep"], "left").where(~inside).drop("spans"), small=True)
    places = rest.select(F.explode(F.array(F.struct("doc", "at"), F.struct(F.col("rep").alias("doc"), F.col("rep_at").alias("at")))).alias("x")).select("x.doc", "x.at").distinct()
    down = found.select(F.col("doc_id").alias("doc"), "start_word", "end_word", F.col("other_id").alias("root"), "other_start")
    roots = cut(places.join(down, "doc").where("at >= start_word and at < end_word").select("doc", "at", "root", (F.col("other_start") + F.col("at") - F.col("start_word")).alias("root_at")).distinct(), small=True)
    other = roots.select(F.col("doc").alias("rep"), F.col("at").alias("rep_at"), "root", F.col("root_at").alias("other_at"))
    linked = rest.select("doc", "at", "rep", "rep_at").distinct().join(roots, ["doc", "at"]).join(other, ["rep", "rep_at", "root"]).where(F.abs(F.col("root_at") - F.col("other_at")) < MIN_WORDS).select("doc", "at", "rep", "rep_at").distinct()
    return rest.join(linked, ["doc", "at", "rep", "rep_at"], "left_anti")


RUNS = "key long, doc long, at long, before long, after long, behind long, ahead long, root long"


@frugal
def _open(half: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _open_sides gives, of RUNS sorted by key: (doc, at), the rest null. Runs that stand very often are given as they are."""

    def differ(new: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """For each row, whether every column has two values in its group."""
        starts, out = np.flatnonzero(new), True
        for x in columns:
            out = out & (np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts))
        return out[np.cumsum(new) - 1]

    for many, cols in _in_groups(batches):
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=RUNS.replace(" long", "").split(", "))
            continue
        key, doc, at, before, after, behind, ahead, root = cols
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ends, starts, group = differ(new, after), differ(new, before), np.cumsum(new)
        open_ = differ(new, doc, root) & (ends | starts)
        for side, fits, run, word in ((0, ends, behind, after), (2, starts, ahead, before)):
            here, runs = np.flatnonzero(open_ & fits), []
            if not len(here):
                continue
            runs = np.concatenate([run[here].view(np.uint64) >> np.uint64(32), run[here].view(np.uint64) & np.uint64(0xFFFFFFFF)])
            place = 4 * (at[here] + (half if side == 0 else 0)) + side
            here, place = np.concatenate([here, here])[runs != 0], np.concatenate([place, place + 1])[runs != 0]
            by = (group[here].astype(np.uint64) << np.uint64(32)) | runs[runs != 0]
            if not len(by):
                continue
            order = np.argsort(by)
            by, here, place = by[order], here[order], place[order]
            shared = differ(np.concatenate([[True], by[1:] != by[:-1]]), doc[here], root[here], word[here])
            none = pa.nulls(int(shared.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(doc[here][shared]), pa.array(place[shared]), *[none] * 5], names=RUNS.replace(" long", "").split(", "))


def _open_sides(runs: DataFrame, half: int) -> DataFrame:
    """(doc, text null, at) as _parted takes them: the sides of runs at which holders that aren't linked to one place go on with different words."""
    # nothing is open in runs whose holders are all linked to one place, nor at a side on which all go on with one word
    of_key = Window.partitionBy("key")
    differ = lambda c: F.min(c).over(of_key) != F.max(c).over(of_key)
    runs = runs.withColumns({"open": differ("doc") & differ("root"), "ends": differ("after"), "starts": differ("before")}).where("open and (ends or starts)").drop("open")
    # the run and what lies beyond a changed word must both be held by others, with another word beside the run
    side = lambda at, k, run, there, word: F.when(F.col(there) & (run != 0), F.struct(F.xxhash64("key", run, F.lit(k // 2)).alias("key"), (4 * at + k).alias("place"), F.col(word).alias("word")))
    near, off = lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    ends, starts = F.col("at") + half, F.col("at")
    sides = F.array_compact(F.array(side(ends, 0, near("behind"), "ends", "after"), side(ends, 1, off("behind"), "ends", "after"), side(starts, 2, near("ahead"), "starts", "before"), side(starts, 3, off("ahead"), "starts", "before")))
    shared = runs.select("doc", "root", F.explode(sides).alias("x")).select("doc", "root", "x.*").withColumn("open", differ("doc") & differ("root") & differ("word")).where("open")
    return shared.select("doc", F.lit(None).cast("string").alias("text"), F.col("place").alias("at")).distinct()


def _parted_pairs(rows: DataFrame, held: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Pairs like those of _pairs, where the first holder of a signature isn't similar to another one: two of its holders may still be.

    Around all places of such a signature, runs of half of `total` words are looked for that two documents hold; where they
    end or start with different words beside them, keys are two runs of `total` words around a changed word, and their
    holders link to the first. These are similar by that alone, so the first stands for all. What is linked there already
    isn't given again.
    """
    at, before, after = F.shiftright("packed", 28), F.shiftright("packed", 12).bitwiseAND(F.lit(4095)), F.col("packed").bitwiseAND(F.lit(4095))
    met = held.where("doc <> rep").select("key", "doc", at.alias("at"), "rep", F.shiftright("rep_packed", 28).alias("rep_at"))
    open_keys = cut(_unlinked(met, found).select("key").distinct(), small=True)
    places = held.join(open_keys, "key", "left_semi").select("doc", "packed")
    release(rows.sparkSession)
    half, null = (total + 1) // 2, F.lit(None).cast("long")
    lo, hi = at - F.least(before, F.lit(total + 1 - RUN)), at + F.least(after + 1, F.lit(total + 1)) - half
    asked = cut(places.select("doc", F.lit(None).cast("string").alias("text"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi").distinct(), small=True)
    texts = rows.join(asked.select("doc").distinct(), "doc", "left_semi").select("doc", "text", null.alias("lo"), null.alias("hi"), null.alias("root"), null.alias("by"))
    asked = asked.select("*", null.alias("root"), null.alias("by"))
    down = found.select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("text"), F.col("start_word").alias("lo"), F.col("end_word").alias("hi"), F.col("other_id").alias("root"), (F.col("other_start") - F.col("start_word")).alias("by"))
    ranges = texts.unionByName(asked).unionByName(down).repartition("doc").sortWithinPartitions("doc", F.col("lo").asc_nulls_first(), "text")
    sides = None
    for turn in range(ROUNDS):
        runs = ranges.mapInArrow(partial(_wholes, half, 1, True, turn), RUNS)
        one = cut(runs.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_open, half), RUNS), small=True)
        sides = one if sides is None else sides.unionByName(one)
        release(rows.sparkSession)
    shared = sides.where("key is null").select("doc", F.lit(None).cast("string").alias("text"), "at").distinct()
    if not (often := sides.where("key is not null")).isEmpty():
        shared = shared.unionByName(_open_sides(often, half)).distinct()
    shared = cut(shared, small=True)
    texts = rows.join(shared.select("doc").distinct(), "doc", "left_semi").select("doc", "text", null.alias("at"))
    ranges = texts.unionByName(shared).repartition("doc").sortWithinPartitions("doc", F.col("at").asc_nulls_first(), "text")
    sides = ranges.mapInArrow(partial(_parted, total), "context long, doc long, place long, keys binary")
    met = cut(sides.repartition("context").sortWithinPartitions("context", "doc", "place").mapInArrow(partial(_meet_parted, total), PLACES).distinct(), small=True)
    release(rows.sparkSession)
    pairs, often = met.where("key is null").drop("key"), met.where("key is not null").select("key", "doc", "at")
    for turn in range(0 if often.isEmpty() else ROUNDS):
        keys = often.where(F.pmod("key", F.lit(ROUNDS)) == turn)
        pairs = pairs.unionByName(cut(keys.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_meet_whole, "doc long, at long, rep long, rep_at long").distinct(), small=True))
        release(rows.sparkSession)
    pairs = _unlinked(pairs.distinct(), found)
    pairs = pairs.withColumn("shift", F.col("at") - F.col("rep_at")).groupBy("doc", "rep", "shift", F.floor(F.col("at") / STRETCH).alias("stretch")).agg(F.min("at").alias("start"), F.max("at").alias("end"))
    return cut(pairs.select("doc", "rep", "shift", (F.col("start") - total).alias("start"), (F.col("end") + total + 1).alias("end"), F.xxhash64("doc", "rep", "shift", "stretch", F.lit(1)).alias("link")), small=True)


def links(docs: DataFrame, min_words: int = MIN_WORDS, jaccard: float = JACCARD, enough: int = ENOUGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, jaccard): passages that stand in two documents.

    Words are parted by ASCII white space, A-Z lower-cased; spans are words from 0, end excluded. A passage has at least
    min_words words, and the similarity of its 5-word shingles to the other passage's is at least jaccard. other_id is
    always less than doc_id: the first document that shares a signature or a run stands for the rest, so a passage that
    many documents share gives about one row for each of them, not one for each pair. A long passage may come in several
    rows that overlap. Of what a document holds again and again the first place is compared; repeats within one document
    aren't reported. Rows with a null id and null, empty and short texts give nothing; rows that repeat an id are taken
    for the same document, of which the first text is compared (drop_repeats tells such rows apart). An empty table gives
    an empty result. Other columns aren't read.
    """
    least = max(1, min_words - WIDTH + 1)
    if least < RUN:
        raise ValueError(f"min_words must be at least {RUN + WIDTH - 1}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    pairs, held = _pairs(rows, least, shared_tokens(least, jaccard) + WIDTH - 1, min_words, enough)
    release(docs.sparkSession)  # the shuffles of the texts and of whole passages are done with
    found = cut(_verified(rows, pairs, least, jaccard), small=True)
    release(docs.sparkSession)
    rest = _parted_pairs(rows, held, found, parted_words(least, jaccard))
    return found.unionByName(_verified(rows, rest, least, jaccard))


def _verified(rows: DataFrame, pairs: DataFrame, least: int, jaccard: float) -> DataFrame:
    """SPANS of the pairs that are similar enough."""
    asked = pairs.select(F.explode(F.array(
        F.struct(F.col("doc"), "link", F.lit(0).alias("side"), "start", "end", "shift"),
        F.struct(F.col("rep").alias("doc"), "link", F.lit(1).alias("side"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), "shift"),
    )).alias("x")).select("x.doc", F.lit(None).cast("string").alias("text"), "x.link", "x.side", "x.start", "x.end", "x.shift")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("link", "long"), ("side", "int"), ("start", "long"), ("end", "long"), ("shift", "long"))]
    ids = cut(asked.select("doc").distinct(), small=True)
    if ids.count() <= LISTED:
        rows = rows.join(F.broadcast(ids), "doc", "left_semi")
    texts, asked = _dealt(rows.select("doc", "text", *nothing), asked)
    parts = texts.unionByName(asked).repartition("doc", "deal").sortWithinPartitions("doc", "deal", F.col("link").asc_nulls_first(), "text").drop("deal").mapInArrow(_slices, "link long, side int, doc long, start long, shift long, tokens binary")
    return parts.repartition("link").sortWithinPartitions("link", "side").mapInArrow(partial(_verify, least, jaccard), SPANS)


def _dealt(texts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a column deal: what is asked of one document is dealt out, ASKED to a deal, and its text goes to each."""
    many = cut(asked.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > ASKED).select("doc", F.ceil(F.col("n") / ASKED).cast("int").alias("deals")), small=True)
    n = many.count()
    if not n:
        return texts.withColumn("deal", F.lit(0)), asked.withColumn("deal", F.lit(0))
    many, deals = F.broadcast(many) if n <= BROADCAST_ROWS else many, F.coalesce("deals", F.lit(1))
    texts = texts.join(many, "doc", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return texts, asked.join(many, "doc", "left").withColumn("deal", F.pmod(F.xxhash64("link"), deals).cast("int")).drop("deals")


def passages(docs: DataFrame, **options) -> DataFrame:
    """The rows of links() from both sides: every document that shares a passage has a row under doc_id. Takes what links() takes."""
    one = cut(links(docs, **options), small=True)
    back = one.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"), F.col("doc_id").alias("other_id"), F.col("start_word").alias("other_start"), F.col("end_word").alias("other_end"), "jaccard")
    return one.unionByName(back)


def without(text: str, spans: list[tuple[int, int]], again: int = 0) -> str:
    """The text without the words of the spans and the white space after them; with `again`, also without every run of so many words that a span holds."""
    raw, starts, at = text.encode("utf-8", "surrogatepass"), [], 0
    for w in raw.split():
        at = raw.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(raw))
    n = len(starts) - 1
    spans = [(min(s, n), min(e, n)) for s, e in spans]
    if again and n > again:
        run = run_hashes(text_hashes(text, SPACED), again)
        inside = np.concatenate([np.arange(s, max(s, e - again + 1)) for s, e in spans])
        spans += [(k, k + again) for k in np.flatnonzero(np.isin(run, run[inside])).tolist()]
    out, at = [], 0
    for s, e in sorted(spans):
        if starts[s] > at:
            out.append(raw[at : starts[s]])
        at = max(at, starts[e])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


@frugal
def _cut_out(names: list[str], text_col: str, again: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column has the spans; the others are named anew by `names`."""
    for b in batches:
        spans, cols = b.column(b.num_columns - 1).to_pylist(), list(b.columns[:-1])
        t = names.index(text_col)
        texts = [x if x is None or not s else without(x, [(y["start_word"], y["end_word"]) for y in s], again) for x, s in zip(cols[t].to_pylist(), spans)]
        cols[t] = pa.array(texts, cols[t].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            cols[k] = pa.array([n if not s or x is None else len(x) for n, s, x in zip(cols[k].to_pylist(), spans, texts)], cols[k].type)
        whole = pa.array([not s or bool(x and x.strip()) for s, x in zip(spans, texts)], pa.bool_())
        yield pa.RecordBatch.from_arrays(cols, names=names).filter(whole)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **options) -> DataFrame:
    """docs with every passage taken out that stands in a document of a lower id as well, wherever it stands; a column n_chars follows the text.

    The document of the lowest id keeps a passage. A document of which no word is left goes. Rows without such a passage
    stay as they are, and so do rows with a null id or text. Rows that repeat an id with another text are documents of
    their own, in an order by their texts; rows that repeat id and text are one document, and all are cut alike. Ids of
    2^39 and more, or as far below zero, come last and are ordered by a hash. Columns may have any names; an empty table gives an empty one.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}")
    near = F.call_function("shiftleft", own, F.lit(TEXT_BITS)).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << TEXT_BITS) - 1)))
    rows = rows.withColumn("key", F.when(own.isNotNull(), F.when(own.between(-MOST_ID + 1, MOST_ID - 1), near).otherwise(F.xxhash64(own, text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))))
    found = links(rows.select("key", text.alias("text")), min_words=min_words, id_col="key", text_col="text", **options)
    spans = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    out = rows.join(spans, "key", "left").select(*rows.columns[:-1], "spans")
    return out.mapInArrow(partial(_cut_out, names, text_col, min_words), docs.schema)
