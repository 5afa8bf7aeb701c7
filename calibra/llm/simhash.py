"""SimHash fingerprints, and groups of fingerprints within a Hamming radius, found through BK-trees over shards.

A shard is the set of distinct fingerprints that agree in two of four 16-bit blocks: two fingerprints that differ in
at most two bits agree in at least two blocks, so every link lies within a shard. A shard of more than NODES
fingerprints is parted in the same way by the other 32 bits: those that agree in two of their four bytes as well make a
shard, which 16 bits bound to 65,536 fingerprints. What is still larger than NODES is dealt into pieces of about that
size, 32 at most. A BK-tree is built over each piece and sent to each slice of the same shard's fingerprints; so a tree
that is sent has a bounded size, no task holds more than a tree and a slice, and rows grow as the fingerprints do.
Within a tree the children are keyed by their distance to the parent, and a search follows only edges within
the radius of its own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import cut, drop_keys, frugal, shingle_spans, space_words
from calibra.llm.graph import components

NODES = 2048
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half of the XXH64 of the text's shingles, repeats included. 0 without words."""
    joined, starts, ends = shingle_spans(space_words(text), width)
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, CHUNK):
        spans = map(slice, starts[k : k + CHUNK], ends[k : k + CHUNK])
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.dtype("<u8"), min(CHUNK, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@frugal
def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((_signed(fingerprint(t.as_py(), width)) for t in b.column(1)), pa.int64())], names=["doc_id", "fp"])


class BKTree:
    """Fingerprints keyed below their parent by the Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            todo += [c for e, c in self.children[k].items() if d - radius <= e <= d + radius]
        return found

    def add(self, value: int) -> int:
        """The node's number; an equal value has one node."""
        k = 0
        while self.values:
            d = (self.values[k] ^ value).bit_count()
            if not d:
                return k
            if d not in self.children[k]:
                self.children[k][d] = len(self.values)
                break
            k = self.children[k][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1


def shard_links(tree: list[tuple[int, int]], queries: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect whatever lies within the radius, as few as connect it.

    tree, queries: (fingerprint, id). Without queries the tree's own values are searched.
    """
    bk, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(x: int, y: int) -> None:
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))

    ids: list[int] = []
    for value, i in tree:
        if queries is None:
            for k in bk.within(value, radius):
                link(i, ids[k])
        if (k := bk.add(value)) == len(ids):
            ids.append(i)
        else:
            link(i, ids[k])
    for value, i in queries or ():
        for k in bk.within(value, radius):
            link(i, ids[k])
    return out


@frugal
def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (combo, block, part, a, b, own); those with own = a are the tree, the others the slice to search."""
    now, tree, queries = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if now and (found := shard_links(tree, None if now[3] == now[4] else queries, radius)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for *group, own, fp, i in zip(*(c.to_pylist() for c in batch.columns)):
            if group != now:
                yield from done()
                now, tree, queries = group, [], []
            (tree if own == group[3] else queries).append((fp & 0xFFFFFFFFFFFFFFFF, i))
    yield from done()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. One row for each row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_fingerprints, width), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint: 16 hex digits. component_id: the least doc_id that can be reached over fingerprints which differ in
    at most radius bits (0 to 2). Null and empty texts have fingerprint zero and link like any other. Repeated rows
    stay, each with its component. A row with a null doc_id keeps it null; it never names a component, so a component
    of such rows alone has a null component_id. An empty table gives an empty one. Other columns aren't read.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree for sure only up to a radius of 2")
    fps = cut(fingerprints(docs, width, id_col, text_col), small=True)
    firsts = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), small=True)
    pairs = list(combinations(range(4), 2))
    bits = lambda k, n: F.shiftrightunsigned("fp", n * k).bitwiseAND(F.lit((1 << n) - 1))
    keys = F.array(*[F.struct(F.lit(n).alias("combo"), (bits(i, 16) * 65536 + bits(j, 16)).alias("block")) for n, (i, j) in enumerate(pairs)])
    keyed = firsts.select("fp", "id", F.explode(keys).alias("k")).select("fp", "id", "k.combo", "k.block")
    sizes = keyed.groupBy("combo", "block").agg(F.count("*").alias("n")).where("n > 1")
    sharded = keyed.join(sizes, ["combo", "block"])
    # the four bytes that a shard doesn't fix, by its number; two of them are equal wherever two bits differ at most
    free = [[2 * k + b for k in range(4) if k not in pair for b in (0, 1)] for pair in pairs]
    parts = F.array(*[F.array(*[F.lit(n * 65536) + bits(own[i], 8) * 256 + bits(own[j], 8) for n, (i, j) in enumerate(pairs)]) for own in free])
    large = sharded.where(F.col("n") > NODES).withColumn("part", F.explode(F.get(parts, F.col("combo")))).drop("n")
    counted = large.groupBy("combo", "block", "part").agg(F.count("*").alias("n")).where("n > 1")
    sharded = sharded.where(F.col("n") <= NODES).withColumn("part", F.lit(-1).cast("long")).unionByName(large.join(counted, ["combo", "block", "part"]))
    dealt = sharded.withColumn("pieces", F.ceil(F.col("n") / NODES).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    dealt = dealt.select("combo", "block", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "id")
    group = ["combo", "block", "part", "a", "b"]
    links = dealt.repartition(*group).sortWithinPartitions(*group, "own", "fp").mapInArrow(partial(_links, radius), "a long, b long")
    roots = components(links)
    firsts = firsts.join(roots, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(firsts, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component: one document of each group of near-duplicates, with all its columns, whatever their names.

    Rows that repeat the kept id all stay; rows with a null id have no group they could name, and stay. An empty table
    gives an empty one.
    """
    out = near_duplicates(docs, radius, width, id_col, text_col)
    return drop_keys(docs, F.col(id_col).cast("long"), out.where("component_id <> doc_id").select("doc_id"))
