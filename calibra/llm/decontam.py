"""Benchmark decontamination: short test items are searched inside long documents by MinHash containment.

Items are partitioned by their number of distinct shingles. The sketch of an item in the partition of sizes up to u is
its bottom-k MinHash, the k smallest hashes of its shingles, with k one more than the shingles that u may miss at the
threshold: a document that holds the demanded share of an item can't miss k of its shingles, so it holds one of the
sketch, and the search has no false negative. The sketches are a table. Documents are read once: a bitmap of fixed size
that holds the sketches' hashes tells which of a document's shingles may be in one, and these alone are joined to the
sketches. A document asks only the partitions whose smallest item it is large enough to hold. Each candidate is verified
by the exact containment of the item's shingles, as words, in the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import SPELT, cut, drop_keys, frugal, run_hashes
from calibra.llm.licenses import words
from calibra.llm.wordtable import hashed_words, text_hashes

WIDTH = 5
CONTAINMENT = 0.8
#: Bits of the bitmap that is broadcast, 8 MB. A benchmark of many millions of shingles lets more of a document's shingles pass to the join, and no result changes.
BITS = 1 << 26


def shingle_set(ws: list[bytes], width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """Distinct runs of width words; of all words if there are fewer; none without words."""
    width = min(width, len(ws))
    return set(zip(*(ws[k:] for k in range(width)))) if width else set()


def need(n: int, containment: float) -> int:
    """How many of n shingles make the containment."""
    return max(1, math.ceil(containment * n - 1e-9))


def sketch(n: int, containment: float) -> int:
    """k of the bottom-k sketch in the partition of items with n shingles, sizes from a power of two to below the next."""
    most = (1 << n.bit_length()) - 1
    return most - need(most, containment) + 1


@frugal
def _sketches(width: int, containment: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, width, least, key): the item's sketch, one row for each hash; least: shingles that the partition asks of a document."""
    for b in batches:
        out = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if h := text_hashes(text, SPELT).tolist():
                w = min(width, len(h))
                keys, n = np.unique(run_hashes(np.array(h, np.uint64), w)), len(shingle_set(words(text), width))
                least = need(1 << (n.bit_length() - 1), containment)
                out += [(item, w, least, k) for k in keys[: sketch(n, containment)].view(np.int64).tolist()]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["item", "width", "least", "key"])


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit for each slot of the keys' lowest bits; at most bits / 64 rows are gathered, whatever the number of keys."""
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.shiftright(slot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy()
    return out.view(np.uint8)


@frugal
def _hits(bitmap, widths: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text, n_words, width, keys) of the documents with shingles that pass the bitmap; row numbers them."""
    have, at = bitmap.value, TaskContext.get().partitionId() << 33
    last = np.uint64(len(have) * 8 - 1)
    for b in batches:
        found = []  # (place in the batch, words, width, keys)
        for first, counts, h in hashed_words(b.column(1), SPELT):
            doc, left = np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
            for w in widths:
                runs = run_hashes(h, w)
                slot = (runs & last).astype(np.int64)
                hit = np.flatnonzero((have[slot >> 3] >> (slot & 7) & 1).astype(bool) & (left[: len(runs)] >= w))
                for d in np.unique(doc[hit]).tolist():
                    found.append((first + d, int(counts[d]), w, np.unique(runs[hit[doc[hit] == d]]).view(np.int64)))
        places = pa.array([x[0] for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([at + x[0] for x in found], pa.int64()), b.column(0).take(places), b.column(1).take(places), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.list_(pa.int64()))],
            names=["row", "doc_id", "text", "n_words", "width", "keys"],
        )
        at += b.num_rows


@frugal
def _contained(width: int, containment: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (row, text first): a document's text, then the items that it may contain."""
    now, sets, own = (None, None), {}, []
    for b in batches:
        out = []
        for row, doc, text, item_id, item in zip(*(c.to_pylist() for c in b.columns)):
            if item is None:
                now, own, sets = (row, doc), words(text), {}
            elif row == now[0]:
                ws = words(item)
                w = min(width, len(ws))
                if w not in sets:
                    sets[w] = shingle_set(own, w) if len(own) >= w else set()
                asked = shingle_set(ws, width)
                n = len(asked & sets[w])
                if n >= need(len(asked), containment):
                    out.append((*now, item_id, n, len(asked)))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "doc_id", "item_id", "found", "shingles"])


def _found(docs: DataFrame, benchmark: DataFrame, containment: float, width: int, bits: int) -> DataFrame:
    """(row, doc_id, item_id, found, shingles) for docs (doc_id, text)."""
    spark = docs.sparkSession
    number = F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct().select(number, "item_id", "text")
    sketches = cut(items.select("item", "text").mapInArrow(partial(_sketches, width, containment), "item long, width int, least long, key long"), small=True)
    widths = sorted(r.width for r in sketches.select("width").distinct().collect())
    sent = spark.sparkContext.broadcast(_bitmap(sketches, bits))
    hits = cut(docs.mapInArrow(partial(_hits, sent, widths), "row long, doc_id long, text string, n_words long, width int, keys array<long>"), small=True)
    asked = hits.select("row", "n_words", "width", F.explode("keys").alias("key")).join(sketches, ["width", "key"])
    pairs = asked.where(F.col("n_words") - F.col("width") + 1 >= F.col("least")).select("row", "item").distinct()
    asks = pairs.join(items, "item").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "item_id", F.col("text").alias("asked"))
    texts = hits.select("row", "doc_id", "text").join(pairs.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("asked"))
    rows = texts.unionByName(asks).repartition("row").sortWithinPartitions("row", F.col("asked").asc_nulls_first())
    return rows.mapInArrow(partial(_contained, width, containment), "row long, doc_id long, item_id long, found long, shingles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, found, shingles, containment): one row for each row of docs and item of which it holds the demanded share.

    Words are those of licenses.words: [0-9a-z] and non-ASCII characters, A-Z lower-cased. Items with fewer words than
    the width are one shingle, searched as a run of that many words; items without words and null texts match nothing.
    A repeated item (same id and text) counts once; items with one id and different texts give a row each. Null ids are
    kept as they are. Empty tables give an empty result. Other columns of either table aren't read.

    All documents, whole, are searched for all items in one pass; items stay in a table, and what is broadcast is a
    bitmap of `bits` bits (a power of two), however many items there are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(rows, benchmark, containment, width, bits).select("doc_id", "item_id", "found", "shingles", (F.col("found") / F.col("shingles")).alias("containment"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item (see contaminated), with all their columns, whatever their names.

    Rows are told apart by the hash of their text: repeated texts go or stay alike, null texts stay, ids aren't read. An
    empty table gives an empty one.
    """
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    return drop_keys(docs, key, _found(rows, benchmark, containment, width, bits).select("doc_id"))
