"""Token ids in Parquet: lists of ids, dictionary or delta encoded, in small row groups and pages with page indexes.

A folder of token files holds (doc_id, shard, shard_start, n_tokens, ids) in ascending order of doc_id over its files;
the other columns can be read, and rows chosen by the statistics of row groups and pages, without touching the ids.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import CASED, Recent, frugal, kept
from calibra.llm.wordtable import WordTable, by_text, chunks

END_ID = 2
#: Letters of words kept by a worker, in each of two generations.
KEPT_LETTERS = 200_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 64 << 10, 1000
#: Latin letters up to U+017E whose lower case is one letter and that no normalisation changes, and ASCII marks that neither start a contraction nor a special token.
LETTERS = frozenset(map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0x130), *range(0x132, 0x149), *range(0x14A, 0x17F)))) - {"×", "÷"}
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
#: The steps before the merges of a tokenizer that takes words one by one. Fixed values.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def _byte_letters() -> dict[int, int]:
    """Byte -> the character that byte-level BPE writes for it: itself if printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


def _numbers(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordEncoder:
    """For a tokenizer that drops white space and merges nothing over it: a text's ids are those of its words in turn.

    Words between ASCII white space are kept in a table, and the letters of the words used lately in lower case: most
    new words are known letters with other marks behind them. Both are bounded.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come here once; to keep them there as well takes a third of the time
        self.runs = Recent(self._run, KEPT_LETTERS)
        self.words = WordTable(self._word)

    def _run(self, run: bytes) -> bytes:
        return _numbers([t.id for t in self.model.tokenize(run.decode() if run.isascii() else run.decode("latin-1").translate(self.letters))])

    def _word(self, raw: bytes) -> tuple[bytes, bool]:
        letters = raw.rstrip(MARKS)
        if letters.isalpha():
            known = letters.lower()
        elif letters and LETTERS.issuperset(word := letters.decode("utf-8", "surrogatepass")):
            known = word.lower().encode()
        else:
            return _numbers(self.tokenizer.encode(raw.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids), True
        return (self.runs[known] + self.runs[marks] if (marks := raw[len(letters) :]) else self.runs[known]), True

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts, one behind the other; how many each text has), until all texts have come."""
        rest: list[np.ndarray] = []
        for c in chunks(texts, CASED):
            ids, sizes = self.words.look(c)
            rest.append(ids)
            if not c.more:
                yield (rest[0], by_text(c, sizes)) if len(rest) == 1 else (np.concatenate(rest), np.array([sum(map(len, rest))]))
                rest = []


class TextEncoder:
    """The same for any other tokenizer: whole texts, by the library."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t in texts.to_pylist():
            ids = np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32)
            yield ids, np.array([len(ids)])


def encoder(path: str) -> WordEncoder | TextEncoder:
    return kept((__name__, path), partial(_encoder, path))


def _encoder(path: str) -> WordEncoder | TextEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    made = json.loads(tokenizer.to_str())
    by_words = all(made[k] == v for k, v in WORD_STEPS.items()) and made["model"]["type"] == "BPE" and not any(made.get(k) for k in ("truncation", "padding")) and all(x["special"] for x in made["added_tokens"])
    return WordEncoder(tokenizer) if by_words and not any(made["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")) else TextEncoder(tokenizer)


@frugal
def _encode(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shard, which is the number of the partition, and each document's place in it."""
    encode, at, shard = encoder(path).encode, 0, TaskContext.get().partitionId()
    for b in batches:
        row = 0
        for ids, n in encode(b.column(1)):
            to, ends = row + len(n), np.cumsum(n + 1)
            out = np.full(int(ends[-1]), end_id, np.uint32)
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            offsets = np.concatenate([[0], ends])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(n)), pa.array(np.full(len(n), shard), pa.int32()), pa.array(at + offsets[:-1]), pa.array(n + 1), lists], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
            at, row = at + len(out), to


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row's whole text and writes token files to path, which must not exist.

    tokenizer: file of a tokenizer, to be found on every executor; one that takes words one by one (WORD_STEPS) is asked
    for each word, any other for whole texts. encoding: dictionary or delta,
    of the ids; numbers of documents are always delta encoded. Rows are dealt by ranges of doc_id and sorted by doc_id,
    then text, so the files' order is that of doc_id; nulls come first. Null and empty texts hold the end id alone.
    Repeated rows are written again; an empty table makes an empty folder. Other columns aren't read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(partial(_encode, tokenizer, end_id), "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower()}
    out.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_start, n_tokens, ids) of the token files; choose columns and rows before reading on."""
    return spark.read.parquet(path)


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with a column start. Adds up the totals of the shards of files: one row for each shard, whatever the number of documents."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def places(files: DataFrame) -> DataFrame:
    """(doc_id, shard, shard_start, start): the number of ids that stand before each document in the whole folder."""
    return _placed(files.select("doc_id", "shard", "shard_start"), files)


@frugal
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.schema.get_field_index("ids"))
        raw, at = memoryview(lists.values.to_numpy()).cast("B"), lists.offsets.to_pylist()
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "shard", "shard_start", "n_tokens")), pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at, at[1:])], pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of each document's ids as little-endian 32-bit numbers."""
    sums = files.select("doc_id", "shard", "shard_start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return _placed(sums, files).select("doc_id", "start", "n_tokens", "ids_crc32")
