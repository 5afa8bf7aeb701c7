"""What the operators of this subpackage share: tables, lineage cuts, byte-level word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache, wraps
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FACTOR = 0x9E3779B97F4A7C15
#: Maps A-Z to a-z and leaves every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named a local session gets a folder of its own, and a cluster an error."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="calibra-checkpoint-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/calibra-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


#: How many shuffle partitions' worth of a table that is small beside the documents (ids, links, counts) go to one file of a checkpoint.
SMALL_SHARE = 16


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there, so that a lost executor costs no recomputation of what stands before.

    small: a table with far fewer bytes than the documents it comes from; it is dealt anew, to fewer files.
    """
    checkpoint_dir(df.sparkSession)
    if small:
        df = df.repartition(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SMALL_SHARE))
    return df.checkpoint(eager=True)


#: Keys of a list that is sent to every task.
BROADCAST_ROWS = 500_000


def drop_keys(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs but those whose key stands in gone's only column; rows with a null key stay.

    A list of up to BROADCAST_ROWS keys goes to every task, and docs needn't be shuffled; a longer one is joined.
    """
    gone = cut(gone.toDF("gone").where("gone is not null").distinct(), small=True)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    names = docs.columns
    rows = docs.withColumn(own := f"key_{uuid.uuid4().hex}", key)
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))), own)
    return rows.join(gone, F.col(own) == F.col("gone"), "left_anti").drop(own).toDF(*names)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage.

    Plans go with one round and their shuffles with the next; Spark's cleaner works on its own thread, between them.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, \\t, \\n, \\v, \\f, \\r), A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingle_spans(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by single spaces, and the start and end in it of each run of width words. Fewer words, but at least one, make one run."""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(width, len(words))
    return joined, starts[: len(words) - width + 1] if words else [], [e - 1 for e in ends[width - 1 :]] if words else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over a whole array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width neighbours in an array of word hashes; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, part, size, factor = None, 0, h, 1, _FACTOR
    while True:  # part: runs of size neighbours, doubled; those that add up to width are put one behind the other
        if width & size:
            out = part[:n] if out is None else out * np.uint64(factor) + part[have : have + n]
            have += size
        if have == width:
            return mix(out)
        part = part[: len(part) - size] * np.uint64(factor) + part[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


class Recent(dict):
    """make(key) by key, for the keys asked for lately: two generations of at most `limit` keys. Longer keys than `longest` aren't kept, so its bytes are bounded too."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


_kept: dict[Hashable, object] = {}


def kept(key: tuple, make: Callable):
    """What this worker keeps from task to task, made by make(); one thing, under a key that begins with the name of the module that keeps it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


@lru_cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def frugal(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, a function over a task's batches, that leaves no memory behind: Spark goes on using its workers for other stages.

    What another module keeps in this worker goes before the task, and what the task has freed goes back to the system after it.
    """

    @wraps(f)
    def run(*args):
        if any(key[0] != f.__module__ for key in _kept):
            _kept.clear()
        try:
            yield from f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


#: A number for each byte, 0 where words part: of words between ASCII white space, of the same with A-Z as a-z, and of words of [0-9a-z] and non-ASCII characters.
CASED = np.array([xxhash.xxh64_intdigest(bytes([c])) | 1 for c in range(256)], np.uint64)
CASED[[9, 10, 11, 12, 13, 32]] = 0
SPACED = CASED.copy()
SPACED[65:91] = SPACED[97:123]
SPELT = SPACED.copy()
SPELT[[c for c in range(128) if not chr(c).isalnum()]] = 0
#: Bytes of text whose words are hashed at a time.
CHUNK_BYTES = 1 << 18


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _FACTOR modulo 2^64, and of its inverse."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def hash_words(data: np.ndarray, numbers: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the bytes, as a polynomial of its bytes' numbers. A word also starts at each of `breaks`."""
    n = len(data)
    value = numbers[data]
    inside = value != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < n)]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(max(n, 2 * CHUNK_BYTES))
    value *= up[:n]
    total = np.cumsum(value)
    return mix((total[end] - total[start] + value[start]) * down[start]), start, end + 1
