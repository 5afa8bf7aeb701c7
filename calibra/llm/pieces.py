"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words that no piece spans. Words are counted over the whole corpus; for the dictionary's words the
substrings up to the longest piece are exploded and equi-joined to the piece table, which gives the lattice's edges;
edges are grouped by word, and a higher-order aggregate folds each word's lattice into its pieces. The dictionary has a
documented bound and is broadcast; a word beyond it is folded by the same merges or the same Viterbi where it occurs,
many words of a BPE model at a time (see merges.py).

The fold depends on the model's kind. Of a unigram model it is Viterbi: the path with the greatest sum of scores. A BPE
model's scores order merges and mean nothing in a sum, so there the fold joins two neighbouring edges into the edge of
the best score that spans both (the leftmost of equals) until none does; this alone gives the library's ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import CASED, Recent, cut, frugal, kept, mix
from calibra.llm.merges import Merges
from calibra.llm.wordtable import Chunk, WordTable, by_text, chunks

SPACE = "▁"
#: Words of the broadcast dictionary, and the longest of them; also the words kept by a worker in each of two generations.
DICTIONARY_WORDS, DICTIONARY_LENGTH, KEPT_WORDS = 200_000, 48, 200_000
#: So many words are faster folded together than one by one.
TOGETHER = 128
PART = re.compile(f"{SPACE}+[^{SPACE}]*")
PLAIN = re.compile(rf"({SPACE}[^\W\d_]+)([^\w{SPACE}\n]*)")
LINE_PART = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class Pieces(NamedTuple):
    """A model: id and score of each piece that text can match; bytes of every id for decoding; ids of the 256 bytes, if it falls back to them."""

    unigram: bool
    ids: dict[str, int]
    scores: dict[str, float]
    raw: list[bytes]
    byte_ids: list[int]
    unknown: int
    pairs: frozenset[str]
    longest: int
    parts_lines: bool = True

    def cut(self, part: str) -> list[str]:
        """Words of a part, between which no piece stands: it is cut where no piece holds the two neighbours.

        Letters with marks behind them, which most parts are, are cut between the two alone.
        """
        if m := PLAIN.fullmatch(part):
            return [part] if not m[2] or m[1][-1] + m[2][0] in self.pairs else [m[1], m[2]]
        out, start, pairs = [], 0, self.pairs
        for k in range(1, len(part)):
            if part[k - 1 : k + 1] not in pairs:
                out.append(part[start:k])
                start = k
        out.append(part[start:])
        return out

    def keys(self, text: str) -> list[str]:
        """Parts of a text between which no piece stands. A part that starts with a space goes without it, one that starts with a line feed as it is."""
        if not text:
            return []
        lines = self.parts_lines
        if "  " not in text and SPACE not in text and text[0] != " ":
            return (text.replace("\n", " \n") if lines else text).split(" ")
        return [x.removeprefix(SPACE) for x in (LINE_PART if lines else PART).findall(SPACE + text.replace(" ", SPACE))]

    def part(self, key: str) -> str:
        return key if self.parts_lines and key[:1] == "\n" else SPACE + key

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def fold(self, word: str) -> list[int]:
        spans = self._viterbi(word) if self.unigram else self._merge(word)
        return [i for s in spans for i in ([self.ids[s]] if s in self.ids else self.spell(s))]

    def _merge(self, word: str) -> list[str]:
        scores, parts = self.scores, list(word)
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(-scores[x], k, x) for k in range(n - 1) if (x := parts[k] + parts[k + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, k, x = heapq.heappop(heap)
            j = after[k] if parts[k] else -1
            if j < 0 or parts[k] + parts[j] != x:
                continue
            parts[k], parts[j] = x, ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (y := x + parts[after[k]]) in scores:
                    heapq.heappush(heap, (-scores[y], k, y))
            if (p := before[k]) >= 0 and (y := parts[p] + x) in scores:
                heapq.heappush(heap, (-scores[y], p, y))
        return [x for x in parts if x]

    def _viterbi(self, word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, -1)]
        missing = min(self.scores.values(), default=0.0) - 10
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + self.scores[word[s:e]], -s) for s in range(max(0, e - self.longest), e) if word[s:e] in self.scores]
            if word[e - 1] not in self.scores:
                options.append((best[e - 1][0] + missing, 1 - e))
            score, s = max(options)
            best.append((score, -s))
        out, e = [], len(word)
        while e:
            out.append(word[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(1)
def load(path: str) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(p.serialized_model_proto())
    unigram = proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models that leave the text as it is, behind one space, are supported")
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    names = {i: p.id_to_piece(i) for i in range(n)}
    by_byte = {int(names[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
    raw = [bytes([int(names[i][3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else " ⁇ ".encode() if p.is_unknown(i) else names[i].encode() for i in range(n)]
    pairs = frozenset(x for i in plain for x in map("".join, zip(names[i], names[i][1:])))
    if any(x[1] == SPACE and x[0] != SPACE for x in pairs):
        raise ValueError("only models whose pieces hold spaces at their start alone are supported")
    return Pieces(unigram, {names[i]: i for i in plain}, {names[i]: p.get_score(i) for i in plain}, raw, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], p.unk_id(), pairs, max(len(names[i]) for i in plain), not any("\n" in x for x in pairs))


#: Words part at spaces, which go, and before line feeds, which stay.
AT_SPACES = CASED.copy()
AT_SPACES[9:14] = mix(np.arange(9, 14, dtype=np.uint64))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Stretches (from, to, value) of equal values."""
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
    for lo, hi in zip(edges, edges[1:]):
        yield lo, hi, bool(x[lo])


def _parted(texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
    """A column in stretches of texts whose spaces stand alone and within them, as Pieces.keys parts them, and of other texts (True)."""
    odd = np.zeros(len(texts), bool)
    for mark in ("  ", " \n", SPACE):
        odd |= pc.match_substring(texts, mark).fill_null(False).to_numpy(zero_copy_only=False)
    for at, mark in ((pc.starts_with, " "), (pc.starts_with, "\n"), (pc.ends_with, " ")):
        odd |= at(texts, mark).fill_null(False).to_numpy(zero_copy_only=False)
    for lo, hi, alone in _runs(odd):
        yield texts.slice(lo, hi - lo), alone


def _chunks(model: Pieces, texts: pa.Array) -> Iterator[Chunk]:
    return chunks(texts, AT_SPACES, 10 if model.parts_lines else -1)


@frugal
def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): words and their occurrences, added up over as many texts as have KEPT_WORDS different keys."""
    model = load(path)
    names: list[bytes] = []
    table = WordTable(lambda raws: names.extend(raws) or [(b"", True)] * len(raws), together=True)
    seen, odd = np.zeros(0, np.int64), Counter()

    def flush() -> pa.RecordBatch:
        words: dict[str, int] = {}
        part, cut, get = model.part, model.cut, words.get
        for key, n in chain(zip((x.decode("utf-8", "surrogatepass") for x in names), seen.tolist()), odd.items()):
            for w in cut(part(key)):
                words[w] = get(w, 0) + n
        names.clear()
        odd.clear()
        table.empty()
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for part, alone in _parted(b.column(0)):
            if alone:
                for t in part.to_pylist():
                    odd.update(model.keys(t))
            else:
                for c in _chunks(model, part):
                    table.look(c)
                    seen = np.concatenate([seen, np.zeros(table.words - len(seen), np.int64)])
                    seen += np.bincount(table.found, minlength=table.words)
                    if table.words > KEPT_WORDS:
                        yield flush()
                        seen = np.zeros(0, np.int64)
            if len(odd) > KEPT_WORDS:
                yield flush()
                seen = np.zeros(0, np.int64)
    yield flush()


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word of the corpus and its occurrences."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score) of the pieces that text can match: the model's size, whatever the input."""
    model = load(path)
    return spark.createDataFrame([(x, i, float(model.scores[x])) for x, i in model.ids.items()], "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): all pieces in each word, as structs (s, e, score, id) of characters s to e."""
    starts = words.select("word", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("s"))
    spans = starts.select("word", "s", F.explode(F.expr(f"sequence(s + 1, least(s + {longest}, length(word)))")).alias("e"))
    edges = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(pieces), "piece", "left")
    return edges.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("s", "e", "score", "id"))).alias("edges"))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _merge_fold() -> Column:
    """The bounds of a word's pieces, by merging in order of score. Edges that a merge has passed or cut leave the state."""
    live = F.transform(F.filter("edges", lambda x: x.e - x.s > 1), lambda x: F.struct((-x.score).alias("cost"), x.s.alias("s"), x.e.alias("e")))
    first = F.struct(F.expr("sequence(0, length(word))").alias("bounds"), F.array_sort(live).alias("live"))

    def merge(state: Column, best: Column) -> Column:
        bounds = F.filter(state.bounds, lambda p: (p <= best.s) | (p >= best.e))
        rest = F.filter(state.live, lambda x: ((x.e <= best.s) | (x.s >= best.e) | ((x.s <= best.s) & (x.e >= best.e))) & ((x.s != best.s) | (x.e != best.e)))
        return F.when(best.isNull(), F.struct(state.bounds.alias("bounds"), F.slice(state.live, 1, 0).alias("live"))).otherwise(F.struct(bounds.alias("bounds"), rest.alias("live")))

    def step(state: Column, _: Column) -> Column:
        best = lambda: F.get(F.filter(state.live, lambda x: F.array_position(state.bounds, x.e) == F.array_position(state.bounds, x.s) + 2), F.lit(0))
        return F.when(F.size(state.live) == 0, state).otherwise(_let(best(), lambda x: merge(state, x)))

    return F.aggregate(F.expr("sequence(1, length(word))"), first, step, lambda state: state.bounds)


def _viterbi_fold(missing: float) -> tuple[Column, Column]:
    """The bounds of a word's pieces, by the greatest sum of scores; characters that are no piece cost `missing`."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(best: Column, e: Column) -> Column:
        ends = F.transform(F.filter("edges", lambda x: x.e == e), lambda x: F.struct((F.get(best, x.s).score + x.score).alias("score"), (-x.s).alias("s")))
        alone = F.struct((F.get(best, e - 1).score + F.lit(missing)).alias("score"), (1 - e).alias("s"))
        known = F.exists("edges", lambda x: (x.e == e) & (x.s == e - 1))
        top = F.array_max(F.when(known, ends).otherwise(F.concat(ends, F.array(alone))))
        return F.concat(best, F.array(F.struct(top.score.alias("score"), (-top.s).alias("s"))))

    best = F.aggregate(F.expr("sequence(1, length(word))"), first, step)
    back = lambda acc, _: F.when(F.get(acc, F.lit(0)) == 0, acc).otherwise(F.concat(F.array(F.get(F.col("_best"), F.get(acc, F.lit(0))).s), acc))
    return best, F.aggregate(F.expr("sequence(1, length(word))"), F.expr("array(length(word))"), back)


def fold(lattices: DataFrame, model: Pieces) -> DataFrame:
    """(word, ids) of a table of lattices, by higher-order functions alone."""
    if model.unigram:
        best, bounds = _viterbi_fold(min(model.scores.values(), default=0.0) - 10)
        rows = lattices.withColumn("_best", best).withColumn("bounds", bounds)
    else:
        rows = lattices.withColumn("bounds", _merge_fold())
    spans = F.expr("transform(sequence(1, size(bounds) - 1), i -> named_struct('s', bounds[i - 1], 'e', bounds[i]))")
    letters = F.array(*[F.lit(i) for i in model.byte_ids] or [F.lit(model.unknown)])

    def ids(x: Column) -> Column:
        found = F.transform(F.filter("edges", lambda y: (y.s == x.s) & (y.e == x.e)), lambda y: y.id)
        digits = F.hex(F.encode(F.substring(F.col("word"), x.s + 1, x.e - x.s), "UTF-8"))
        spelt = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.get(letters, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int"))) if model.byte_ids else letters
        return F.when(F.size(found) > 0, found).otherwise(spelt)

    return rows.select("word", F.flatten(F.transform(spans, ids)).alias("ids"))


def dictionary(docs: DataFrame, path: str, size: int = DICTIONARY_WORDS, text_col: str = "text") -> DataFrame:
    """(word, ids) of the corpus's most frequent words, as many as size at most.

    The least number of occurrences comes from a histogram with 64 steps to each doubling, so no task ranks all words.
    """
    model = load(path)
    step = F.floor(F.log2("n") * 64)
    counts = cut(count_words(docs, path, text_col).where(F.length("word") <= DICTIONARY_LENGTH).withColumn("step", step), small=True)
    least, room = None, size
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):
        if (room := room - r.words) < 0:
            break
        least = r.step
    top = counts.where(F.lit(least is not None) & (F.col("step") >= F.lit(least or 0))).select("word")
    top = top.repartition(max(8, size // 4000), F.col("word"))  # folding is work for many tasks, few bytes as the words are
    return fold(lattice(top, piece_table(docs.sparkSession, path), model.longest), model)


class Encoder:
    """The ids of texts, from a table of the keys (see Pieces.keys) that this worker has met."""

    def __init__(self, model: Pieces, words: dict[str, bytes]):
        self.model, self.words, self.table = model, words, WordTable(self._keys, together=True)
        self.folded = Recent(lambda word: array("I", model.fold(word)).tobytes(), KEPT_WORDS)
        self.merges = None if model.unigram else Merges(model.ids, model.scores)
        self.sizes = np.array(list(map(len, model.raw)), np.int64)

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Many words beyond the dictionary are folded together, few of them one by one."""
        cuts, get = list(map(self.model.cut, parts)), self.words.get
        found = {w: get(w) for c in cuts for w in c}
        rare = [w for w, ids in found.items() if ids is None]
        if self.merges and len(rare) >= TOGETHER:
            found.update(zip(rare, self.merges.fold(rare)))
            rare = [w for w in rare if found[w] is None]
        for w in rare:
            found[w] = self.folded[w]
        return [found[c[0]] if len(c) == 1 else b"".join([found[w] for w in c]) for c in cuts]

    def _keys(self, raws: list[bytes]) -> list[tuple[bytes, bool]]:
        """The ids of each key's part, and whether they decode to it; all are compared at once, and one by one if any differs."""
        parts = [self.model.part(raw.decode("utf-8", "surrogatepass")) for raw in raws]
        out, name = self._ids(parts), self.model.raw.__getitem__
        want, ids = [part.encode("utf-8", "surrogatepass") for part in parts], np.frombuffer(b"".join(out), "<u4")
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(np.fromiter(map(len, out), np.int64, len(out))) // 4]
        if np.array_equal(ends, np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))) and b"".join(map(name, ids.tolist())) == b"".join(want):
            return [(x, True) for x in out]
        return [(x, b"".join(map(name, memoryview(x).cast("I"))) == y) for x, y in zip(out, want)]

    def text(self, text: str) -> tuple[bytes, bool]:
        """The same of a text by itself."""
        parts = list(map(self.model.part, self.model.keys(text)))
        ids = b"".join([x for k in range(0, len(parts), KEPT_WORDS) for x in self._ids(parts[k : k + KEPT_WORDS])])
        return ids, self.model.decode(array("I", ids)) == text.replace(SPACE, " ")

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of some texts, one behind the other; how many each has; whether they decode to it), until all texts have come."""
        for part, alone in _parted(texts):
            if alone:
                for t in part.to_pylist():
                    ids, exact = self.text(t)
                    yield np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]), np.array([exact])
                continue
            rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in _chunks(self.model, part):
                ids, sizes = self.table.look(c)
                wrong = np.concatenate([[0], np.cumsum(~self.table.flags())])
                ends = np.concatenate([[0], np.cumsum(c.counts)])
                rest.append((ids, by_text(c, sizes), wrong[ends[1:]] == wrong[ends[:-1]]))
                if not c.more:
                    yield rest[0] if len(rest) == 1 else (np.concatenate([x for x, _, _ in rest]), np.array([sum(len(x) for x, _, _ in rest)]), np.array([all(x[0] for _, _, x in rest)]))
                    rest = []


@frugal
def _encode(path: str, words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = kept((__name__, path, words.id), lambda: Encoder(load(path), words.value))
    for b in batches:
        row = 0
        for ids, n, exact in encoder.encode(b.column(1)):
            offsets = np.concatenate([[0], np.cumsum(n)])
            raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), (4 * offsets).tolist()
            values = pa.array(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(n)), pa.array(n.astype(np.int64)), pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64()), pa.array(exact, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "n_pieces", "ids_crc32", "exact", "ids"])
            row += len(n)


class _Words(NamedTuple):
    """A broadcast dictionary with a name of its own, by which a worker keeps its encoder."""

    id: int
    sent: object

    @property
    def value(self) -> dict[str, bytes]:
        return self.sent.value


def encode(docs: DataFrame, path: str, size: int = DICTIONARY_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, exact, ids) for each row of docs.

    ids: the pieces of the whole text, as the library gives them for the model. exact: decoding gives the text back
    (with the model's space sign as a space). Null and empty texts have no pieces and are exact. Repeated rows and null
    ids give a row each; an empty table an empty one. Other columns aren't read. path: the model's file, to be found on
    every executor.
    """
    words = {r.word: array("I", r.ids).tobytes() for r in dictionary(docs, path, size, text_col).collect()}
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_encode, path, _Words(sent._jbroadcast.id(), sent)), "doc_id long, n_pieces long, ids_crc32 long, exact boolean, ids array<int>")


@frugal
def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids). Null ids give a null text, an empty list an empty one."""
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(partial(_decode, path), "doc_id long, text string")
