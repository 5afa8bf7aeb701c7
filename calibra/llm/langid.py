"""Language identification in two steps: the language family first, then linear support vector machines, one for each pair of languages within it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import frugal

#: Language codes by family. Fixed values; a language that isn't named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi ur bn pa gu mr ne si".split(),
    "dravidian": "ta te kn ml".split(),
    "sinitic": "zh yue".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BINS = 4096
#: Most labelled rows that the classifiers are fitted on; languages have equal shares of them.
SAMPLE_ROWS = 2400
UNKNOWN = "und"
#: ASCII bytes that aren't letters part words.
SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text or ""))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte trigrams and bigrams of the whole lower-cased text, with runs of non-letters as one space."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split()) + b" "
    total = np.zeros(BINS, np.float32)
    for k in range(0, len(raw), PIECE):
        c = np.frombuffer(raw[k : k + PIECE + 2], np.uint8).astype(np.uint32)
        if len(c) > 2:
            code = c[:-2] * np.uint32(65537) + c[1:-1] * np.uint32(257) + c[2:]
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    return total


def vector(text: str) -> np.ndarray:
    """Square roots of the counts, of length 1."""
    x = np.sqrt(counts(text))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine with squared hinge loss, by accelerated gradient descent. y: 1 or -1."""
    n = len(x)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    weight = 0.5 / np.maximum(share, 1e-9) / n
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    w = np.zeros(xb.shape[1], x.dtype)
    v, step = w.copy(), 1 / (1 + 2 * c * 2)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = v / c * 0.1 - 2 * c * (xb.T @ (weight * y * slack).astype(x.dtype))
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w


class Model(NamedTuple):
    """families: name -> its languages. family: weights against all others. pair: weights for the first language against the second."""

    families: dict[str, list[str]]
    family: dict[str, np.ndarray]
    pair: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1; UNKNOWN and 0 for a text without a letter."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = vector(text)
        margin = lambda w: float(x @ w[:-1] + w[-1])
        sure = lambda m: 1 / (1 + np.exp(-4 * min(max(m, -20), 20)))
        name, score = next(iter(self.families)), 1.0
        if len(self.families) > 1:
            margins = {f: margin(w) for f, w in self.family.items()}
            name = max(sorted(margins), key=margins.__getitem__)
            score = sure(margins[name])
        langs = self.families[name]
        won = dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pair.items():
            if a in won and b in won:
                p = sure(margin(w))
                won[a] += p
                won[b] += 1 - p
        best = max(langs, key=lambda x: (won[x], x))
        return best, float(min(1.0, score * (won[best] / (len(langs) - 1) if len(langs) > 1 else 1.0)))


def fit(x: np.ndarray, langs: Sequence[str]) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    lang = np.array(langs)
    of = np.array([FAMILY_OF.get(k, k) for k in langs])
    family = {f: fit_svm(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in families} if len(families) > 1 else {}
    pair = {}
    for own in families.values():
        for a, b in combinations(own, 2):
            some = (lang == a) | (lang == b)
            pair[a, b] = fit_svm(x[some], np.where(lang[some] == a, 1.0, -1.0).astype(np.float32))
    return Model(families, family, pair)


@frugal
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() for t in b.column(2)]
        keep = [k for k, t in enumerate(texts) if has_letter(t)]
        some = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array([vector(texts[k]).astype(np.float16).tobytes() for k in keep], pa.binary())], names=["lang", "draw", "x"])


@frugal
def _predict(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [model.value.predict(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["row", "lang_pred", "score"])


def _learnable(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the classifiers on at most sample_rows rows (or one of each language), as many from every language as it has, up to an equal share.

    Of each language's rows whose id isn't held out and whose text has a letter, those with the least hashes of their id
    are taken, so they are the same on every run. Each task makes vectors of its rows before any are gathered; a task
    sees all rows of a language only if they are few. Without such rows the model knows no language and predicts UNKNOWN.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit("draw")).alias("draw"), F.col(text_col).alias("text")).where(_learnable(id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return Model({}, {}, {})
    each = max(1, sample_rows // len(have))
    # so much more than the share that texts without a letter and chance leave enough
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, (1.5 * each + 30) / n)) for k, n in sorted(have.items())])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).withColumn("draw", F.pmod("draw", F.lit(1 << 30))).mapInArrow(_vectors, "lang string, draw long, x binary")
    least = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "x"))).where(F.col("k") <= each)
    got = sorted((r.lang, bytes(r.x)) for r in least.select("lang", "x").collect())
    if not got:
        return Model({}, {}, {})
    return fit(np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32), [k for k, _ in got])


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    held_out: crc32 of the id as text modulo 4 is 2; such rows are never learnt from (null ids aren't held out, nor
    learnt from). lang_pred: a learnt language, or UNKNOWN with score 0 for null texts, texts without a letter, and where
    nothing could be learnt. The prediction takes the whole text and nothing else. Repeated rows give a row each; an
    empty table an empty one. Other columns aren't read.
    """
    model = model or learn(docs, sample_rows, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_predict, sent), "row long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("row").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(F.col("row").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


@frugal
def _keep(model, at: int, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [model.value.predict(t.as_py()) for t in b.column(at)]
        yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))


def keep_identified(docs: DataFrame, least: float = 0.0, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified with at least the given score, all columns as they were, whatever their names.

    Rows of UNKNOWN language go: null texts and texts without a letter among them. Repeated rows and rows with a null id
    are judged by their text, like any other. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_rows, id_col, text_col, lang_col))
    return docs.mapInArrow(partial(_keep, sent, docs.columns.index(text_col), least), docs.schema)
