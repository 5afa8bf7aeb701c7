"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import CASED, cut, frugal, run_hashes
from calibra.llm.wordtable import text_hashes

#: Common function words of several European languages. Fixed values.
STOP_WORDS = frozenset("the of and to in is that it for with on this by are und der die das ist nicht zu mit ein eine le la les des et est que une dans pour de el los las del un por con".encode().split())
SYMBOLS = b"#*$%&|<>"
KEEP_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0))
DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
WINDOW = 3

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_stop", "n_shout")


def features(text: str | None) -> tuple[int, ...]:
    """FEATURES of one text; all zero for null.

    n_dup_lines: lines with a word, equal to an earlier line. n_repeat_words: words within 3-word windows that the text
    holds at least twice. n_shout: occurrences of "!!".
    """
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW:
        runs = run_hashes(text_hashes(text, CASED), WINDOW)
        ordered = np.sort(runs)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            twice = np.isin(runs, again)
            covered = np.zeros(n, bool)
            for k in range(WINDOW):
                covered[k : k + len(runs)] |= twice
            repeated = int(covered.sum())
    return (
        n, len(joined.translate(None, CONTINUATION)), len(raw.translate(None, KEEP_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        len(joined.translate(None, UPPER)), len(joined.translate(None, LETTERS)), len(joined.translate(None, DIGITS)), sum(map(STOP_WORDS.__contains__, words)), raw.count(b"!!"),
    )


@frugal
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])


class Rule(NamedTuple):
    """Votes good where `good` holds, bad where `bad` holds, else abstains."""

    name: str
    good: Column
    bad: Column


def rules() -> list[Rule]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    mean, symbols, repeats = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    lines, upper, letters, digits, stop, shout = share("n_dup_lines", "n_lines"), share("n_upper", "n_letters"), share("n_letters", "word_chars"), share("n_digits", "word_chars"), share("n_stop", "n_words"), share("n_shout", "n_words")
    n = F.col("n_words")
    return [
        Rule("length", n >= 50, n < 20),
        Rule("word_length", mean.between(3, 12), (mean < 2) | (mean > 20)),
        Rule("symbols", symbols < 0.05, symbols > 0.2),
        Rule("dup_lines", lines < 0.1, lines > 0.3),
        Rule("repeats", repeats < 0.2, repeats > 0.4),
        Rule("upper", upper < 0.2, upper > 0.5),
        Rule("letters", letters > 0.85, letters < 0.7),
        Rule("digits", digits < 0.1, digits > 0.3),
        Rule("stop_words", (n >= 30) & (stop >= 0.05), (n >= 30) & (stop < 0.01)),
        Rule("shouting", shout < 0.02, shout > 0.1),
    ]


VOTES = (1, 0, -1)


class Model(NamedTuple):
    """prior: share of good documents. chances: for each rule, the chances of each of VOTES given good, and given bad."""

    prior: float
    chances: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 50) -> Model:
    """Expectation-maximisation over vote patterns (1 good, -1 bad, 0 abstains) and their counts.

    Starts from the view that a document with a bad vote is bad, leaving out rules that call most of what they vote on bad
    (in a language that a rule doesn't know, it says nothing). Chances are smoothed by half a vote. Wherever the bad
    would get more of a rule's good votes than the good, or fewer of its bad votes, the rule's votes count for nothing,
    so the classes can't swap names.
    """
    if not patterns:
        return Model(0.5, ())
    votes, weight = np.array([p for p, _ in patterns], np.int8), np.array([c for _, c in patterns], float)
    told = (weight[:, None] * (votes == -1)).sum(0) <= (weight[:, None] * (votes == 1)).sum(0)
    good = np.where(((votes == -1) & told).any(axis=1), 0.1, 0.9)
    prior, chances = 0.5, np.full((2, len(VOTES), votes.shape[1]), 1 / len(VOTES))
    for _ in range(rounds):
        prior = min(max(float((weight * good).sum() + 0.5) / float(weight.sum() + 1), 0.01), 0.99)
        for k, share in enumerate((weight * good, weight * (1 - good))):
            have = np.stack([(share[:, None] * (votes == v)).sum(0) for v in VOTES]) + 0.5
            chances[k] = have / have.sum(0)
        for j, turned in ((0, chances[1, 0] > chances[0, 0]), (2, chances[0, 2] > chances[1, 2])):
            chances[:, j, turned] = chances[:, j, turned].mean(0)
        odds = math.log(prior / (1 - prior)) + sum(((votes == v) * np.log(chances[0, j] / chances[1, j])).sum(1) for j, v in enumerate(VOTES))
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return Model(prior, tuple((tuple(chances[0, :, k].tolist()), tuple(chances[1, :, k].tolist())) for k in range(votes.shape[1])))


def assess(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FEATURES, base_failed, votes, quality, kept) for each row of docs.

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated windows. votes: one of 1, 0
    and -1 for each rule. quality: the posterior probability of a good document. kept: not base_failed, and quality at
    least the threshold. Votes of all rows are counted by pattern (at most 3 to the number of rules rows, whatever the
    input) and the estimate is made from these counts. Null and empty texts have no words and fail. Repeated rows and
    null ids give a row each; an empty table an empty one. Other columns aren't read.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_features, "doc_id long, " + ", ".join(f"{x} long" for x in FEATURES)), small=True)
    checks = rules()
    voted = rows.withColumn("votes", F.array(*[F.when(r.good, 1).when(r.bad, -1).otherwise(0) for r in checks]))
    counts = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    model = estimate(sorted((tuple(r.votes), r.n) for r in counts))
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (good, bad) in enumerate(model.chances):
        vote = F.get("votes", F.lit(k))
        gain = [math.log(g / b) for g, b in zip(good, bad)]
        odds = odds + F.when(vote == 1, gain[0]).when(vote == -1, gain[2]).otherwise(gain[1])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
