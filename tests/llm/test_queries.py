"""The registered queries and the pipeline against brute force, over a small folder of tables."""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from calibra.llm import langid
from calibra.llm import queries as q

LATIN = "the and of with thing other after house water light stone river cloud paper glass metal sound earth field north south".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{LATIN[a]}{chr(97 + b)}" for a, b in zip(rng.integers(0, len(LATIN), n), rng.integers(0, 26, n)))


ITEMS = [(0, prose(9000, 30)), (1, prose(9001, 12)), (2, prose(9002, 4))]
SHARED = prose(9100, 80)


def texts():
    out = [(k, prose(k, 130)) for k in range(30)]
    out += [(40 + k, prose(k, 130)) for k in range(8)]  # copies
    out += [(50, prose(3, 130).replace(" ", "\n", 3).upper())]
    out += [(60 + k, prose(200 + k, 70) + " " + SHARED + " " + prose(300 + k, 60)) for k in range(5)]
    out += [(70 + k, prose(400 + k, 90) + " " + t.upper() + ". " + prose(500 + k, 90)) for k, (_, t) in enumerate(ITEMS)]
    out += [(80, "Released under the MIT License. " + prose(600, 60) + " Licensed under CC BY-NC 4.0. See the MIT license."), (81, "12 34 !!"), (82, ""), (83, None), (84, "word"), (85, "Apache License, Version 2.0\n" * 30)]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = texts()
    lang = ["en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx" for i, _ in rows]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": lang, "source": ["s"] * len(rows), "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": [t for _, t in ITEMS]}), d / "benchmark.parquet")
    return str(d)


def by_id(df):
    got = df.collect()
    assert len(got) == len({r.doc_id for r in got})
    return {r.doc_id: r for r in got}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op1(spark, folder):
    got = by_id(q.op1_license_scan(spark, folder))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in texts():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.n_base for r in got.values()) == 32


def fingerprints():
    out = {}
    for i, t in texts():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    return out


def components(fp):
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_op2(spark, folder):
    fp = fingerprints()
    root = components(fp)
    assert {i: (r.fingerprint, r.component_id) for i, r in by_id(q.op2_simhash(spark, folder)).items()} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def library(text):
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(text or "")


def test_op3(spark, folder):
    got = by_id(q.op3_sentencepiece(spark, folder))
    assert {i: (list(r.ids), r.n_pieces, r.ids_crc32, r.exact) for i, r in got.items()} == {i: (ids := library(t), len(ids), zlib.crc32(array("I", ids).tobytes()), True) for i, t in texts()}


def leaks(rows):
    out = set()
    for d, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for i, x in ITEMS:
            own = x.split()
            w = min(5, len(own))
            a, b = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)}, {tuple(words[k : k + w]) for k in range(len(words) - w + 1)}
            if len(a & b) >= 0.8 * len(a) - 1e-9:
                out.add((d, i))
    return out


def test_op4(spark, folder):
    want = leaks(texts())
    assert {(r.doc_id, r.item_id) for r in q.op4_decontaminate(spark, folder).collect()} == want == {(70, 0), (71, 1), (72, 2)}


def test_op5(spark, folder):
    t5 = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = {}, 0
    for i, t in sorted(texts()):
        ids = [*t5.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in by_id(q.op5_token_files(spark, folder)).items()} == want


def test_op6(spark, folder):
    got = by_id(q.op6_weak_quality(spark, folder))
    for i, t in texts():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = defaultdict(list)
        for k in range(len(words) - 2):
            windows[tuple(words[k : k + 3])].append(k)
        repeated = len({k + j for v in windows.values() if len(v) > 1 for k in v for j in range(3)})
        r, n = got[i], len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(30))


def test_op7(spark, folder):
    got = by_id(q.op7_language_id(spark, folder))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.lang_pred == ("en" if re.search(r"[^\W\d_]", dict(texts())[i] or "") else "und") for i, r in got.items())


def shared_runs(rows, n=50):
    at = defaultdict(set)
    for d, t in rows:
        words = lower(t).split()
        for k in range(len(words) - n + 1):
            at[tuple(words[k : k + n])].add(d)
    return {d for v in at.values() if len(v) > 1 for d in v}


def test_op9(spark, folder):
    got = q.op9_passages(spark, folder).collect()
    assert {r.doc_id for r in got} == shared_runs(texts()) and all(r.end_word - r.start_word >= 50 for r in got)


def test_pipeline(spark, folder):
    rows = [(i, t) for i, t in texts() if re.search(r"[^\W\d_]", t or "")]
    fp = {i: f for i, f in fingerprints().items() if i in dict(rows)}
    root = components(fp)
    rows = [(i, t) for i, t in rows if root[i] == i]
    owners = min(d for d, _ in rows if d in range(60, 65))
    cut = []
    for i, t in rows:
        if i in range(60, 65) and i != owners:
            words = re.findall(r"\S+", t)
            at = next(k for k in range(len(words)) if words[k : k + 80] == SHARED.split())
            t = " ".join(words[:at] + words[at + 80 :])
        cut.append((i, t))
    gone = {d for d, _ in leaks(cut)}
    want = {i: library(t) for i, t in cut if i not in gone}
    assert gone and {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


DRIVERS = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DRIVERS), reason="needs the driver's tables")
def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{DRIVERS}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    got = q.op6_weak_quality(spark, DRIVERS).select("doc_id", "kept").join(labels, "doc_id").where("good is not null").collect()
    good, bad = [r.kept for r in got if r.good == 1], [r.kept for r in got if r.good == 0]
    assert len(good) > 100 and len(bad) > 20 and sum(good) >= 0.9 * len(good) and sum(bad) <= 0.1 * len(bad)


@pytest.mark.skipif(not os.path.isdir(DRIVERS), reason="needs the driver's tables")
def test_language_of_held_out_rows(spark):
    langs = spark.read.parquet(f"{DRIVERS}/documents.parquet").select("doc_id", "lang")
    got = q.op7_language_id(spark, DRIVERS).where("held_out and lang_pred <> 'und'").join(langs, "doc_id").where("lang is not null").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_languages_of_one_family_are_told_apart(spark):
    sounds = {"en": "the and this that with from have will", "de": "der und das nicht mit eine werden ist", "fr": "les des une que dans pour avec est", "es": "los del una que con para por como"}
    rng = random.Random(5)
    text = lambda lang: " ".join(rng.choice(sounds[lang].split()) for _ in range(40))
    rows = [(k, text(lang), lang, "s", 1) for k in range(800) for lang in [sorted(sounds)[k % 4]]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    lang = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == lang[r.doc_id] for r in got) and sum(r.held_out for r in got) > 100
