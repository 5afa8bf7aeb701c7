"""Licence scan through a positional index of rare words.

Every template is a licence notice with one mandatory key phrase. The index posts each key phrase's rarest words, by
their inverse document frequency over the scanned corpus, with their positions. A file's licence words look up the
postings from the highest IDF on; what a template's postings have in common of file position minus template position is
an alignment, and an alignment counts if the key phrase stands there word for word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import frugal

#: A-Z to a-z; 0-9, a-z and all bytes from 0x80 stay; the rest separates words.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


#: Base phrases: all places are counted.
BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
# Notices as they stand in files, with the phrase that must be there; words are told apart by what isn't a letter or digit.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache license version 2 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", _GPL.format("general", "3"), "gnu general public license as published by the free software foundation either version 3"),
    Template("gpl-2", _GPL.format("general", "2"), "gnu general public license as published by the free software foundation either version 2"),
    Template("lgpl", _GPL.format("lesser general", "2 1"), "gnu lesser general public license"),
    Template("agpl-3", _GPL.format("affero general", "3"), "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc0", "creative commons zero v1 0 universal", "creative commons zero v1 0 universal"),
)


def words(text: str | None) -> list[bytes]:
    """Words of [0-9a-z] and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Index:
    """postings: word -> (template number, position) of the template's `rare` rarest distinct words."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int], n_docs: int, rare: int = 4):
        self.templates = templates
        self.words = [words(t.text) for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 0.5)) for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed, self.key = [], []
        for k, (t, ws) in enumerate(zip(templates, self.words)):
            key = words(t.key)
            at = next(p for p in range(len(ws)) if ws[p : p + len(key)] == key)
            self.key.append((at, key))
            rarest = set(sorted(set(key), key=lambda w: (-self.idf[w], w))[:rare])  # what the key phrase must hold
            for p in range(at, at + len(key)):
                if ws[p] in rarest:
                    self.postings[ws[p]].append((k, p))
            self.needed.append(sum(w in rarest for w in key))

    def scan(self, file: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its key phrase in the file, share of the template's IDF found there), every place.

        The file's licence words are looked up from the highest IDF on; each leaves of a template's alignments those that
        agree with it, so a rare word that isn't where it should be ends a template before its common ones are asked.
        """
        if self.postings.keys().isdisjoint(file):
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(file):
            if w in self.postings:
                places[w].append(p)
        shifts: dict[int, set[int]] = {}
        agreed: Counter[int] = Counter()
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k, q in self.postings[w]:
                if shifts.get(k, True):
                    here = {p - q for p in places[w]}
                    shifts[k] = shifts[k] & here if k in shifts else here
                    agreed[k] += 1
        out = []
        for k, some in shifts.items():
            at, key = self.key[k]
            weights = [max(self.idf[w], 1e-9) for w in self.words[k]]
            for shift in sorted(some) if agreed[k] == self.needed[k] else ():
                if shift + at >= 0 and file[shift + at : shift + at + len(key)] == key:
                    found = sum(x for p, (w, x) in enumerate(zip(self.words[k], weights), shift) if 0 <= p < len(file) and file[p] == w)
                    out.append((k, shift + at, min(1.0, found / sum(weights))))
        return out


@frugal
def _frequencies(vocabulary: frozenset[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = Counter(), 0
    for b in batches:
        n += b.num_rows
        for t in b.column(0):
            seen.update(vocabulary.intersection(words(t.as_py())))
    yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])


SPANS = "array<struct<label:string,base:boolean,start:bigint,words:int,score:double>>"


@frugal
def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("score", pa.float64())]))
    for b in batches:
        n_words, found = [], []
        for t in b.column(1):
            file = words(t.as_py())
            n_words.append(len(file))
            found.append([{"label": (x := index.templates[k]).label, "base": x.base, "start": s, "words": len(index.key[k][1]), "score": score} for k, s, score in sorted(index.scan(file), key=lambda m: (m[1], m[0]))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(found, spans)], names=["doc_id", "n_words", "spans"])


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) for each row of docs; spans: every place of every template's key phrase, by its start.

    A span has its label, whether the template is a base phrase, its first word (from 0), its length in words and the
    share of the template's IDF weight that stands at the alignment. Document frequencies of the templates' words are
    counted over all rows first; only those (one row for each template word and task, summed) reach the driver. Null
    and empty texts have no words and no spans. Repeated rows and null ids give a row each; an empty table gives an
    empty one. Templates with equal text at one place give a span each. Other columns aren't read.
    """
    vocabulary = frozenset(w for t in templates for w in words(t.text))
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_frequencies, vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word.encode(): r.n for r in rows}
    index = Index(templates, counts, counts.get(b"", 0))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_scan, index), f"doc_id long, n_words long, spans {SPANS}")
