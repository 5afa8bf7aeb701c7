"""Edge cases and brute-force comparisons of the operators for training data."""

from __future__ import annotations

import zlib
from array import array
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from calibra.llm import chat, decontam, graph, langid, licenses, merges, passages, pieces, quality, simhash, tokenfiles, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{b}" for a, b in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n)))


def docs(spark, rows, extra: bool = False):
    df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "'x' as fp", "1 as id", "2 as component_id", "'w' as word", "3 as n", "4 as `_spans`", "5 as rep") if extra else df


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def ids_of(encoder, texts):
    """The ids of each text, from an encoder of columns."""
    out = [(x[0], x[1]) for x in encoder.encode(pa.array(texts, pa.string()))]
    sizes = [n for _, ns in out for n in ns.tolist()]
    ids = iter(np.concatenate([x for x, _ in out]).tolist())
    return [[next(ids) for _ in range(n)] for n in sizes]


@lru_cache
def piece_encoder():
    return pieces.Encoder(pieces.load(MODEL), {})


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (5, "one two three"), (6, "x " * 30_000)]


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB é\n\t.", max_size=40))
@settings(max_examples=100, deadline=None)
def test_fingerprint_matches_the_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_of_a_shingle_is_sparks(spark):
    text = "ünï cödé words"
    assert simhash.fingerprint(text) == spark.sql(f"SELECT xxhash64('{text}') AS h").first().h % (1 << 64)


@given(st.lists(st.integers(0, 2**10 - 1), max_size=40), st.integers(0, 2))
@settings(max_examples=100, deadline=None)
def test_bk_tree_finds_what_brute_force_finds(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:10]:
        assert sorted(tree.values[k] for k in tree.within(v, radius)) == sorted(x for x in set(values) if (x ^ v).bit_count() <= radius)


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODES", 4)  # so that shards are dealt into pieces
    base = prose(1, 400).split()
    texts = [(k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 60, 2)] + [(100 + k, prose(50 + k, 60)) for k in range(20)] + [(200 + k, prose(50, 60)) for k in range(5)] + [(300, None), (301, "")]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fp, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", find(i)) for i in fp}
    assert len({find(i) for i in fp}) < len(fp) - 10


def test_near_duplicates_of_odd_rows(spark):
    out = rows(simhash.near_duplicates(docs(spark, ODD, extra=True)), "doc_id", "component_id")
    assert out == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (5, 5), (6, 6)], key=repr)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, ODD))
    assert rows(kept, "doc_id") == sorted([(1,), (4,), (4,), (None,), (5,), (6,)], key=repr)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=6, deadline=None)
def test_connected_components(spark, links):
    got = dict(rows(graph.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    reach = {n: {n} for p in links for n in p}
    for _ in reach:
        for a, b in links:
            joint = reach[a] | reach[b]
            for n in joint:
                reach[n] = joint
    assert got == {n: min(r) for n, r in reach.items() if len(r) > 1}


# --- licences


@given(st.lists(st.sampled_from("under the mit license Apache License, version 2 cc by-nc 4.0 é nd".split()), max_size=30))
@settings(max_examples=60, deadline=None)
def test_every_base_phrase_is_found(words):
    index = licenses.Index(licenses.BASE + licenses.NOTICES, {b"the": 50, b"by": 40, b"under": 30}, 100)
    file = licenses.words(" ".join(words))
    want = sorted((p, t.label) for t in licenses.BASE for key in [licenses.words(t.key)] for p in range(len(file)) if file[p : p + len(key)] == key)
    assert sorted((s, index.templates[k].label) for k, s, _ in index.scan(file) if index.templates[k].base) == want


def test_license_scan(spark):
    text = "Intro. Released UNDER the MIT License; and the Apache License, Version 2.0! Licensed under CC BY-NC 4.0."
    found = {r.doc_id: r for r in licenses.scan(docs(spark, [(9, text), *ODD], extra=True)).collect()}
    assert [(s.label, s.start) for s in found[9].spans if s.base] == [("mit", 2), ("apache-2", 8), ("cc-by-nc", 15)]
    assert found[9].n_words == 20 and all(0 <= s.score <= 1 for s in found[9].spans)
    assert found[1].n_words == found[2].n_words == 0 and found[1].spans == [] and found[6].n_words == 30_000
    assert licenses.scan(docs(spark, [])).count() == 0
    gpl = licenses.scan(docs(spark, [(1, "This work is licensed under the GNU General Public License, version 3.")])).first()
    assert [s.label for s in gpl.spans] == ["gpl-3"] and gpl.spans[0].score == pytest.approx(1.0)


# --- SentencePiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@given(st.text(alphabet="abt he▁ \n.,'é日😀<0x>A", max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_are_the_librarys(text):
    import sentencepiece

    model = pieces.load(MODEL)
    ids = ids_of(piece_encoder(), [text, text])[1]
    assert ids == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    assert model.decode(ids) == text.replace("▁", " ")


@given(st.lists(st.text(alphabet="abt he▁n.'é日😀th", min_size=1, max_size=34), max_size=40))
@settings(max_examples=100, deadline=None)
def test_words_folded_together_are_folded_as_each_alone(words):
    model, merged = pieces.load(MODEL), piece_encoder().merges.fold(words)
    for w, ids in zip(words, merged):
        alone = len(w) > merges.LONGEST or any(x not in model.ids for x in model._merge(w))
        assert ids == (None if alone else array("I", model.fold(w)).tobytes())


def test_merges_of_equal_scores_start_at_the_left():
    scores = {"a": 0.0, "b": 0.0, "ab": -1.0, "ba": -1.0, "aa": -1.0, "aba": -2.0, "bab": -2.0}
    model = pieces.Pieces(False, {p: k + 1 for k, p in enumerate(scores)}, scores, [b"", *(p.encode() for p in scores)], [], 0, frozenset(), 3)
    words = ["".join(w) for n in range(1, 8) for w in product("ab", repeat=n)]
    assert merges.Merges(model.ids, scores).fold(words) == [array("I", model.fold(w)).tobytes() for w in words]


def test_rare_words_of_a_text_are_not_folded_one_by_one(monkeypatch):
    import sentencepiece

    alone, merge = [], pieces.Pieces._merge
    monkeypatch.setattr(pieces.Pieces, "_merge", lambda model, word: alone.append(word) or merge(model, word))
    rng = np.random.default_rng(11)
    text = " ".join("".join(rng.choice(list("etaonrish"), 9)) for _ in range(2000)) + " 😀é" + " x" * 40 + " " + "y" * 40
    encoder = pieces.Encoder(pieces.load(MODEL), {})
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    assert ids_of(encoder, [text, "  " + text])[0] == want
    assert all(len(w) > merges.LONGEST or "😀" in w for w in alone)


def test_lattice_fold_is_the_workers(spark):
    model = pieces.load(MODEL)
    words = ["▁the", "▁thereafter", "▁日本é", "▁▁▁", "xyzzy", "a", "▁" + "ab" * 20]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in pieces.fold(pieces.lattice(df, pieces.piece_table(spark, MODEL), model.longest), model).collect()}
    assert got == {w: model.fold(w) for w in words}


def test_viterbi_fold_of_a_unigram_model(spark):
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "abc": -9.0, "c": -1.0, "bc": -3.9}
    model = pieces.Pieces(True, {p: k + 1 for k, p in enumerate(scores)}, scores, [b"", *(p.encode() for p in scores)], [], 0, frozenset(["ab", "bc"]), 3)
    table = spark.createDataFrame([(p, model.ids[p], s) for p, s in scores.items()], "piece string, id int, score double")
    words = ["abc", "abab", "c", "axc", "bcbc", "x"]
    got = {r.word: list(r.ids) for r in pieces.fold(pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), table, 3), model).collect()}
    assert got == {w: model.fold(w) for w in words}
    best = lambda w: max((sum(scores[p] for p in c), c) for n in range(len(w)) for cut in combinations(range(1, len(w)), n) for c in [[w[a:b] for a, b in zip((0, *cut), (*cut, len(w)))]] if all(p in scores for p in c))[0]
    names = {v: k for k, v in model.ids.items()}
    assert all(sum(scores[names[i]] for i in got[w]) == pytest.approx(best(w)) for w in ("abc", "abab", "bcbc"))


def test_encoding_of_odd_rows(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode(docs(spark, ODD, extra=True), MODEL, size=3)
    got = rows(out.drop("ids"), "doc_id", "n_pieces", "ids_crc32", "exact")
    want = [(i, len(ids := library.encode(t or "")), zlib.crc32(array("I", ids).tobytes()), True) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert rows(pieces.decode(out, MODEL), "doc_id", "text") == sorted([(i, t or "") for i, t in ODD], key=repr)
    assert pieces.encode(docs(spark, []), MODEL).count() == 0


# --- decontamination


def test_contaminated_matches_brute_force(spark):
    items = [(k, prose(k, n)) for k, n in enumerate((1, 3, 5, 8, 20, 45, 120))] + [(7, None), (8, ""), (4, prose(4, 20))]
    texts = []
    for k, t in items[:-1]:
        ws = (t or "").split()
        texts += [(10 * k, prose(900 + k, 300) + " " + " ".join(ws).upper() + " " + prose(800 + k, 300)), (10 * k + 1, " ".join(ws[: len(ws) * 7 // 10])), (10 * k + 2, " ".join([*ws[: len(ws) // 2], *ws[len(ws) // 2 + 1 :]]))]
    got = rows(decontam.contaminated(docs(spark, texts + [(None, items[5][1]), (500, None)], extra=True), spark.createDataFrame(items, "item_id long, text string"), bits=64), "doc_id", "item_id", "found", "shingles")
    want = set()
    for d, t in texts + [(None, items[5][1])]:
        for i, x in items:
            if ws := licenses.words(x):
                own = decontam.shingle_set(ws)
                mine = decontam.shingle_set(licenses.words(t), min(5, len(ws))) if len(licenses.words(t)) >= min(5, len(ws)) else set()
                if len(own & mine) >= 0.8 * len(own) - 1e-9:
                    want.add((d, i, len(own & mine), len(own)))
    assert got == sorted(want, key=repr) and len(want) >= 7
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs(spark, texts), empty).count() == 0
    assert decontam.contaminated(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontam.keep_clean(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), bits=64)
    assert rows(clean, "doc_id") == sorted(((d,) for d, _ in texts if d not in {w[0] for w in want}), key=repr)


# --- token files


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(tokenizer)
    texts = [*ODD, (50, "Don't <|endoftext|> Ünï... İstanbul ΑΣ. a1b2 x\x1cy"), (7, prose(3, 50))]
    for encoding in ("dictionary", "delta"):
        path = f"{tmp_path}/{encoding}"
        tokenfiles.write(docs(spark, texts, extra=True), path, tokenizer, encoding=encoding)
        files = tokenfiles.read(spark, path)
        want, at = [], 0
        for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
            at += len(ids)
        assert rows(tokenfiles.digest(files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
        assert rows(tokenfiles.places(files), "doc_id", "start") == sorted((w[:2] for w in want), key=repr)
        assert files.select("doc_id", "n_tokens").where("doc_id = 7").count() == 1
    tokenfiles.write(docs(spark, []), f"{tmp_path}/none", tokenizer)
    assert tokenfiles.digest(tokenfiles.read(spark, f"{tmp_path}/none")).count() == 0


@given(st.text(alphabet="aZé'sÀßİΣ\u0301\u00a0\x1c ,.!1<|>", max_size=40))
@settings(max_examples=150, deadline=None)
def test_words_encode_as_the_whole_text(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert ids_of(tokenfiles.encoder(path), [text, text])[1] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_are_encoded_as_asked_and_pages_are_indexed(spark, tmp_path):
    import pyarrow.parquet as pq

    rows_ = [(k, prose(k, 300)) for k in range(400)]
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        tokenfiles.write(docs(spark, rows_).repartition(2), path, public_tokenizers.path("word_bpe_49k.json"), encoding=encoding)
        seen = set()
        for file in sorted((tmp_path / encoding).glob("*.parquet")):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    column = meta.row_group(g).column(c)
                    assert column.has_column_index and column.has_offset_index
                    if column.path_in_schema.startswith("ids"):
                        seen |= set(column.encodings)
                    else:
                        assert "RLE_DICTIONARY" not in column.encodings
        assert name in seen and ("RLE_DICTIONARY" in seen) == (encoding == "dictionary")
    one = tokenfiles.read(spark, f"{tmp_path}/delta").where("doc_id = 7").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,7)" in plan


def test_other_tokenizers_take_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD[:7], (9, "Two  spaces,\n and A Capital"), (10, None)]
    tokenfiles.write(docs(spark, texts), f"{tmp_path}/bytes", path, end_id=50256)
    got = rows(tokenfiles.read(spark, f"{tmp_path}/bytes"), "doc_id", "ids")
    assert got == sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 50256]) for i, t in texts), key=repr)


# --- quality


@given(st.text(alphabet="ab #|\n\té", max_size=80))
@settings(max_examples=150, deadline=None)
def test_quality_counts(text):
    got = dict(zip(quality.FEATURES, quality.features(text)))
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen: dict = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(3)}
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < 0.3, 0, np.where((rng.random(20_000) < p) == good, 1, -1)) for p in (0.95, 0.9, 0.85, 0.9)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate([(tuple(p), int(c)) for p, c in zip(patterns.tolist(), n)])
    assert abs(model.prior - 0.8) < 0.05
    assert all(abs(model.chances[k][0][0] / (model.chances[k][0][0] + model.chances[k][0][2]) - p) < 0.05 for k, p in enumerate((0.95, 0.9, 0.85, 0.9)))


def test_assessment_of_odd_rows(spark):
    texts = [*ODD, *((100 + k, "The " + prose(k, 120) + " and of the " * 6) for k in range(20)), *((200 + j, " ".join(f"#{j}{k}$$$ %%%|" for k in range(90))) for j in range(10))]
    got = {r.doc_id: r for r in quality.assess(docs(spark, texts, extra=True)).collect()}
    assert len(got) == len({i for i, _ in texts}) and got[1].base_failed and got[6].base_failed and not got[6].kept
    assert all(got[100 + k].kept for k in range(20)) and not any(got[200 + j].kept or got[200 + j].base_failed for j in range(10))
    assert quality.assess(docs(spark, [])).count() == 0


# --- language ID


def test_language_identification(spark):
    stems = {"en": "the with and of thing", "de": "der und nicht schön zeit", "fr": "le est dans être aux", "es": "el los ñandú ción que"}
    rng = np.random.default_rng(2)
    rows_ = [(k, " ".join(rng.choice(stems[lang].split(), 30)), lang, None, 1) for k in range(400) for lang in [sorted(stems)[k % 4]]]
    rows_ += [(1000, None, "en", None, 0), (1001, "12 !? 34 ² ½ Ⅷ _", "en", None, 0), (1002, "", "de", None, 0), (None, "the thing", "en", None, 0)]
    df = spark.createDataFrame(rows_, DOCS)
    got = langid.identify(df).collect()
    held = [r for r in got if r.held_out]
    truth = {r[0]: r[2] for r in rows_}
    assert len(got) == len(rows_) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if r.doc_id < 1000]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in langid.keep_identified(df).collect()} == {r[0] for r in rows_} - {1000, 1001, 1002}
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD)).collect()} == {"und"}  # nothing to learn from


def test_held_out_rows_are_never_learnt_from(spark):
    rows_ = [(k, f"word{k % 7} thing", "en" if zlib.crc32(str(k).encode()) % 4 != 2 else "xx", None, 1) for k in range(200)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows_, DOCS)).collect()} == {"en"}


# --- chat


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 300, "ann", "later"), (2, None, None, None), (3, 0, "system", "alone"), (None, 0, "ann", "x"), (1, 2, "bob", "yo")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn int, role string, text string, speaker int")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (2, "unknown", -1), (None, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\nyo<|im_end|>\n" * 2
    assert [ann.rendered[a:b] for a, b in zip(ann.mask_starts, ann.mask_ends)] == ["hi < |im_end|><|im_end|>"]
    bob = got[1, "bob", 0]
    assert [bob.rendered[a:b] for a, b in zip(bob.mask_starts, bob.mask_ends)] == ["yo<|im_end|>"] * 2 and bob.n_own == 2 and bob.n_turns == 4
    assert got[1, "bob", 1].mask_starts == [] and chat.perspectives(df.limit(0)).count() == 0
    late = got[1, "ann", 1]  # a later part opens with the system's turn, which isn't its own
    assert late.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nlater<|im_end|>\n" and late.n_turns == 1
    assert [late.rendered[a:b] for a, b in zip(late.mask_starts, late.mask_ends)] == ["later<|im_end|>"]


def test_turns_of_one_number_come_in_pieces(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, 5, "a\nb", f"{k:04}") for k in range(600)] + [(1, None, "c", "x")] * 300
    got = {(r.speaker, r.part, r.piece): r for r in chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert {k[1:]: r.n_turns for k, r in got.items()} == {(-1, 0): 256, (-1, 1): 44, (0, 0): 256, (0, 1): 256, (0, 2): 89}
    assert all(r.n_own == (0 if s == "c" else r.n_turns - (p == 0 and k == 0)) for (s, p, k), r in got.items() if p == 0)
    assert "user name=a b\n" in got["c", 0, 1].rendered and got["c", 0, 1].rendered.startswith("<|im_start|>system\nbe kind")
    own = [r.rendered[a:b] for k, r in sorted(got.items()) if k[0] == "a\nb" for a, b in zip(r.mask_starts, r.mask_ends)]
    assert own == [f"{k:04}<|im_end|>" for k in range(600)]


# --- passages


@given(st.lists(st.integers(1, 9), min_size=0, max_size=60), st.integers(2, 12))
@settings(max_examples=100, deadline=None)
def test_compact_windows_are_the_cartesian_trees_nodes(values, least):
    rng = np.random.default_rng(len(values))
    x = np.array([0 if v == 9 else int(rng.integers(1, 1 << 40)) for v in values], np.uint64)
    want = set()

    def node(lo, hi):
        if hi - lo >= least:
            c = lo + int(x[lo:hi].argmin())
            want.add((lo, c, hi - 1))
            node(lo, c)
            node(c + 1, hi)

    edges = [-1, *np.flatnonzero(x == 0).tolist(), len(x)]
    for a, b in zip(edges, edges[1:]):
        node(a + 1, b)
    assert set(zip(*(z.tolist() for z in passages.compact_windows(x, least)))) == want


def test_passages_that_repeat(spark):
    shared_, near = prose(1000, 70), prose(1001, 120).split()
    edited = [*near[:60], "other", *near[61:]]
    texts = [(k, prose(k, 80) + " " + shared_ + "\n" + prose(k + 500, 60)) for k in range(12)]
    texts += [(50, prose(50, 40) + " " + " ".join(near)), (51, " ".join(edited) + " " + prose(51, 90)), (60, prose(60, 300)), (61, shared_[:150]), (62, None), (63, ""), (None, shared_)]
    got = passages.links(docs(spark, texts, extra=True)).collect()
    assert all(r.other_id < r.doc_id and r.end_word - r.start_word >= 50 and r.jaccard >= 0.8 for r in got)
    assert {r.doc_id for r in got} == {*range(1, 12), 51}
    assert all((r.start_word, r.end_word) == (80, 150) for r in got if r.doc_id < 50)
    assert {r.doc_id for r in passages.passages(docs(spark, texts)).collect()} == {*range(12), 50, 51}
    assert passages.links(docs(spark, [])).count() == 0
    kept = {r.doc_id: r for r in passages.drop_repeats(docs(spark, texts)).collect()}
    assert shared_ in kept[0].text and all(shared_ not in kept[k].text and kept[k].n_chars == len(kept[k].text) for k in range(1, 12))
    assert kept[60].text == texts[14][1] and kept[62].text is None and kept[5].text.startswith(prose(5, 80)) and kept[5].text.endswith(prose(505, 60))


def test_a_passage_is_found_in_long_documents(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 3000)
    long = prose(7, 20_000).split()
    texts = [(1, " ".join(long)), (2, prose(8, 100) + " " + " ".join(long[15_000:15_060])), (3, " ".join(long[2_990:3_050]))]
    assert {(r.doc_id, r.other_id) for r in passages.links(docs(spark, texts)).collect()} == {(2, 1), (3, 1)}


def test_documents_that_are_copies_go_whole(spark):
    texts = [(1, prose(1, 90)), (2, prose(1, 90)), (3, prose(3, 90))]
    assert {r.doc_id for r in passages.drop_repeats(docs(spark, texts)).collect()} == {1, 3}


def test_a_passage_is_found_behind_documents_that_hold_pieces_of_it(spark):
    texts, want = [], set()
    for k in range(0, 100, 10):
        shared_ = prose(2100 + k, 60).split()
        parts = [shared_[:44], shared_[16:], shared_[10:54], shared_, shared_]  # 44 words are too few to be similar by themselves
        texts += [(k + j, " ".join([prose(2200 + k + j, 50), *part, prose(2400 + k + j, 50)])) for j, part in enumerate(parts)]
        want.add((k + 4, k + 3, 50, 110))
    # the first holder has the passage's line at another place before
    line = prose(2001, 45).split()
    passage = [*line, *prose(2003, 5).split()]
    texts += [(900, " ".join([*line, prose(2004, 60), *passage])), (901, " ".join([prose(2005, 50), *passage, prose(2006, 50)]))]
    want.add((901, 900, 50, 100))
    got = passages.links(docs(spark, texts)).collect()
    assert {(r.doc_id, r.other_id, r.start_word, r.end_word) for r in got} == want


def test_a_changed_passage_is_found_behind_documents_that_hold_pieces_of_it(spark):
    texts, want = [], set()
    for k in range(0, 60, 10):
        one = prose(3100 + k, 50).split()
        other = list(one)
        at = 6 + 7 * (k // 10)
        other[at : at + 1] = (["changed"], [], ["added", one[at]])[k // 10 % 3]
        # each first holder has the words of one side, or 14 words in the middle of them
        pieces = [one[:at], one[at + 1 :], one[1:15], one[9:23], one[18:32], one[27:41], one[36:]]
        texts += [(k + j, " ".join([prose(3200 + k + j, 50), *part, prose(3400 + k + j, 50)])) for j, part in enumerate([*pieces, one, other])]
        a, b = tokens(one), tokens(other)
        assert len(a & b) >= 0.8 * len(a | b)
        want.add((k + 8, k + 7))
    assert {(r.doc_id, r.other_id) for r in passages.links(docs(spark, texts)).collect()} == want


def test_keys_of_two_runs_are_those_of_their_words():
    rng = np.random.default_rng(3)
    one = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    for at in range(5, 45):
        other = np.concatenate([rng.integers(1, 1 << 62, 7).astype(np.uint64), one[:at], [np.uint64(5)], one[at + 1 :]])
        a, b = (passages.parted_keys(x, (np.arange(len(x)),) * 2, (np.arange(len(x)),) * 2, 49)[0] for x in (one, other))
        assert len(set(a.tolist()) & set(b.tolist())) == 1
    assert passages.parted_words(46, 0.8) == 49


def test_rounds_give_all_runs_once_with_what_they_are_linked_to():
    texts, n = [prose(k, 200) for k in (1, 2)], passages.ROUNDS
    asked = [(1, texts[0], None, None, None, None), (1, None, 0, 150, None, None), (2, texts[1], None, None, None, None), (2, None, 0, 150, None, None), (2, None, 10, 60, 1, -4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*asked))], names=list("abcdef"))
    given = lambda turn: [x for b in passages._wholes(25, 1, True, turn, iter([batch])) for x in b.to_pylist()]
    whole, turns = given(None), [given(k) for k in range(n)]
    assert n > 1 and all(turns) and sorted((x["doc"], x["at"]) for t in turns for x in t) == sorted((x["doc"], x["at"]) for x in whole) == [(d, k) for d in (1, 2) for k in range(151)]
    assert all(len({k for k, t in enumerate(turns) for x in t if x["key"] == y["key"]}) == 1 for y in whole[:20])
    root = {(x["doc"], x["at"]): x["root"] for x in whole}
    assert [k for k in range(151) if root[2, k] in {root[1, j] for j in range(151)}] == [*range(10, 36)] and root[2, 10] == root[1, 6]
    words, sides = np.arange(1, 90).astype(np.uint64), (np.arange(89),) * 2
    keys = [passages.parted_keys(words, sides, sides, 49, k, n)[0].tolist() for k in range(n)]
    assert sorted(sum(keys, [])) == sorted(passages.parted_keys(words, sides, sides, 49)[0].tolist())


def test_parted_runs_are_shuffled_by_place_and_windows_in_bulk():
    # 20 keys of a place travel and meet together, and a block's windows as some parts
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5), pa.array([prose(1, 200), *[None] * 4]), pa.array([None, *(4 * 100 + k for k in range(4))], pa.int64())], names=list("abc"))
    sides = [x for b in passages._parted(49, iter([batch])) for x in b.to_pylist()]
    assert [x["place"] for x in sides] == [400, 401, 402, 403] and all(len(x["keys"]) == 8 * 20 for x in sides)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([prose(k, 300) for k in range(20)])], names=list("ab"))
    assert 1 <= sum(b.num_rows for b in passages._windows(46, 4, iter([batch]))) <= 4


def test_groups_too_large_for_a_task_give_what_smaller_ones_give(spark, monkeypatch):
    one = prose(11, 120).split()
    other, third = [*one[:60], "changed", *one[61:]], [*one[:60], *one[61:100], "end"]
    texts = [prose(20, 30).split() + one, prose(21, 20).split() + other, one, prose(22, 40).split() + third, other + prose(23, 30).split()]
    columns = lambda given: [pa.concat_arrays([b.column(k) for b in given]) for k in range(given[0].num_columns)]
    batches = lambda given, order, names: iter([pa.RecordBatch.from_arrays(columns(given), names=names.replace(" long", "").split(", ")).sort_by([(x, "ascending") for x in order]).slice(k, 7) for k in range(0, sum(b.num_rows for b in given), 7)])
    rows_ = [x for k, t in enumerate(texts) for x in ((k, " ".join(t), None, None, None, None), (k, None, 0, len(t), None, None))]
    asked = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows_))], names=list("abcdef"))
    runs = list(passages._wholes(25, 1, True, None, iter([asked])))
    opened = lambda: [x for b in passages._open(25, batches(runs, ["key"], passages.RUNS)) for x in b.to_pylist()]
    want = {(x["doc"], x["at"]) for x in opened()}
    frame = spark.createDataFrame([tuple(x.values()) for b in runs for x in b.to_pylist()], passages.RUNS)
    assert want == {(r.doc, r.at) for r in passages._open_sides(frame, 25).collect()} and len({d for d, _ in want}) == 5
    places = [x for k, t in enumerate(texts) for x in [(k, " ".join(t), None), *((k, None, p) for d, p in sorted(want) if d == k)]]
    sides = list(passages._parted(49, iter([pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*places))], names=list("abc"))])))
    met = lambda: [b for b in passages._meet_parted(49, batches(sides, ["context", "doc", "place"], "context, doc, place, keys"))]
    linked = {(x["doc"], x["rep"]) for b in met() for x in b.to_pylist()}
    keys = {}  # by hand: the first holder of each key
    for b in sides:
        for x in b.to_pylist():
            for key in np.frombuffer(x["keys"], np.uint64).tolist():
                keys.setdefault(key, set()).add(x["doc"])
    assert linked == {(d, min(docs_)) for key, docs_ in keys.items() if key for d in docs_ if d > min(docs_)} and linked
    monkeypatch.setattr(passages, "GROUP", 2)
    given = opened()
    often = spark.createDataFrame([tuple(x.values()) for x in given if x["key"] is not None], passages.RUNS)
    assert often.count() and {(x["doc"], x["at"]) for x in given if x["key"] is None} | {(r.doc, r.at) for r in passages._open_sides(often, 25).collect()} == want
    given = [x for b in met() for x in b.to_pylist()]
    held = sorted((x["key"], x["doc"], x["at"]) for x in given if x["key"] is not None)
    again = passages._meet_whole(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["key", "doc", "at"])]))
    assert held and {(x["doc"], x["rep"]) for x in given if x["key"] is None} | {(x["doc"], x["rep"]) for b in again for x in b.to_pylist()} == linked


@given(st.lists(st.integers(0, 9), max_size=60), st.lists(st.integers(0, 9), max_size=60))
@settings(max_examples=200, deadline=None)
def test_common_blocks_are_those_of_difflib(a, b):
    want = [(x.a, x.b, x.size) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    assert passages.common_blocks(np.array(a, "<u4"), np.array(b, "<u4")) == want


def tokens(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_what_is_asked_of_one_document_is_dealt_out(spark, monkeypatch):
    texts = [(k, prose(k + 1, 60) + " " + prose(7777, 70)) for k in range(30)]
    want = rows(passages.links(docs(spark, texts)), *passages.SPANS.replace(" long", "").replace(" double", "").split(", "))
    monkeypatch.setattr(passages, "ASKED", 4)
    assert rows(passages.links(docs(spark, texts)), *passages.SPANS.replace(" long", "").replace(" double", "").split(", ")) == want and {r[0] for r in want} == {*range(1, 30)}
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    assert rows(passages.links(docs(spark, texts)), *passages.SPANS.replace(" long", "").replace(" double", "").split(", ")) == want


def test_recall_of_edited_passages_and_the_similarity_of_what_is_found(spark):
    texts, similar = [], {}
    for k, (n, changes) in enumerate([(50, 1)] * 120 + [(100, 2)] * 60 + [(200, 4)] * 40 + [(400, 8)] * 20):
        rng = np.random.default_rng(k)
        one = prose(5000 + k, n).split()
        other = list(one)
        for at in rng.choice(n, changes, replace=False):
            other[at] = "changed"
        a, b = tokens(one), tokens(other)
        if len(a & b) >= 0.8 * len(a | b):
            texts += [(2 * k, " ".join([prose(7000 + k, 60), *one, prose(8000 + k, 60)])), (2 * k + 1, " ".join([prose(9000 + k, 60), *other, prose(10_000 + k, 60)]))]
            similar[2 * k + 1] = n
    words = {i: t.split() for i, t in texts}
    got = passages.links(docs(spark, texts)).collect()
    assert all(r.doc_id == r.other_id + 1 and r.doc_id in similar for r in got)
    for r in got:
        a, b = tokens(words[r.doc_id][r.start_word : r.end_word]), tokens(words[r.other_id][r.other_start : r.other_end])
        assert min(r.end_word - r.start_word, r.other_end - r.other_start) >= 50 and len(a & b) >= 0.8 * len(a | b)
    found = {r.doc_id for r in got}
    for n in (50, 100, 200, 400):
        of = [d for d, m in similar.items() if m == n]
        assert len(of) >= 10 and sum(d in found for d in of) >= 0.9 * len(of)


def test_repeats_are_cut_by_row_and_not_by_id(spark):
    shared_, own = prose(1, 80), prose(2, 121)
    texts = [(1, shared_ + " " + prose(3, 60)), (2, prose(4, 20) + " " + shared_), (2, own), (2, own), (None, shared_), (3, None), (4, ""), (1 << 50, shared_ + " " + prose(5, 60))]
    got = passages.drop_repeats(docs(spark, texts, extra=True))
    assert got.columns == docs(spark, [], extra=True).columns
    assert rows(got, "doc_id", "text") == sorted([(1, texts[0][1]), (2, prose(4, 20) + " "), (2, own), (2, own), (None, shared_), (3, None), (4, ""), (1 << 50, prose(5, 60))], key=repr)
    assert passages.drop_repeats(docs(spark, [], extra=True)).count() == 0


def test_stages_take_any_column_names(spark):
    texts = [(1, prose(1, 80)), (1, prose(1, 80)), (2, prose(1, 80)), (None, prose(1, 80)), (3, None), (None, None), (4, prose(4, 30))]
    items = spark.createDataFrame([(1, " ".join(prose(4, 30).split()[:20]))], "item_id long, text string")
    for extra in (docs(spark, texts, extra=True), docs(spark, texts, extra=True).selectExpr("*", "1 as gone", "2 as key", "3 as row", "4 as c0", "5 as item_id")):
        model_rows = extra.withColumn("lang", extra["source"])
        assert rows(simhash.keep_one(extra), "doc_id") == sorted([(1,), (1,), (None,), (3,), (None,), (4,)], key=repr)
        assert rows(decontam.keep_clean(extra, items), "doc_id") == sorted([(1,), (1,), (2,), (None,), (3,), (None,)], key=repr)
        assert rows(langid.keep_identified(model_rows), "doc_id") == sorted([(1,), (1,), (2,), (None,), (4,)], key=repr)
        for out in (simhash.keep_one(extra), decontam.keep_clean(extra, items), langid.keep_identified(model_rows)):
            assert out.columns == extra.columns and (out.schema == extra.schema or out.schema == model_rows.schema)


@given(st.lists(st.integers(0, 4), min_size=0, max_size=80), st.integers(2, 12))
@settings(max_examples=200, deadline=None)
def test_every_run_holds_an_anchor_of_its_least_value(values, least):
    x = np.array(values, np.uint64)
    l, c, r = passages.compact_windows(x, least)
    for s in range(len(x) - least + 1):
        if x[s : s + least].all():
            assert any(a <= s <= k < s + least <= e + 1 and x[k] == x[s : s + least].min() for a, k, e in zip(l, c, r))


def test_a_long_stretch_of_a_repeated_line_is_shared_whole(spark):
    stretch = (prose(3000, 10) + " ") * 2000
    texts = [(1, prose(3001, 300) + " " + stretch + prose(3002, 300)), (2, prose(3003, 200) + " " + stretch + prose(3004, 200)), (3, stretch)]
    kept = {r.doc_id: r.text for r in passages.drop_repeats(docs(spark, texts)).collect()}
    assert kept == {1: texts[0][1], 2: prose(3003, 200) + " " + prose(3004, 200)}


# --- URLs


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "block" if host in urls.LISTED_HOSTS or any(host.endswith("." + x) for x in urls.LISTED_HOSTS) else "allow")


URLS = [
    None, "", "no scheme", "http://a.NET", "http://a.net/", "http://net/x", "https://Sub.Example.net/en/1?q#f", "http://example.net/EN/", "http://example.net/en", "http://b.example.com/de/x", "http://example.com/fr/", "http://x.org/fr/1",
    "http://spam-farm.example.org/en/", "http://spam-farm.example.org/fr/", "http://a.spam-farm.example.org?x", "http://badnet/", "x://y://z.net/a", "http://", "http://.net/", "http://net./", "http://a.net:80/", "HTTP://É.NET/é",
]


@pytest.mark.parametrize("by_join", [False, True])
def test_url_rules(spark, monkeypatch, by_join):
    if by_join:
        monkeypatch.setattr(urls, "MAX_LISTED", 0)
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[4]])] + [(None, URLS[5], "x")], "page_id long, url string, host string")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        rule, verdict = brute_rule(r.host, r.path)
        assert (r.rule, r.verdict) == (rule, verdict), r
    by_id = {r.page_id: r for r in got}
    assert (by_id[6].host, by_id[6].path) == ("sub.example.net", "/en/1") and (by_id[0].host, by_id[0].path) == ("", "") and by_id[21].host == "É.net"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_a_long_list_of_hosts_goes_through_the_cascade(spark, monkeypatch):
    monkeypatch.setattr(urls, "_by_join", None)
    listed = [f"h{k}.example.edu" for k in range(0, 60_000, 2)]
    df = spark.range(3000).selectExpr("id AS page_id", "concat('http://', if(id % 3 = 0, 'www.', ''), 'h', id, '.example.edu/x') AS url")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, listed_hosts=listed).collect()}
    assert got == {k: "allow" if k % 2 else "block" for k in range(3000)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    cascade = urls.Cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.has(universe.key) != (universe.key.substr(2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0
