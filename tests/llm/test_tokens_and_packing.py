"""Token ids, files of them, and packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrametric.llm import packing, token_files, tokens

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
PATHS = {k: public_tokenizers.path(v) for k, v in FILES.items()}


def plain(kind):
    t = Tokenizer.from_file(PATHS[kind])
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", FILES)
def test_remembered_pieces_equal_the_tokenizer(kind, small):
    ids, encode = plain(kind), tokens.encoder(PATHS[kind], kind).encode
    texts = ["", None, "  \n\n x", "it's 'S 'RE don''t  ''s !!'s", "a\tb  c  ", "<|endoftext|> x<|startoftext|>", "ÀÉ İx ŉ ſ", "日本 x 123456", "d ½²³ 12.5e3", "\x85x \x1c y", "x" * 300 + " " + "é" * 100, "'", "   ", *[r["text"] for r in small.limit(60).collect()]]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [ids(t) for t in texts]


@pytest.mark.parametrize("kind", FILES)
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, exclude_categories=("Cs",)), st.sampled_from("  '\n\tsrevmld ")), max_size=60))
def test_any_latin_text(kind, text):
    assert np.frombuffer(tokens.encoder(PATHS[kind], kind).encode([text])[0], "<u4").tolist() == _plain(kind)(text)


_made = {}


def _plain(kind):
    if kind not in _made:
        _made[kind] = plain(kind)
    return _made[kind]


def test_old_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 3)
    monkeypatch.setattr(tokens, "RUN", 4)
    e = tokens.Encoder(PATHS["byte"], "byte")
    text = "one two three four five six one two seven"
    assert np.frombuffer(e.encode([text, text])[1], "<u4").tolist() == _plain("byte")(text)
    assert len(e.known) <= 9 and len(e.known.older) <= 9


# --- Simple-8b ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert token_files.decode_blocks(*token_files.encode_blocks(ids), len(ids)).tolist() == values


def test_blocks_of_large_and_equal_ids():
    for values in ([2**59, 0, 5, 2**58] + [7] * 300, [0] * 1000, [2**60 - 2], [1] * 128, [32767] * 129):
        ids = np.array(values, np.uint64)
        assert token_files.decode_blocks(*token_files.encode_blocks(ids), len(ids)).tolist() == values
    with pytest.raises(ValueError):
        token_files.encode_blocks(np.array([2**60], np.uint64))


def test_blocks_are_readable_alone():
    ids = np.random.default_rng(1).integers(0, 50_257, 1000).astype(np.uint32)
    words, escapes, words_at, escapes_at = token_files.encode_blocks(ids)
    for b in (0, 3, 7):
        w, e = words[words_at[b] : words_at[b + 1]], escapes[escapes_at[b] : escapes_at[b + 1]]
        own = ids[b * 128 : (b + 1) * 128]
        assert token_files.decode_blocks(w, e, np.array([0, len(w)]), np.array([0, len(e)]), len(own)).tolist() == own.tolist()
    assert len(escapes) and 8 * len(words) + 2 * len(escapes) < 4 * len(ids)


def digests(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = _plain("byte")(text) + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_plain_encoding(small, monkeypatch):
    got = [tuple(r) for r in token_files.roundtrip_digest(small, PATHS["byte"]).orderBy("doc_id").collect()]
    assert got == digests(sorted((r["doc_id"], r["text"]) for r in small.collect()))


def test_token_files_of_odd_rows(odd, clashing, none):
    for df in (odd, clashing):
        got = [tuple(r) for r in token_files.roundtrip_digest(df, PATHS["byte"]).orderBy("start").collect()]
        assert [g[0] for g in got[:2]] == [None, None] and [g[0] for g in got[2:]] == sorted(g[0] for g in got[2:])
        rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
        ends = 0
        for doc, start, n, crc in got:
            assert start == ends and any(d == doc and zlib.crc32(np.array(_plain("byte")(t) + [0], "<u4").tobytes()) == crc for d, t in rows if d == doc)
            ends += n
    assert token_files.roundtrip_digest(none, PATHS["byte"]).count() == 0


# --- packing ---


def check_packing(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("block_size, levels", [(6000, 2), (50, 2), (50, 1)])
def test_sequences_are_whole_and_few(small, block_size, levels):
    got = packing.packed_documents(small, PATHS["word"], block_size=block_size, levels=levels).collect()
    assert check_packing(got, 2048) <= np.ceil(sum(r["length"] for r in got) / 2048) * (1.0 if block_size > 50 else 1.1) + 1
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    ids = _plain("word")
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, parts in by.items():
        whole = ids(texts[doc]) + [0]
        parts.sort(key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == [2048 * k for k in range(len(parts))] and sum(p["length"] for p in parts) == len(whole)
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_packing_odd_rows(odd, clashing, none):
    for df in (odd, clashing):
        got = packing.packed_documents(df, PATHS["word"]).collect()
        check_packing(got, 2048)
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
        assert sum(r["piece"] == 0 for r in got) == odd.count()
        assert sorted(r["length"] for r in got if r["doc_id"] == 1) == [1]
    assert packing.packed_documents(none, PATHS["word"]).count() == 0


def test_sequences_hold_the_ids(small):
    docs = small.limit(20)
    packed = packing.pack(packing.tokenised_pieces(docs, PATHS["word"], "word", 256, keep_ids=True), 256)
    by = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        s = by[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert s["n_tokens"] * 4 == len(s["ids"]) <= 1024


def test_crossover_places_every_document_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 300)
    a, b = packing._first_population(lengths, 2, 100, rng)
    for _ in range(20):
        c = packing._cross(lengths, a, b, 0.5, 100, rng)
        fill = packing._fill(lengths, c)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        a, b = b, c
    best = packing._evolve(lengths, packing._first_population(lengths, 4, 100, rng), 20, 100, rng)[0]
    assert packing._score(lengths, best, 100)[0] <= packing._score(lengths, packing._best_fit(lengths, np.argsort(-lengths), 100), 100)[0]


def test_equal_lengths_fill_sequences(spark):
    pieces = spark.range(64).select(F.col("id").alias("doc_id"), F.lit(512).cast("long").alias("length"))
    assert check_packing(packing.pack(pieces, 2048).collect(), 2048) == 16
