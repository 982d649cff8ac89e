"""Bit planes, packing and SentencePiece against the libraries themselves."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from specloom.llm import bitplanes, catalog, packing, pieces, wordwise
from specloom.llm.wordwise import tokenizer

from llm_cases import ODD

MODEL = "piece_bpe_32k.model"


def order(row):
    return (row[0] is not None, row[0] or 0, (row[1] or "").encode())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB ,.'\n\té漢<|>12!sreÀ \x1c"), max_size=60))
def test_words_by_themselves_are_the_whole_text(name, text):
    whole = Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenizer(name).encode(text), "<u4").tolist() == whole


def test_documents_by_word_are_whole(documents):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = tokenizer(name)
        for _, text, _ in documents:
            assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_held_once_whatever_stands_beside_it(name, monkeypatch):
    monkeypatch.setattr(wordwise, "WORDS", 50)
    t = wordwise.WordTokenizer(name)
    text = " ".join(f"word{mark}" for mark in (",", ".", ";", "?", "!", ":", ",\n", ".\n") for _ in range(20))
    assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids
    assert len(t.words) <= 12 and not t.stretches
    for k in range(100):
        t.encode(f"{'x' * (k % 60)}y{'z' * (k // 60)} and 漢{k}")
    assert len(t.words) <= 50 and len(t.words.older) <= 50
    assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 4097])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    sizes, payload = bitplanes.pack(ids, 512, bits)
    assert len(sizes) == -(-n // 512) * (32 if bits else 4)
    assert (bitplanes.unpack(sizes, payload, n, 512, bits) == ids).all()


def expected_planes(rows, t):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=order):
        ids = [*t.whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_bit_planes(spark, folder, documents, odd, empty):
    t = tokenizer("word_bpe_49k.json")
    got = sorted(map(tuple, catalog.QUERIES["op4_bit_planes"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected_planes([d[:2] for d in documents], t)
    for bits in (False, True):
        files = bitplanes.token_files(odd, "word_bpe_49k.json", block_ids=1000, chunk_ids=3000, bits=bits)
        got = bitplanes.read_chunks(files, 1000, bits).orderBy("start").collect()
        assert [tuple(r) for r in got] == expected_planes(ODD, t)
    assert bitplanes.read_chunks(bitplanes.token_files(empty, "word_bpe_49k.json")).count() == 0


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    batches = packing.plan(dict(Counter(lengths)), 24)
    rooms = []  # piece by piece
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(24 - n)
    fill: dict[int, list[tuple[int, int]]] = {}
    for length, _, n, each, sequence, at in batches:
        for k in range(n):
            fill.setdefault(sequence + k // each, []).append((at + k % each * length, length))
    assert len(fill) == len(rooms)
    assert sorted(x for s in fill.values() for _, x in s) == sorted(lengths)
    for s in fill.values():
        s.sort()
        assert [a for a, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))] and sum(x for _, x in s) <= 24


def check_packed(rows, got, capacity):
    t = tokenizer("byte_bpe_50k.json").whole
    want = Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[(doc_id, k, s, n, crc(ids[s : s + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))] and sum(x for _, x in s) <= capacity
    lengths = Counter(r.length for r in got)
    assert len(sequences) == len({b[4] + k // b[3] for b in packing.plan(dict(lengths), capacity) for k in range(b[2])})


def test_packing(spark, folder, documents, odd, empty):
    check_packed([d[:2] for d in documents], catalog.QUERIES["op10_best_fit"](spark, folder).collect(), 1024)
    check_packed(ODD, packing.pack(odd, "byte_bpe_50k.json", 64).collect(), 64)
    assert packing.pack(empty, "byte_bpe_50k.json").count() == 0


def test_sentencepiece(spark, folder, documents, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    got = {r.doc_id: r for r in catalog.QUERIES["op8_pieces"](spark, folder).collect()}
    for doc_id, text, _ in documents:
        ids = sp.encode(text)
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    rows = pieces.encode(odd, MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(sp.encode(t or ""))) for i, t in ODD)
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab ▁.\n\té漢🎉​ﬁ"), max_size=40))
def test_spans_are_the_library_s(text):
    e = pieces.encoder(MODEL)
    ids, begins, ends = e.encode(text)
    theirs = e.sp.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in theirs]
    for p, a, b in zip(theirs, begins, ends, strict=True):
        if not p.piece.startswith("<0x"):
            assert (p.begin, p.end) == (a, b)
    assert e.decode(ids.tolist()) == e.sp.decode(e.sp.encode(text))


@pytest.mark.parametrize("rule", ["nfkc_cf", "nmt_nfkc"])
def test_compiled_character_map(rule, documents):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = proto.ModelProto()
    model.ParseFromString(theirs.serialized_model_proto())
    how, e = model.normalizer_spec, object.__new__(pieces.OffsetEncoder)
    e.map, e.prefix, e.squeeze, e.escape = pieces.CharacterMap(how.precompiled_charsmap), how.add_dummy_prefix, how.remove_extra_whitespaces, how.escape_whitespaces
    for text in ["", "  ", " Ａ ①ﬁb  x ", "ｶﾞ Å ½", "a​b", *[d[1][:400] for d in documents[:30]]]:
        normal, origin = e.normalise(text.encode())
        shown, offsets = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == shown
        points = [len(shown[:k].encode()) for k in range(len(shown) + 1)]
        assert [len(text[:k].encode()) for k in offsets] == [origin[p] for p in points]
